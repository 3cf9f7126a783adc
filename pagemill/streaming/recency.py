"""De-duplication bounded by a number of URLs, the least recently seen going first.

The sink keeps a table ``(hash, url, seen, at)`` of the URLs it remembers: the
micro-batch that saw a URL last, valid or repeated alike, and the URL's last place in
that batch's order.  A batch

1. is gathered by URL, first valid row and last place, and staged: it is read once;
   the first valid row of every URL that the table does not hold is written;
2. marks its URLs as seen now, whether they were known or not (a probe refreshes);
3. evicts: batches are counted from the latest down until ``capacity`` is
   passed; older ones go whole, and of the batch at the threshold the latest
   places stay.  Only that batch's latest rows, from an approximate quantile of the
   places on, are put in order, in chunks if they are many (``plans.ordered``).

So the table is an LRU cache whose capacity is enforced between micro-batches; with one
row a batch it is the plain LRU.  An evicted URL that comes again is written again.

Tables are folders ``_recency/batch_id=N``.  Batch N reads the latest one below N and
overwrites its own, so a replayed batch finds what the first attempt found.  Two
tables are kept.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.items import normalize_items, url_key, validation_reason
from ..plans.ordered import number_within
from ..schemas import DEDUP_ORDER
from ..session import remove_path

log = logging.getLogger(__name__)

DEFAULT_CAPACITY = 100_000
ACCURACY = 10_000  # of the quantile: off by that part of the rows at most


def batch_folders(spark: SparkSession, root: str) -> dict[int, str]:
    """Batch number -> folder of the ``batch_id=N`` folders below ``root`` (a listing, no job)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [st.getPath().getName() for st in fs.listStatus(path) if st.isDirectory()]
    return {int(n[9:]): f"{root}/{n}" for n in names if n.startswith("batch_id=") and n[9:].isdigit()}


def evict(table: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` most recent rows of ``table``, by (seen, at, url)."""
    per_batch = table.groupBy("seen").agg(F.count(F.lit(1)).alias("n"))  # a row per batch that is still remembered
    running = per_batch.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("seen"))))
    border = running.filter(F.col("upto") > capacity).orderBy(F.desc("seen")).first()
    if border is None:
        return table
    room = capacity - (border["upto"] - border["n"])  # of the batch at the threshold
    later = table.filter(F.col("seen") > border["seen"])
    latest = number_within(_latest(table.filter(F.col("seen") == border["seen"]), border["n"], room).withColumn("_back", -F.col("at")), "seen", ["_back", "url"], "_n")
    return later.unionByName(latest.filter(F.col("_n") <= room).select(*table.columns))


def _latest(rows: DataFrame, n: int, room: int) -> DataFrame:
    """Of ``n`` rows those from some place on, not many more than ``room`` and no fewer; all where places repeat."""
    share = 1 - room / n - 2 / ACCURACY
    if share <= 0:
        return rows
    place = rows.agg(F.percentile_approx("at", share, ACCURACY)).first()[0]
    some = rows.filter(F.col("at") >= place)
    return some if some.count() >= room else rows


def recency_dedup_sink(path: str, write: Callable[[DataFrame, int], None], capacity: int = DEFAULT_CAPACITY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for a raw item stream: F1, bounded de-duplication, N2-N5, then ``write``.

    ``path`` holds the recency tables.  Rows of a batch are in the de-dup order, which
    begins with the arrival order ``seq``; a capacity of 0 or less is the default.
    """
    capacity = capacity if capacity > 0 else DEFAULT_CAPACITY
    root, warned = f"{path.rstrip('/')}/_recency", []

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        valid = url_key(df.filter(validation_reason().isNull()))
        order = [c for c in DEDUP_ORDER if c in df.columns and c != "url"]
        rest = [c for c in df.columns if c not in order and c != "url"]
        by_url = valid.groupBy(F.xxhash64("url").alias("hash"), "url").agg(
            F.min(F.struct(*order, *rest)).alias("first"), F.max(F.coalesce(DEDUP_ORDER[0], F.lit(0)).cast("long")).alias("at"))
        staged = f"{root}/_staged-{batch_id}"  # written, counted and evicted from one copy
        by_url.write.mode("overwrite").parquet(f"{staged}/now")
        by_url = spark.read.schema(by_url.schema).parquet(f"{staged}/now")
        table = now = by_url.select("hash", "url", "at", F.lit(batch_id).cast("long").alias("seen"))
        earlier = {n: p for n, p in batch_folders(spark, root).items() if n < batch_id}
        if earlier:
            known = spark.read.schema("hash long, url string, at long, seen long").parquet(earlier[max(earlier)])
            by_url = by_url.join(known.select("hash", "url"), ["hash", "url"], "left_anti")
            known.join(now, ["hash", "url"], "left_anti").select(*now.columns).write.mode("overwrite").parquet(f"{staged}/known")
            table = now.unionByName(spark.read.schema(now.schema).parquet(f"{staged}/known"))
        write(normalize_items(by_url.select("url", "first.*")), batch_id)
        kept = evict(table, capacity)
        if kept is not table and not warned:
            warned.append(batch_id)
            log.warning("de-duplication remembers %d URLs and forgets the least recently seen ones", capacity)
        kept.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
        remove_path(spark, staged)
        for n in sorted(earlier)[:-1]:
            remove_path(spark, earlier[n])

    return sink
