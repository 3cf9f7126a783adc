"""Item sinks: CSV (K1), JSON Lines (K2), dual (K3) with staged publish (K4),
output validation (K5), format selection (K6).

Spark's ``mode("overwrite")`` deletes the old output before the job runs,
so a failed job would leave nothing.  Instead every write goes to a sibling
``_staging-<run>`` folder on the same file system and is published by
rename (old -> aside, new -> final, delete old) only after the job and
the validation succeeded; the next run repairs a crash between the renames.  Outputs are folders of part files, one per task.
Row counts come from an ``Observation`` in the same pass as the write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_2dp, format_rfc3339
from ..schemas import CSV_COLUMNS, ITEM_COLUMNS

# Supported output formats.
FORMATS = ("csv", "json", "dual")

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "escapeQuotes": "true",
               "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
STALE_MS = 24 * 3600 * 1000
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": JSON_TS_FORMAT}


class OutputValidationError(RuntimeError):
    """K5: the staged output is not publishable (e.g. empty JSON output)."""


def csv_frame(items: DataFrame) -> DataFrame:
    """K1 record layout: header order, RFC 3339 seconds, 2-dp price."""
    return items.select(
        "title", "price", "rating", F.col("rating_numeric").cast("string").alias("rating_numeric"),
        "availability", "image_url", "url", format_rfc3339("scraped_at").alias("scraped_at"),
        format_2dp("price_numeric").alias("price_numeric"))


def json_frame(items: DataFrame) -> DataFrame:
    """K2 record layout: record field order, UTC timestamp with offset."""
    return items.select(*[F.col(c).cast("timestamp").alias(c) if c == "scraped_at" else F.col(c)
                          for c in ITEM_COLUMNS])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _sibling(spark: SparkSession, final: str, name: str) -> str:
    """A path next to ``final`` (which may be relative), on its file system."""
    fs, p, _ = _fs(spark, final)
    full = fs.makeQualified(p)
    return f"{full.getParent().toString().rstrip('/')}/{name.format(full.getName())}"


def recover(spark: SparkSession, final: str) -> None:
    """Repair what a crashed run left next to ``final``.

    A crash between the two renames of ``publish`` leaves the previous output
    aside: it is moved back when there is no output, and deleted otherwise.
    Staging folders older than a day belong to runs that are gone.
    """
    fs, p, jvm = _fs(spark, final)
    full = fs.makeQualified(p)
    parent, name = full.getParent(), full.getName()
    if parent is None or not fs.exists(parent):
        return
    old, now = [], jvm.java.lang.System.currentTimeMillis()
    for st in fs.listStatus(parent):
        got = st.getPath().getName()
        if got.startswith(f"{name}.old-"):
            old.append((st.getModificationTime(), st.getPath()))
        elif got.startswith(f"_staging-{name}-") and now - st.getModificationTime() > STALE_MS:
            fs.delete(st.getPath(), True)
    old.sort(key=lambda x: x[0])
    if old and not fs.exists(full):
        fs.rename(old.pop()[1], full)
    for _, path in old:
        fs.delete(path, True)


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Move ``staged`` onto ``final``; an existing ``final`` is replaced only
    after the new data is in place next to it (K4)."""
    fs, fin, jvm = _fs(spark, final)
    st = jvm.org.apache.hadoop.fs.Path(staged)
    fin = fs.makeQualified(fin)
    if not fs.exists(fin.getParent()):
        fs.mkdirs(fin.getParent())  # K7
    aside = None
    if fs.exists(fin):
        aside = jvm.org.apache.hadoop.fs.Path(_sibling(spark, final, "{}.old-" + uuid.uuid4().hex[:8]))
        if not fs.rename(fin, aside):
            raise OSError(f"cannot move {final} aside")
    if not fs.rename(st, fin):
        if aside is not None:
            fs.rename(aside, fin)
        raise OSError(f"cannot publish {staged} to {final}")
    if aside is not None:
        fs.delete(aside, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, with its folders: a commit record, there whole or not at all."""
    fs, p, _ = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()


def move_over(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder onto ``target``, replacing what is there; nothing to do if ``source`` has been moved."""
    fs, src, jvm = _fs(spark, source)
    dst = jvm.org.apache.hadoop.fs.Path(target)
    if not fs.exists(src):
        return
    if fs.exists(dst):
        fs.delete(dst, True)
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def discard(spark: SparkSession, staged: str) -> None:
    fs, p, _ = _fs(spark, staged)
    if fs.exists(p):
        fs.delete(p, True)


def _staged_write(df: DataFrame, fmt: str, final: str, options: dict, require_rows: bool) -> int:
    spark = df.sparkSession
    run = uuid.uuid4().hex[:12]
    recover(spark, final)
    staged = _sibling(spark, final, "_staging-{}-" + run)
    obs = Observation(f"rows_{run}")
    try:
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists") \
            .options(**options).format(fmt).save(staged)
        rows = int(obs.get.get("rows", 0))
        if require_rows and rows == 0:
            raise OutputValidationError(f"no records written for {final}")
        publish(spark, staged, final)
        return rows
    except BaseException:
        discard(spark, staged)
        raise


def write_csv(items: DataFrame, path: str) -> int:
    """K1: CSV with header; an empty run still publishes the header file."""
    return _staged_write(csv_frame(items), "csv", path, CSV_OPTIONS, require_rows=False)


def write_jsonl(items: DataFrame, path: str) -> int:
    """K2: JSON Lines, every field present; an empty run fails (K5)."""
    return _staged_write(json_frame(items), "json", path, JSON_OPTIONS, require_rows=True)


def dual_json_path(csv_path: str) -> str:
    """The JSON path of a dual run: ``.csv`` suffix replaced by ``.json``."""
    return csv_path.removesuffix(".csv") + ".json"


def write_dual(items: DataFrame, csv_path: str, json_path: str | None = None) -> dict:
    """K3: the same records to CSV and JSONL.  Both writes are attempted;
    a failure of one does not undo the other, and all errors are raised
    together.  The input is computed once, into a staged copy that both
    formats are written from."""
    json_path = json_path or dual_json_path(csv_path)
    spark = items.sparkSession
    copy = _sibling(spark, csv_path, "_staging-{}-" + uuid.uuid4().hex[:12] + "-rows")
    errors, counts = [], {}
    try:
        items.write.parquet(copy)
        cached = spark.read.schema(items.schema).parquet(copy)
        for name, fn, p in (("csv", write_csv, csv_path), ("json", write_jsonl, json_path)):
            try:
                counts[name] = fn(cached, p)
            except Exception as ex:  # noqa: BLE001
                errors.append(ex)
    finally:
        discard(spark, copy)
    if errors:
        if len(errors) == 1:
            raise errors[0]
        raise ExceptionGroup("dual write failed", errors)
    return counts


def write_items(items: DataFrame, fmt: str, path: str) -> dict:
    """K6: pick the sink by (case-insensitive) format name."""
    f = (fmt or "").strip().lower()
    if f == "csv":
        return {"csv": write_csv(items, path)}
    if f == "json":
        return {"json": write_jsonl(items, path)}
    if f == "dual":
        return write_dual(items, path)
    raise ValueError(f"unsupported output format {fmt!r}; expected one of {FORMATS}")


def read_csv_items(spark: SparkSession, path: str) -> DataFrame:
    """Read a K1 output back as text columns (as written)."""
    schema = ", ".join(f"{c} string" for c in CSV_COLUMNS)
    return spark.read.schema(schema).options(**{k: v for k, v in CSV_OPTIONS.items()
                                                if k not in ("escapeQuotes", "emptyValue")}) \
        .option("multiLine", "true").option("mode", "FAILFAST").csv(path)


def read_jsonl_items(spark: SparkSession, path: str) -> DataFrame:
    """Read a K2 output back with the item types."""
    from ..schemas import ITEMS
    return spark.read.schema(ITEMS).option("timestampFormat", JSON_TS_FORMAT) \
        .option("mode", "FAILFAST").json(path)
