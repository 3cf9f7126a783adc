"""Order-dependent numbering within a key: row number and previous value.

These are the only operators whose result depends on every row of a key in
order.  A plain ``Window.partitionBy(key)`` sorts all rows of a key in one
task, so a key holding a third of the data would serialise a third of the
job.  Here heavy keys are split into *chunks*: contiguous ranges of their whole
order, and a prefix scan over the chunks carries results across.

1. A top-k sketch (``operators.heavy``), one aggregate without a shuffle, names the
   keys above ``rows_per_chunk`` rows.  Usually there are none, and the plan
   is the plain window.
2. Heavy keys get borders: quantiles of the tuple of all order columns in a sample
   of their rows.  Rows that tie in the first columns are cut by the later ones; only
   rows equal in the whole order, which are interchangeable, stay together.
   The sample is drawn by a hash of the order columns: borders are a function of
   the data, the same whenever a task computes them again, and nothing is written.
3. The window runs per ``(key, chunk)``; a row finds its chunk by binary search.
4. A table with a row per chunk of the heavy keys is scanned for what crosses borders:
   the running row count (for numbering) and the last row of the previous chunk
   (for ``previous``).  It is joined back on ``(key, chunk)``, by which the rows
   are dealt already.

Small tables are joined without hints: the adaptive plan broadcasts them by
their measured size and splits skewed partitions otherwise.

A 64-bit hash of the key leads every partitioning and sort key, so sorts get
a selective binary prefix even when keys share long common prefixes (URLs).
A NULL key is a key like any other.  Results are exact and identical to the
plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.heavy import heavy_keys

# Target number of rows one task sorts for one key.
ROWS_PER_CHUNK = 1_000_000
# Chunks of one key at most; a larger key's chunks grow beyond the target.
MAX_CHUNKS = 10_000
# Sampled rows per chunk.
SAMPLED = 24
# Heavy keys looked at.
MOST_KEYS = 1000


def _order_cols(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def _borders(df: DataFrame, key: str, order: list[str], heavy: dict[int, int], rows_per_chunk: int) -> DataFrame:
    """``(_hkh, _hkey, _borders)``: sorted tuples of the order columns that cut every heavy key into chunks of half the target."""
    each = max(rows_per_chunk / 2, max(heavy.values()) / MAX_CHUNKS)  # rows of a chunk
    parts = 1 << 30
    wanted = min(parts, int(SAMPLED / each * parts) + 1)
    rows = df.select(F.xxhash64(key).alias("_hkh"), F.col(key).alias("_hkey"), F.struct(*order).alias("_at"),
                     F.pmod(F.xxhash64(F.lit(0), *order), F.lit(parts)).alias("_draw"))
    drawn = rows.filter(F.col("_hkh").isin(list(heavy)) & (F.col("_draw") < wanted))
    sampled = drawn.groupBy("_hkh", "_hkey").agg(F.sort_array(F.collect_list("_at")).alias("_all"))
    every = max(1, round(each * wanted / parts))  # sampled rows of a chunk
    return sampled.select("_hkh", "_hkey", F.array_distinct(F.filter("_all", lambda x, i: i % every == every - 1)).alias("_borders"))


def _below(borders: Column, at: Column) -> Column:
    """How many of the sorted borders lie below ``at``, by binary search."""
    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        right = open_ & (F.get(borders, middle) < at)
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, middle).otherwise(acc["hi"]).alias("hi"))

    zero = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))
    # a border more than asked for per doubling of the sample: two more rounds
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_CHUNKS.bit_length() + 2)), zero, halve, lambda acc: acc["lo"].cast("long"))


def _chunked(df: DataFrame, key: str, order: list[str], rows_per_chunk: int) -> tuple[DataFrame, bool]:
    """Add ``_kh`` (key hash), ``_chunk`` and ``_hot`` (key spans chunks);
    the flag tells whether any key is heavy."""
    d = df.withColumn("_kh", F.xxhash64(key))
    heavy = heavy_keys(df, F.col(key), rows_per_chunk, MOST_KEYS)
    if not heavy:  # one chunk per key, plain hashed window
        return d.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_hot", F.lit(False)), False
    borders = _borders(df, key, order, heavy, rows_per_chunk)
    j = d.join(borders, (F.col("_kh") == F.col("_hkh")) & F.col(key).eqNullSafe(F.col("_hkey")), "left")
    return j.withColumn("_hot", F.col("_borders").isNotNull()) \
        .withColumn("_chunk", F.when(F.col("_hot"), _below(F.col("_borders"), F.struct(*order))).otherwise(F.lit(0).cast("long"))) \
        .drop("_hkh", "_hkey", "_borders"), True


def _local(df: DataFrame, key: str, order: list[str], rows_per_chunk: int, extra=()) -> tuple[DataFrame, bool]:
    """Chunked rows with their in-chunk row number ``_rn`` (and, when some
    key is hot, the chunk size ``_cnt``); the windows share one exchange and
    one sort."""
    d, has_hot = _chunked(df, key, order, rows_per_chunk)
    part = ["_kh", key, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*_order_cols(order))
    sizes = [F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("_cnt")] if has_hot else []
    return d.select("*", F.row_number().over(w).alias("_rn"), *sizes, *[f(w) for f in extra]), has_hot


def _join_chunks(local: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    c = chunks.select(F.col("_kh").alias("_ckh"), F.col(key).alias("_ckey"), F.col("_chunk").alias("_cchunk"),
                      *[x for x in chunks.columns if x not in ("_kh", key, "_chunk")])
    on = (F.col("_kh") == F.col("_ckh")) & F.col(key).eqNullSafe(F.col("_ckey")) & (F.col("_chunk") == F.col("_cchunk"))
    return local.join(c, on, "left")


def number_within(df: DataFrame, key: str, order: list[str], name: str = "n",
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """1-based position (long) of each row within its ``key`` by ``order``."""
    cols = df.columns
    local, has_hot = _local(df, key, order, rows_per_chunk)
    if not has_hot:
        return local.select(*cols, F.col("_rn").cast("long").alias(name))
    # one row per chunk of a hot key (its last row carries the chunk size)
    sizes = local.filter(F.col("_hot") & (F.col("_rn") == F.col("_cnt"))).select("_kh", key, "_chunk", "_cnt")
    offs = sizes.select("_kh", key, "_chunk", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy("_kh", key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    out = _join_chunks(local, offs, key)
    return out.select(*cols, (F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0))).cast("long").alias(name))


def previous_within(df: DataFrame, key: str, order: list[str], cols: list[str], prefix: str = "prev_",
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``prev_<col>``: the value of ``col`` on the previous row of the key
    (NULL on the key's first row)."""
    base = df.columns
    lags = [lambda w, c=c: F.lag(c).over(w).alias("_lag_" + c) for c in cols]
    local, has_hot = _local(df, key, order, rows_per_chunk, lags)
    if not has_hot:
        return local.select(*base, *[F.col("_lag_" + c).alias(prefix + c) for c in cols])
    # last row of every chunk of a hot key, then the previous chunk's last row
    lasts = local.filter(F.col("_hot") & (F.col("_rn") == F.col("_cnt"))).select(
        "_kh", key, "_chunk", F.struct(*[F.col(c) for c in cols]).alias("_last"))
    prev_last = lasts.select("_kh", key, "_chunk", F.lag("_last").over(
        Window.partitionBy("_kh", key).orderBy("_chunk")).alias("_prev_last"))
    out = _join_chunks(local, prev_last, key)
    first_in_chunk = F.col("_rn") == 1
    return out.select(*base, *[F.when(first_in_chunk, F.col("_prev_last")[c]).otherwise(F.col("_lag_" + c))
                               .alias(prefix + c) for c in cols])
