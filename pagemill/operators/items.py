"""The item pipeline: F1 validation, D1 de-duplication, C1/C2 and A1.

Order is semantic: validate -> de-duplicate -> normalise.  An invalid row
never claims a URL, and a duplicate is never normalised.

Plans (checked with ``explain``):

* ``dedup_first`` is ``row_number() = 1`` over ``url``.  Catalyst turns it
  into a partial WindowGroupLimit before the single hash exchange, so a URL
  that holds a third of all rows ships at most one row per map task.
* ``tag_items`` keeps every row.  A full window over ``url`` would put a hot
  URL into one task, so the rows of hot URLs, which a sketch names, go another
  way: the per-URL winners are added to them and identical rows are collapsed into
  counted groups by all columns, which spreads a hot URL; rows are then emitted again.
* ``pipeline_stats`` needs only counts: duplicates = valid - accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import DEDUP_ORDER
from .heavy import heavy_keys

# Outcome labels of the item pipeline.
PROCESSED = "processed"
INVALID = "invalid_record"
DUPLICATE = "duplicate_url"
UNPARSEABLE = "unparseable_price"


def validation_reason(title="title", price="price", rating="rating") -> Column:
    """first failing check, NULL when the record is valid.

    Blank (after Unicode trim) title, then price, then rating text.  URL,
    image and availability are not required.
    """
    return (F.when(T.is_blank(title), F.lit("missing_title"))
            .when(T.is_blank(price), F.lit("missing_price"))
            .when(T.is_blank(rating), F.lit("missing_rating")))


def validate_items(raw: DataFrame) -> DataFrame:
    """F1 as a tagging operator: every row plus ``reason`` (NULL = valid)."""
    return raw.withColumn("reason", validation_reason())


def valid_items(raw: DataFrame) -> DataFrame:
    """F1 as a filter."""
    return raw.filter(validation_reason().isNull())


def _order(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def dedup_first(df: DataFrame, key: str = "url", order: list[str] | None = None,
                keep_hash: bool = False) -> DataFrame:
    """Exact first-wins de-duplication on ``key`` (compared verbatim;
    ``""`` is a key like any other).  Ties in ``order`` are rows equal in
    every ordering column and therefore interchangeable.  ``keep_hash``
    keeps the ``_kh`` column, so a following join on ``(_kh, key)`` reuses
    this operator's partitioning instead of shuffling again."""
    order = [c for c in (order or DEDUP_ORDER) if c in df.columns and c != key]
    # A 64-bit hash in front of the key gives the sorts a selective binary
    # prefix (URLs share long common prefixes) and the exchange the same
    # distribution; the key itself still decides equality.
    w = Window.partitionBy("_kh", key).orderBy(*_order(order))
    out = (df.withColumn("_kh", F.xxhash64(key)).withColumn("_rn", F.row_number().over(w))
           .filter(F.col("_rn") == 1).drop("_rn"))
    return out if keep_hash else out.drop("_kh")


def normalize_items(df: DataFrame) -> DataFrame:
    """N2-N5 on accepted rows; the output has the item schema, no NULLs.

    An unparseable price is kept with ``price_numeric = 0.0``.
    """
    price = T.normalize_price("price")
    return df.select(
        T.text("title").alias("title"),
        price.alias("price"),
        F.coalesce(T.parse_price(price), F.lit(0.0)).alias("price_numeric"),
        T.text("rating").alias("rating"),
        T.rating_to_numeric("rating").alias("rating_numeric"),
        T.normalize_availability("availability").alias("availability"),
        T.text("image_url").alias("image_url"),
        T.text("url").alias("url"),
        F.col("scraped_at"),
    )


def url_key(df: DataFrame) -> DataFrame:
    """The URL as the pipeline's key: a missing URL is the empty string."""
    return df.withColumn("url", T.text("url"))


def prepare_items(raw: DataFrame) -> DataFrame:
    """F1 -> D1 -> N2 -> N3 -> N4 -> N5, one lazy chain."""
    return normalize_items(dedup_first(url_key(valid_items(raw))))


def prepare_counted(raw: DataFrame, seen: Observation) -> DataFrame:
    """C1 in the same pass as A1: the prepared items, with the counters in ``seen`` once they are written.

    The counters travel through the de-dup's own exchange: per URL, combined
    map-side, the first valid row and the numbers of valid and invalid rows.
    They are added up behind that exchange, in the tasks that write, whose repeats
    Spark counts once; below it a map task that runs again would count twice.
    """
    valid = validation_reason().isNull()
    order = [c for c in DEDUP_ORDER if c in raw.columns and c != "url"]
    rest = [c for c in raw.columns if c not in order and c != "url"]
    key = T.text("url")
    per_url = raw.groupBy(F.xxhash64(key).alias("_kh"), key.alias("url")).agg(
        F.min(F.when(valid, F.struct(*order, *rest))).alias("_first"), F.count_if(valid).alias("_nv"), F.count_if(~valid).alias("_ni"))
    won = F.col("_nv") > 0
    unparseable = T.parse_price(T.normalize_price("_first.price")).isNull()
    counted = per_url.observe(
        seen, F.count_if(won).alias(PROCESSED), F.coalesce(F.sum("_ni"), F.lit(0)).alias(INVALID),
        (F.coalesce(F.sum("_nv"), F.lit(0)) - F.count_if(won)).alias(DUPLICATE), F.count_if(won & unparseable).alias(UNPARSEABLE))
    return normalize_items(counted.filter(won).select("url", "_first.*"))


# Rows of one identical group emitted by one task; bigger groups are split
# into blocks of this size and spread over tasks before emission.
EMIT_BLOCK = 1_000_000


def tag_items(raw: DataFrame, emit_block: int = EMIT_BLOCK) -> DataFrame:
    """Every raw row with ``outcome`` and ``price_unparseable``.

    Invariant: rows = processed + invalid_record + duplicate_url, and
    unparseable rows are a subset of processed ones.

    URLs of up to ``emit_block`` rows are numbered by one window, valid rows first:
    one exchange, and a row crosses it once.  The rows of hotter URLs, if a
    top-k sketch finds any, are tagged by a plan that is deterministic (no row ids) and skew-safe:
    1. the first valid row per URL wins (D1: partial limit before its one
       exchange, so a hot URL sends one row per task);
    2. raw rows and winners are unioned and grouped by *all* columns, with
       map-side combine: the one exchange of full rows.  Identical rows shrink
       before it, distinct rows of a hot URL spread by their other columns,
       and a winner meets its own row without any join on the URL;
    3. each group is emitted ``_n`` times - one ``processed`` copy if it won,
       the rest duplicates.  Groups above ``emit_block`` rows are cut into
       blocks that are spread over tasks before they are emitted.
    """
    cols = raw.columns
    order = [c for c in DEDUP_ORDER if c in cols and c != "url"]
    rest = [c for c in cols if c not in order and c != "url"]
    key = T.text("url")
    hot = F.array_contains(F.array(*[F.lit(h) for h in heavy_keys(raw, key, emit_block)]).cast("array<bigint>"), F.xxhash64(key))
    heavy = raw.filter(hot)
    won = dedup_first(heavy.filter(validation_reason().isNull()).withColumn("_key", key), "_key", [*order, "url", *rest])
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = heavy.select(*cols, one.alias("_one"), none.alias("_won")) \
        .unionAll(won.select(*cols, none.alias("_one"), one.alias("_won")))
    groups = both.groupBy(*cols).agg(F.sum("_one").alias("_n"), F.max("_won").alias("_won"))

    def tagged(out: DataFrame, first_win: Column) -> DataFrame:
        outcome = (F.when(validation_reason().isNotNull(), F.lit(INVALID))
                   .when(first_win, F.lit(PROCESSED)).otherwise(F.lit(DUPLICATE)))
        unparseable = first_win & T.parse_price(T.normalize_price("price")).isNull()
        return out.select(*cols, outcome.alias("outcome"),
                          F.coalesce(unparseable, F.lit(False)).alias("price_unparseable"))

    def emit(df: DataFrame, idx: Column) -> DataFrame:
        return tagged(df.select(*cols, "_won", idx.alias("_i")), (F.col("_won") == 1) & (F.col("_i") == 1))

    # the key takes the URL's place in the exchange, with a mark where there was none
    keyed = raw.filter(~hot).withColumns({"_bad": validation_reason().isNotNull(), "_none": F.col("url").isNull(), "url": key})
    w = Window.partitionBy("_kh", "url").orderBy("_bad", *_order(order), F.desc("_none"), *_order(rest))
    numbered = keyed.withColumn("_kh", F.xxhash64("url")).withColumn("_i", F.row_number().over(w))
    light = tagged(numbered.withColumn("url", F.when(~F.col("_none"), F.col("url"))), ~F.col("_bad") & (F.col("_i") == 1))
    b = F.lit(emit_block).cast("long")
    small = emit(groups.filter(F.col("_n") <= b), F.explode(F.sequence(one, F.col("_n"))))
    blocks = groups.filter(F.col("_n") > b) \
        .withColumn("_blk", F.explode(F.sequence(none, F.ceil(F.col("_n") / b) - 1))) \
        .repartition(F.xxhash64(*cols, "_blk"))
    big = emit(blocks, F.explode(F.sequence(F.col("_blk") * b + 1, F.least((F.col("_blk") + 1) * b, F.col("_n")))))
    return light.unionByName(small).unionByName(big)


def pipeline_stats(raw: DataFrame) -> DataFrame:
    """A1: ``(metric, value)`` rows for processed and the validation kinds.

    ``processed`` is always present; the other kinds only when non-zero.
    One scan and one aggregation: per URL (partial aggregation, so a hot URL
    is pre-aggregated before the shuffle) the valid and invalid counts and,
    via ``min_by`` over the de-dup order of the valid rows, whether the
    winning record's price is unparseable.  Then processed = URLs with a
    valid row, duplicates = valid rows - processed.
    """
    valid = validation_reason().isNull()
    order = [c for c in DEDUP_ORDER if c in raw.columns and c != "url"]
    unparseable = T.parse_price(T.normalize_price("price")).isNull()
    key = T.text("url")
    per_url = raw.groupBy(F.xxhash64(key).alias("_kh"), key.alias("_key")).agg(
        F.count_if(valid).alias("nv"), F.count_if(~valid).alias("ni"),
        F.min_by(unparseable, F.when(valid, F.struct(*[F.col(c) for c in order]))).alias("wu"))
    tot = per_url.agg(F.count_if(F.col("nv") > 0).alias("p"), F.sum("ni").alias("i"),
                      F.sum("nv").alias("v"), F.count_if(F.col("wu")).alias("u"))
    rows = tot.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(e, F.lit(0)).cast("long").alias("value"))
        for m, e in ((PROCESSED, F.col("p")), (INVALID, F.col("i")), (DUPLICATE, F.col("v") - F.col("p")),
                     (UNPARSEABLE, F.col("u")))])))
    return rows.filter((F.col("metric") == PROCESSED) | (F.col("value") > 0))
