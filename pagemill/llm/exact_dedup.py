"""Exact de-duplication by two-pass Bloom filtering (DataFrame functions only).

Pass 1 hashes every text to two slots of a bit space about 32 times as large
as the row count and keeps, as 4 KB bitmaps, the slots hit more than once.
Pass 2 tests every row: a text that repeats has both its slots set, so a row
with a clear slot is unique and passes straight through.  Only the rows that
may repeat are grouped, by SHA-256 of the whole text.

The bitmaps are broadcast while their size is under a bound; beyond it the
lookup is a join on the bitmap's bucket that moves hashes, not texts.

Defined cases: a null text counts as empty; of equal texts the row with the
largest ``doc_id`` stays (null ids lose to any other); rows that repeat both
id and text share one decision and count each in ``group_size``, and
``deduplicate`` returns one of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BROADCAST_BYTES, materialise

SLOTS_PER_ROW = 32
BITMAP_BYTES = 4096


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _slots(h: Column, n_slots: int) -> list[Column]:
    mask = F.lit(n_slots - 1).cast("long")
    return [h.bitwiseAND(mask), F.xxhash64(h).bitwiseAND(mask)]


def _n_slots(n_rows: int) -> int:
    return 1 << max(16, (n_rows * SLOTS_PER_ROW - 1).bit_length())


def repeat_filter(keys: DataFrame, n_slots: int) -> DataFrame:
    """Pass 1: bitmaps (``_bucket``, ``_bits``) of the slots that more than one hash ``_h`` hits."""
    hit = (keys.select(F.explode(F.array(*_slots(F.col("_h"), n_slots))).alias("_slot"))
           .groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    return materialise(
        hit.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")), "repeat-filter")


def _with_test(df: DataFrame, bitmaps: DataFrame, n_slots: int, hint: bool) -> DataFrame:
    """Adds ``_maybe``: both slots of ``_h`` are set."""
    set_ = F.lit(True)
    for i, slot in enumerate(_slots(F.col("_h"), n_slots)):
        b = bitmaps.select(F.col("_bucket").alias(f"_bucket{i}"), F.col("_bits").alias(f"_bits{i}"))
        df = (df.withColumn(f"_slot{i}", slot).withColumn(f"_bucket{i}", F.bitmap_bucket_number(f"_slot{i}"))
              .join(F.broadcast(b) if hint else b, f"_bucket{i}", "left"))
        byte = F.conv(F.hex(F.expr(f"substring(_bits{i}, int(bitmap_bit_position(_slot{i}) div 8) + 1, 1)")), 16, 10).cast("int")
        bit = F.expr(f"int(bitmap_bit_position(_slot{i}) % 8)")
        set_ = set_ & F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return df.withColumn("_maybe", set_)


def repeat_test(keys: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> Callable[[DataFrame], DataFrame]:
    """Pass 1 over ``keys`` (with the ``_h`` of every row); the result is pass 2.

    Pass 2 adds ``_maybe`` to a table with ``_h``: false for rows known to be unique.
    """
    n_slots = _n_slots(keys.count())
    bitmaps = repeat_filter(keys, n_slots)
    if bitmaps.count() * BITMAP_BYTES <= broadcast_bytes:
        return lambda df: _with_test(df, bitmaps, n_slots, True).select(*df.columns, "_maybe")
    found = materialise(_with_test(keys.select("_h"), bitmaps, n_slots, False)
                        .filter("_maybe").select("_h").distinct(), "repeat-hashes").withColumn("_maybe", F.lit(True))
    return lambda df: df.join(found, "_h", "left").select(*df.columns, F.coalesce("_maybe", F.lit(False)).alias("_maybe"))


def _groups(candidates: DataFrame) -> DataFrame:
    """Per text that may repeat: the id that stays and the number of rows (hot texts combine map-side)."""
    return materialise(candidates.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")), "repeat-groups")


def keys_of(docs: DataFrame) -> DataFrame:
    """(_id, _h, _sha) of every row, written once: the only full read of the texts."""
    return materialise(docs.select(F.col("doc_id").alias("_id"), F.xxhash64(_text()).alias("_h"),
                                   F.sha2(_text().cast("binary"), 256).alias("_sha")), "text-keys")


def duplicate_report(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = keys_of(docs)
    marked = repeat_test(keys, broadcast_bytes)(keys)
    cand = marked.filter("_maybe").select("_id", "_sha")
    single = marked.filter("not _maybe").select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    grouped = cand.join(_groups(cand), "_sha").select("_id", "_sha", "_keep", "_size")
    return single.unionAll(grouped).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; only possible repeats are shuffled."""
    cols = docs.columns
    keys = keys_of(docs)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("doc_id").alias("_id"),
                     F.xxhash64(_text()).alias("_h"))
    test = repeat_test(keys, broadcast_bytes)
    marked = test(df)
    cand_keys = test(keys).filter("_maybe").select("_id", "_sha")
    single = marked.filter("not _maybe").select("_row")
    cand = marked.filter("_maybe").withColumn("_sha", F.sha2(F.coalesce("_row.text", F.lit("")).cast("binary"), 256))
    stay = (cand.join(_groups(cand_keys), "_sha").filter(F.col("_id").eqNullSafe(F.col("_keep")))
            .dropDuplicates(["_sha"]).select("_row"))
    return single.unionAll(stay).select("_row.*")


QUERY_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
