"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint takes the majority of every bit over the XXH64 hashes (seed 42)
of a text's word shingles, repeats included.  Fingerprints link at
``max_bits`` or fewer differing bits; a group is a connected component.

The index has ``max_bits // 2 + 1`` segments.  By the pigeonhole principle two
linked fingerprints differ by at most one bit in one of the first segments, or
are equal in one of the rest.  So every distinct fingerprint looks up, per
segment, its own value and, where needed, the values one bit away (bits raised
only: of two values one bit apart, one is the other with a bit raised), fetches
the table's fingerprints and verifies the complete distance.

Buckets with more than ``BUCKET`` fingerprints would emit many pairs.  What
looks into one is linked exactly in another way: two fingerprints are within
two bits if and only if their balls of radius one share a value, so sharing
members link to the smallest of them, and no pairs are made.

Defined cases: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle are one shingle; equal
fingerprints are one node, however many rows hold them; null ids are never
the smallest of a group unless all are null.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, materialise
from pagemill.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BUCKET = 16  # table rows of a bucket that are compared pair by pair
BLOCK = 1 << 16  # shingles hashed at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text."""
    ws = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(ws) - shingle + 1)
    starts, ends = starts[:n].tolist(), (ends[len(ws) - n:] - 1).tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[i:i + BLOCK], ends[i:i + BLOCK])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_id, _row, _fp) of every row of ``docs``; _row is a hash of the text."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text")
    got = add_columns(rows, "text", lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], "_fp long", keep=["doc_id", "_row"])
    return got.select(F.col("_k0").alias("_id"), F.col("_k1").alias("_row"), "_fp")


def _segments(max_bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of every segment."""
    m = max_bits // 2 + 1
    edges = [64 * i // m for i in range(m + 1)]
    whole, rest = divmod(max_bits, m)
    return [(edges[i], edges[i + 1] - edges[i], whole if i <= rest else whole - 1) for i in range(m)]


def _key(fp: Column, shift: int, width: int) -> Column:
    v = F.shiftrightunsigned(fp, shift) if shift else fp
    return v if width == 64 else v.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _flips(v: Column, width: int, raised_only: bool) -> Column:
    bits = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(width)])
    if raised_only:
        bits = F.filter(bits, lambda b: v.bitwiseAND(b) == 0)
    return F.transform(bits, lambda b: v.bitwiseXOR(b))


def _lookups(fps: DataFrame, max_bits: int, probe: bool) -> DataFrame:
    """(_seg, _val, _fp): the table's entries, or with ``probe`` the balls looked up in it."""
    def of(i: int, shift: int, width: int, radius: int) -> Column:
        v = _key(F.col("_fp"), shift, width)
        vals = F.concat(F.array(v), _flips(v, width, True)) if probe and radius else F.array(v)
        return F.transform(vals, lambda x: F.struct(F.lit(i).alias("_seg"), x.alias("_val")))

    per = [of(i, *s) for i, s in enumerate(_segments(max_bits)) if s[2] >= 0]
    return fps.select("_fp", F.explode(F.concat(*per)).alias("_e")).select("_e._seg", "_e._val", "_fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``max_bits``; ``fps`` has distinct ``_fp``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits: 0, 1 or 2")
    entries = _lookups(fps, max_bits, False)
    probes = _lookups(fps, max_bits, True)
    hot = materialise(entries.groupBy("_seg", "_val").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket).select("_seg", "_val"), "hot-buckets")
    cold = probes.join(hot, ["_seg", "_val"], "left_anti")
    other = entries.withColumnRenamed("_fp", "_fp2")
    pairs = (cold.join(other, ["_seg", "_val"])
             .filter((F.col("_fp") != F.col("_fp2")) & (F.bit_count(F.col("_fp").bitwiseXOR(F.col("_fp2"))) <= max_bits))
             .select(F.least("_fp", "_fp2").alias("a"), F.greatest("_fp", "_fp2").alias("b")).distinct())
    crowd = materialise(probes.join(hot, ["_seg", "_val"], "left_semi").select("_fp").distinct(), "crowded")
    around = F.col("_fp")
    ball = F.concat(F.array(around), _flips(around, 64, False)) if max_bits else F.array(around)
    shared = materialise(crowd.select("_fp", F.explode(ball).alias("_val")), "balls")
    if max_bits == 1:  # a ball of radius one must hold the other fingerprint itself
        star = shared.join(crowd.withColumnRenamed("_fp", "_fp2"), F.col("_val") == F.col("_fp2")).select("_fp", "_fp2")
    else:
        least = materialise(shared.groupBy("_val").agg(F.min("_fp").alias("_fp2"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_val", "_fp2"), "ball-least")
        star = shared.join(least, "_val").select("_fp", "_fp2")
    star = star.filter("_fp <> _fp2").select(F.least("_fp", "_fp2").alias("a"), F.greatest("_fp", "_fp2").alias("b")).distinct()
    return pairs.unionAll(star)


def _groups(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(_id, _row, _fp, _cid) of every row."""
    each = materialise(fingerprints(docs, shingle), "fingerprints")
    fps = materialise(each.groupBy("_fp").agg(F.min("_id").alias("_low")), "distinct-fingerprints")
    label = components(links(fps.select("_fp"), max_bits))
    named = fps.join(label.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_low", F.coalesce("label", "_fp").alias("_comp"))
    named = materialise(named, "fingerprint-components")
    low = materialise(named.groupBy("_comp").agg(F.min("_low").alias("_cid")), "component-ids")
    of = materialise(named.join(low, "_comp").select("_fp", "_cid"), "fingerprint-ids")
    return each.join(of, "_fp")


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    return _groups(docs, shingle, max_bits).select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_cid").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near copies: the document with the smallest id of every group stays.

    Rows sharing that id stay together, and so do the rows of a group without any id.
    """
    gone = (_groups(docs, shingle, max_bits).filter(~F.col("_id").eqNullSafe(F.col("_cid")))
            .select(F.col("_id").alias("_gone"), F.col("_row").alias("_gone_row")).distinct())
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_all"), F.col("doc_id").alias("_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    stay = rows.join(materialise(gone, "near-copies"),
                     F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_row") == F.col("_gone_row")), "left_anti")
    return stay.select("_all.*")
