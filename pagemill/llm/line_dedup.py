"""Line de-duplication (DataFrame functions only).

Explode the normalised lines of every document, hash them, count the distinct
documents per hash, drop the lines of hashes over the threshold (except in
the largest ``doc_id`` holding the key) and reassemble by position.

Only hashes and positions are shuffled for the counting; a line found in a
third of all documents combines map-side and, in the join, meets a written
table, so that the adaptive plan can split its partition.

Defined cases: null and empty texts are one empty line; a line held twice by
one document counts once; rows repeating id and text are treated alike; a null
``doc_id`` counts as one document and never is the largest; columns of a table
that have the names of the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import ascii_lower, materialise

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _row, _pos, _k1, _k2): place and 128-bit hash of every key that is long enough."""
    # the text's hash is computed below the explode, once a document and not once a line
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), F.col("text").alias("_text"))
    at = rows.select("_id", "_row", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    at = at.filter(F.length(F.trim("_line", F.lit(SPACE))) >= min_chars).withColumn("_key", line_key(F.col("_line")))
    return at.select("_id", "_row", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(_k1, _k2, _keep): keys of at least ``min_docs`` documents and the largest id holding each."""
    per_doc = lines.groupBy("_k1", "_k2", "_id").agg(F.lit(1).alias("_one"))
    return (per_doc.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
            .filter(F.col("_n") >= min_docs).select("_k1", "_k2", "_keep"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; other columns as they were."""
    lines = materialise(long_lines(docs, min_chars), "lines")
    keys = materialise(repeated_keys(lines, min_docs), "line-keys")
    drops = (lines.join(keys, ["_k1", "_k2"]).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
             .groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_drops")))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_all"), F.col("doc_id").alias("_id"),
                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    drops = drops.select(F.col("_id").alias("_did"), F.col("_row").alias("_drow"), "_drops")
    j = d.join(drops, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_row") == F.col("_drow")), "left")
    text = F.coalesce("_all.text", F.lit(""))  # the join moves each text once
    none = F.array().cast("array<int>")

    def kept(lines: Column, cuts: Column) -> Column:
        # runs between dropped positions, so that the work is linear in the lines
        runs = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1),
                           lambda i: F.slice(lines, F.get(cuts, i - 1) + 2, F.get(cuts, i) - F.get(cuts, i - 1) - 1))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(cuts) - 2).cast("long").alias("n_dropped"),
                        F.when(F.size(cuts) == 2, text).otherwise(F.array_join(F.flatten(runs), "\n")).alias("kept_text"))

    out = let(_lines(text), lambda lines: let(
        F.concat(F.array(F.lit(-1)), F.coalesce("_drops", none), F.array(F.size(lines))), lambda cuts: kept(lines, cuts)))
    return j.withColumn("_out", out).select("_all.*", "_out.*")


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERY_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
rep AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT a.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE r.k IS NOT NULL AND a.doc_id <> r.keep) AS n_dropped,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos)
              FILTER (WHERE r.k IS NULL OR a.doc_id = r.keep), '')) AS kept_sha256
FROM keyed a LEFT JOIN rep r ON a.k = r.k
GROUP BY a.doc_id
"""
