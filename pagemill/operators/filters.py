"""URL filters: F2 allowed domains, F3 robots rules, T2 page de-dup.

Host lists and rule tables are joined, never collected: Catalyst/AQE
broadcast them when their measured size is under the broadcast threshold
and fall back to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_host, url_path, url_query
from .heavy import SHARE_ROWS, Shares, heavy_keys
from .items import dedup_first


def allowed_domains(df: DataFrame, hosts: DataFrame, url_col: str = "url", share_rows: int = SHARE_ROWS) -> DataFrame:
    """keep rows whose URL host is one of ``hosts.host`` (exact,
    case-insensitive, port ignored, no sub-domains).  Hosts of more than
    ``share_rows`` rows are dealt to shares by their URLs."""
    host = url_host(url_col)
    shares = Shares(heavy_keys(df, host, share_rows), share_rows)
    allowed = hosts.select(F.lower(F.col("host")).alias("_host")).distinct().withColumn("_share", F.explode(shares.all(F.col("_host"))))
    return df.withColumns({"_host": host, "_share": shares.one(host, F.col(url_col))}) \
        .join(allowed, ["_host", "_share"], "left_semi").drop("_host", "_share")


def _regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` stands for any text, ``$`` at the end for the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([^A-Za-z0-9/_~% *\x{80}-\x{10FFFF}-])", r"\\$1"), r"\*+", ".*?")
    return F.concat(F.lit("(?s)^"), quoted, F.when(pattern.endswith("$"), r"\z").otherwise(""))


def robots_decisions(urls: DataFrame, rules: DataFrame, url_col: str = "url", share_rows: int = SHARE_ROWS) -> DataFrame:
    """F3 decision per distinct URL: ``(url, allowed)``.

    A rule is a pattern for the begin of path and query, as in RFC 9309: ``*``
    matches any text, ``$`` at the end the end of the URL, all else itself; an
    empty path is ``/``.  The longest matching pattern of the URL's host wins; on
    equal length ``allow`` wins; no matching rule -> allowed.

    Rules are indexed by their literal begin.  A URL is cut to the distinct
    lengths that the literal begins of its host's rules have, and the cuts meet the rules by
    equality of (host, begin): no URL is compared with all rules of its host.
    Rules with ``*`` or ``$`` are then verified.  Heavy hosts are dealt to shares.
    """
    target = F.concat(F.when(url_path("_url") == "", F.lit("/")).otherwise(url_path("_url")), url_query("_url"))
    u = urls.select(F.col(url_col).alias("_url")).distinct().select("_url", url_host("_url").alias("_host"), target.alias("_target"))
    shares = Shares(heavy_keys(u, F.col("_host"), share_rows), share_rows)
    wild = F.col("_pattern").rlike(r"\*|\$$")
    r = rules.groupBy(F.lower("host").alias("_host"), F.col("path_prefix").alias("_pattern")).agg(F.max("allow").alias("_allow")) \
        .select("_host", F.regexp_replace("_pattern", r"(?s)\*.*$|\$$", "").alias("_begin"), F.length("_pattern").alias("_long"), "_allow",
                F.when(wild, _regex(F.col("_pattern"))).alias("_regex"))
    sizes = r.groupBy("_host").agg(F.collect_set(F.length("_begin")).alias("_sizes")).withColumn("_share", F.explode(shares.all(F.col("_host"))))
    cut = u.withColumn("_share", shares.one(F.col("_host"), F.col("_url"))).join(sizes, ["_host", "_share"], "left").select(
        "_url", "_host", F.explode_outer(F.filter("_sizes", lambda n: n <= F.length("_target"))).alias("_size"), "_target") \
        .select("_url", "_host", "_target", F.substring("_target", F.lit(1), F.col("_size")).alias("_begin"))
    m = cut.join(r, ["_host", "_begin"], "left")
    fits = F.col("_allow").isNotNull() & (F.col("_regex").isNull() | F.regexp_like("_target", F.col("_regex")))
    best = m.groupBy("_url").agg(F.max(F.when(fits, F.struct(F.col("_long").alias("size"), F.col("_allow").alias("allow")))).alias("_best"))
    return best.select(F.col("_url").alias(url_col),
                       F.coalesce(F.col("_best.allow"), F.lit(True)).alias("allowed"))


def robots_filter(df: DataFrame, rules: DataFrame, url_col: str = "url", enabled: bool = True) -> DataFrame:
    """keep rows whose URL the robots rules allow (switchable)."""
    if not enabled:
        return df
    dec = robots_decisions(df, rules, url_col).filter("allowed").select(F.col(url_col).alias("_ok"))
    return df.join(dec, F.col(url_col) == F.col("_ok"), "left_semi")


def dedup_pages(pages: DataFrame) -> DataFrame:
    """Each URL is processed once per crawl; the first fetch (lowest
    ``page_id``) wins."""
    order = [c for c in ("page_id", "fetched_at") if c in pages.columns]
    return dedup_first(pages, "url", order)
