"""Crawl history: R1 crawl diff, R2 price changes, R3 catalogue roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.ordered import previous_within
from ..schemas import DEDUP_ORDER
from .items import dedup_first, prepare_items, url_key, valid_items

# Crawl diff labels.
ADDED, REMOVED, CHANGED, UNCHANGED = "added", "removed", "changed", "unchanged"
COMPARED = ["title", "price", "rating", "availability", "image_url"]


def crawl_diff(prev: DataFrame, curr: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """Per URL, ``added`` / ``removed`` / ``changed`` / ``unchanged``.

    Each crawl is first reduced to one record per URL (first wins, D1), so
    both join sides have unique keys and the full outer join cannot blow up
    or skew.  A NULL URL counts as ``""``.  The join is on the de-dup's own
    ``(hash, url)`` key, so both sides arrive already partitioned: two
    exchanges in total.  Fields are compared NULL-safely.
    """
    compared = compared or COMPARED

    def side(df: DataFrame, tag: str) -> DataFrame:
        keyed = df.withColumn("url", T.text("url"))
        return dedup_first(keyed, keep_hash=True).select(
            "_kh", "url", F.lit(True).alias(f"_in_{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in compared])

    j = side(prev, "p").join(side(curr, "c"), ["_kh", "url"], "full_outer")
    in_a, in_b = F.col("_in_p").isNotNull(), F.col("_in_c").isNotNull()
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}"))
    change = (F.when(~in_a, F.lit(ADDED)).when(~in_b, F.lit(REMOVED))
              .when(same, F.lit(UNCHANGED)).otherwise(F.lit(CHANGED)))
    return j.select("url", change.alias("change"),
                    F.col("p_price").alias("price_before"), F.col("c_price").alias("price_after"))


def price_changes(history: DataFrame) -> DataFrame:
    """R2: every change of a URL's price between consecutive observations.

    Observations are valid records (F1) with a parseable price, ordered by
    ``scraped_at`` then the de-dup order.  Output ``url, scraped_at,
    price_before, price_after, delta``.
    """
    obs = url_key(valid_items(history)).select(
        "url", *[c for c in DEDUP_ORDER if c in history.columns],
        T.parse_price(T.normalize_price("price")).alias("price_value")).filter(F.col("price_value").isNotNull())
    order = ["scraped_at"] + [c for c in DEDUP_ORDER if c in history.columns and c != "scraped_at"]
    withprev = previous_within(obs, "url", order, ["price_value"])
    return withprev.filter(F.col("prev_price_value").isNotNull()
                           & (F.col("prev_price_value") != F.col("price_value"))).select(
        "url", "scraped_at", F.col("prev_price_value").alias("price_before"),
        F.col("price_value").alias("price_after"),
        F.round(F.col("price_value") - F.col("prev_price_value"), 2).alias("delta"))


def catalog_rollup(raw: DataFrame) -> DataFrame:
    """Count / avg / min / max price by rating and availability over the
    prepared items (hash aggregate with partial combine)."""
    items = prepare_items(raw)
    return items.groupBy("rating_numeric", "availability").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.round(F.avg("price_numeric"), 4).alias("avg_price"),
        F.min("price_numeric").alias("min_price"),
        F.max("price_numeric").alias("max_price"))
