"""A third of all rows on one URL: skew-safe paths equal brute force."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import items as I
from pagemill.plans.ordered import number_within, previous_within
from pagemill.sources import driver as D

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def skewed(spark):
    raw = D.raw_items(spark, SF)
    hot = F.when(F.col("seq") % 3 == 0, F.lit("http://example.test/item/HOT")).otherwise(F.col("url"))
    return raw.withColumn("url", hot).cache()


def test_tag_items_matches_prepare_and_stats(spark, skewed):
    tags = I.tag_items(skewed, emit_block=50)
    counts = {r["outcome"]: r["count"] for r in tags.groupBy("outcome").count().collect()}
    stats = {r["metric"]: r["value"] for r in I.pipeline_stats(skewed).collect()}
    assert sum(counts.values()) == skewed.count()
    assert counts["processed"] == stats["processed"] == I.prepare_items(skewed).count()
    assert counts.get("duplicate_url", 0) == stats.get("duplicate_url", 0)
    assert counts.get("invalid_record", 0) == stats.get("invalid_record", 0)
    won = tags.filter("outcome = 'processed'").select("url", "seq", "title", "price")
    want = I.dedup_first(I.valid_items(skewed)).select("url", "seq", "title", "price")
    assert sorted(won.collect()) == sorted(want.collect())


def test_chunked_order_ops_match_window(spark, skewed):
    order = ["scraped_at", "seq", "title", "price", "rating", "availability", "image_url"]
    obs = skewed.select("url", *order, T.parse_price("price").alias("pv"))
    w = Window.partitionBy("url").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    want_n = obs.withColumn("n", F.row_number().over(w).cast("long"))
    got_n = number_within(obs, "url", order, "n", rows_per_chunk=200)
    key = ["url", *order, "n"]
    assert sorted(got_n.select(*key).collect()) == sorted(want_n.select(*key).collect())
    want_p = obs.withColumn("prev_pv", F.lag("pv").over(w))
    got_p = previous_within(obs, "url", order, ["pv"], rows_per_chunk=200)
    keyp = ["url", *order, "prev_pv"]
    assert sorted(got_p.select(*keyp).collect()) == sorted(want_p.select(*keyp).collect())
