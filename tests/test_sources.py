"""spread(): small single-split scans get parallelism; large ones are untouched."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.sources.driver import spread
from pagemill.sources.tables import read_raw_items, submit_items


def test_single_split_scan_is_spread_and_filters_stay_above(spark, tmp_dir):
    spark.range(5000).withColumn("s", F.col("id").cast("string")).coalesce(1).write.parquet(f"{tmp_dir}/one")
    df = spread(spark.read.parquet(f"{tmp_dir}/one"))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2
    q = df.filter(F.length(F.trim("s")) > 3)
    plan = q._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    filt = next(i for i, x in enumerate(lines) if "Filter" in x and "length" in x)
    exch = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(xxhash64" in x)
    assert filt < exch  # the row-level filter runs after (above) the repartition
    assert q.count() == 4000


def test_many_split_scan_untouched(spark, tmp_dir):
    spark.range(5000).repartition(16).write.parquet(f"{tmp_dir}/many")
    df = spark.read.parquet(f"{tmp_dir}/many")
    assert spread(df) is df


def test_readers_push_predicates_and_prune(spark, tmp_dir):
    spark.createDataFrame([], schemas.RAW_ITEMS).write.parquet(f"{tmp_dir}/raw")
    df = read_raw_items(spark, f"{tmp_dir}/raw").filter("scraped_at < timestamp'1998-01-01' and seq > 3").select("seq", "title")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "LessThan(scraped_at" in pushed and "IsNotNull(seq)" in pushed
    assert "price" not in plan.split("ReadSchema:")[1]


def test_submit_drops_empty_records(spark):
    a = spark.createDataFrame([("t", "u"), (None, None)], "title string, url string")
    b = spark.createDataFrame([(5, None)], "seq long, url string")
    assert [r["title"] for r in submit_items(a, b).collect()] == ["t"]
    assert submit_items() is None
