"""Chunked (skew-safe) numbering equals the plain window, hot keys included."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.plans.ordered import number_within, previous_within


def data(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else ("warm" if i % 7 == 0 else f"k{rnd.randrange(200)}")
        ts = t0 + dt.timedelta(seconds=rnd.randrange(0, 5000)) if rnd.random() > 0.01 else None
        rows.append((i, key, ts, float(rnd.randrange(100))))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, v double")


def test_number_within_matches_window(spark):
    df = data(spark)
    want = df.withColumn("n", F.row_number().over(
        Window.partitionBy("key").orderBy(F.col("ts").asc_nulls_first(), "id")).cast("long"))
    got = number_within(df, "key", ["ts", "id"], "n", rows_per_chunk=50)
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "_chunk" in plan


def test_previous_within_matches_lag(spark):
    df = data(spark)
    want = df.withColumn("prev_v", F.lag("v").over(
        Window.partitionBy("key").orderBy(F.col("ts").asc_nulls_first(), "id")))
    got = previous_within(df, "key", ["ts", "id"], ["v"], rows_per_chunk=40)
    assert sorted(got.select("id", "prev_v").collect()) == sorted(want.select("id", "prev_v").collect())


def test_hot_key_is_split(spark):
    df = data(spark)
    from pagemill.plans.ordered import _chunked
    chunked, has_hot = _chunked(df, "key", ["ts", "id"], 100)
    assert has_hot
    chunks = chunked.filter("key = 'hot'").select("_chunk").distinct().count()
    assert chunks >= 5


def test_burst_is_cut_by_depth(spark):
    """99% of a key's rows in 1% of its time: no chunk holds much more than its share; a NULL key is cut too."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, key, t0 + dt.timedelta(seconds=i if i < 9900 else i * 1000), 1.0) for key in ("hot", None) for i in range(10000)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, v double")
    from pagemill.plans.ordered import _chunked
    chunked, has_hot = _chunked(df, "key", ["ts", "id"], 100)
    assert has_hot
    sizes = [r["count"] for r in chunked.groupBy("key", "_chunk").count().collect()]
    assert max(sizes) <= 150 and sum(sizes) == len(rows)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")).cast("long"))
    got = number_within(df, "key", ["ts", "id"], "n", rows_per_chunk=100)
    key = ["key", "id", "n"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_ties_in_the_first_column_are_split(spark):
    """All rows tie in the first order column: the later ones cut them, and the largest window stays small."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 5 else f"k{i}", t0, float(i * 7919 % 1000)) for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, v double")
    from pagemill.plans.ordered import _chunked
    order = ["ts", "v", "id"]
    chunked, has_hot = _chunked(df, "key", order, 500)
    assert has_hot
    sizes = [r["count"] for r in chunked.groupBy("key", "_chunk").count().collect()]
    assert max(sizes) <= 750 and sum(sizes) == len(rows)
    w = Window.partitionBy("key").orderBy("ts", "v", "id")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("prev_id", F.lag("id").over(w))
    got = number_within(df, "key", order, "n", rows_per_chunk=500).select("id", "n")
    assert sorted(got.collect()) == sorted(want.select("id", "n").collect())
    prev = previous_within(df, "key", order, ["id"], rows_per_chunk=500).select("id", "prev_id")
    assert sorted(map(str, prev.collect())) == sorted(map(str, want.select("id", "prev_id").collect()))


def test_rows_equal_in_the_whole_order(spark):
    rows = [("hot", 1, None)] * 3000 + [("hot", i, "x") for i in range(1000)] + [(None, None, None)] * 500
    df = spark.createDataFrame(rows, "key string, a int, b string")
    got = number_within(df, "key", ["a", "b"], "n", rows_per_chunk=100).groupBy("key").agg(F.count("n").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m"))
    assert {(r.key, r.c, r.d, r.m) for r in got.collect()} == {("hot", 4000, 4000, 4000), (None, 500, 500, 500)}


def test_no_checkpoint_and_no_key_shuffle_before_the_window(spark, monkeypatch):
    from pyspark.sql import DataFrame
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *a, **k: (_ for _ in ()).throw(AssertionError("checkpoint")))
    plan = number_within(data(spark), "key", ["ts", "id"], "n", rows_per_chunk=50)._jdf.queryExecution().toString()
    assert plan.count("Window") and "percentile" not in plan


def test_no_hot_key_path(spark):
    df = data(spark)
    want = df.withColumn("n", F.row_number().over(
        Window.partitionBy("key").orderBy(F.col("ts").asc_nulls_first(), "id")).cast("long"))
    got = number_within(df, "key", ["ts", "id"], "n")  # 1M rows per chunk: nothing is hot
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())
    prev = previous_within(df, "key", ["ts", "id"], ["v"])
    want_prev = df.withColumn("prev_v", F.lag("v").over(
        Window.partitionBy("key").orderBy(F.col("ts").asc_nulls_first(), "id")))
    assert sorted(prev.select("id", "prev_v").collect()) == sorted(want_prev.select("id", "prev_v").collect())
