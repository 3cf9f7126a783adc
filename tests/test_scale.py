"""What crosses an exchange, how often an input is read and how a stream is dealt out."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import items as I
from pagemill.plans import queries as Q
from pagemill.streaming import keyindex, recency
from pagemill.streaming import pipeline as SP

from .fixtures import RAW_SCHEMA, raw


def counted(spark, rows):
    """A frame of ``rows`` and a counter of the rows that were read from it."""
    read = spark.sparkContext.accumulator(0)

    def count(row):
        read.add(1)
        return row
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), RAW_SCHEMA), read


def exchanged(df) -> int:
    """Rows that crossed an exchange when ``df`` was collected."""
    df.collect()

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        here = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return here + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


# --- tag_items ---------------------------------------------------------------

def test_tag_items_rows_cross_one_exchange(spark):
    rows = [raw(i, url=f"u{i // 2}", title=" " if i % 10 == 0 else "T") for i in range(200)]
    assert exchanged(I.tag_items(spark.createDataFrame(rows, RAW_SCHEMA))) == len(rows)


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_tag_items_hot_and_other_urls_alike(spark, block):
    """Null and empty URL, invalid first rows and repeated rows are tagged alike whether a URL is hot or not."""
    rows = [raw(1, url="h", title=" ")] + [raw(2 + i % 4, url="h") for i in range(12)] + [raw(3, url="c"), raw(3, url="c"), raw(1, url="c", rating="")]
    rows += [raw(7, url=None, price="POA"), raw(7, url="", price="POA"), raw(6, url=None, title=None), raw(None, url="n"), raw(0, url="n")]
    got = sorted((r.url is None, r.url or "", r.seq is None, r.seq or 0, r.outcome, r.price_unparseable)
                 for r in I.tag_items(spark.createDataFrame(rows, RAW_SCHEMA), emit_block=block).collect())
    dup, ok, bad = I.DUPLICATE, I.PROCESSED, I.INVALID
    want = [(False, "h", False, 1, bad, False), (False, "h", False, 2, ok, False)] + [(False, "h", False, 2, dup, False)] * 2
    want += [(False, "h", False, s, dup, False) for s in (3, 4, 5) for _ in range(3)]
    want += [(False, "c", False, 1, bad, False), (False, "c", False, 3, ok, False), (False, "c", False, 3, dup, False)]
    want += [(True, "", False, 6, bad, False), (True, "", False, 7, ok, True), (False, "", False, 7, dup, False)]
    want += [(False, "n", True, 0, ok, False), (False, "n", False, 0, dup, False)]
    assert got == sorted(want)


# --- output_validation ---------------------------------------------------------

def test_output_validation_prepares_the_items_once(spark, monkeypatch):
    rows = [raw(i, url=f"u{i // 2}") for i in range(40)]
    frame, read = counted(spark, rows)
    monkeypatch.setattr(Q, "_raw", lambda spark_, sf_dir: frame)
    got = {(r.format, r.output): (r.first_run, r.refused, r.n_items, r.n_urls) for r in Q.QUERIES["output_validation"](spark, "").collect()}
    assert got == {("csv", "csv"): (20, False, 0, 0), ("json", "json"): (20, True, 20, 20), ("dual", "csv"): (20, True, 0, 0), ("dual", "json"): (20, True, 20, 20)}
    assert read.value == len(rows)


# --- recency and deterministic sinks -------------------------------------------

@pytest.mark.parametrize("kind", ["recency", "deterministic"])
def test_a_batch_is_read_once(spark, tmp_dir, kind):
    out = f"{tmp_dir}/out"
    sink = SP.deterministic_dedup_sink(out) if kind == "deterministic" else recency.recency_dedup_sink(f"{tmp_dir}/seen", SP.parquet_batch_sink(out), 1000)
    for n in range(3):
        rows = [raw(10 * n + i, url=f"u{10 * n + i - n}") for i in range(10)]
        frame, read = counted(spark, rows)
        sink(frame, n)
        assert read.value == len(rows)
    assert sorted(int(r.url[1:]) for r in spark.read.parquet(out).collect()) == list(range(28))
    assert not glob.glob(f"{tmp_dir}/**/_staged-*", recursive=True)


def test_eviction_orders_few_rows(spark):
    table = spark.range(20000).select(F.col("id").alias("at"), F.concat(F.lit("u"), "id").alias("url"), F.lit(7).cast("long").alias("seen"))
    assert 50 <= recency._latest(table, 20000, 50).count() <= 60
    assert sorted(r["at"] for r in recency.evict(table, 50).collect()) == list(range(19950, 20000))
    same = table.withColumn("at", F.lit(0).cast("long"))
    assert recency.evict(same, 50).count() == 50
    assert {r.url for r in recency.evict(same, 2).collect()} == {"u0", "u1"}


def test_index_compares_segments_no_larger_than_the_batch_whole(spark, tmp_dir, monkeypatch):
    index = keyindex.KeyIndex(spark, f"{tmp_dir}/index")

    def urls(first, last):
        return spark.range(first, last).select(F.concat(F.lit("u"), "id").alias("url"))
    index.add(urls(0, 3000), 0, 0)
    index.add(urls(3000, 6000), 1, 1)
    monkeypatch.setattr(keyindex.KeyIndex, "candidates", lambda *_: pytest.fail("tested against a filter"))
    assert sorted(int(r.url[1:]) for r in index.published(urls(2500, 8000), 2).collect()) == list(range(2500, 6000))
    assert index.published(urls(2500, 8000), 1).count() == 500


# --- input and state of the streams ----------------------------------------------

def test_staged_files_do_not_grow_in_number_and_are_read_by_many_tasks(spark, monkeypatch):
    import pyarrow.parquet as pq
    cores = spark.sparkContext.defaultParallelism
    frame = spark.range(0, 100_000, 1, 5 * cores).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("url"))
    monkeypatch.setattr(Q, "_raw", lambda spark_, sf_dir: frame)
    monkeypatch.setattr(Q, "STREAM_BLOCK", 1 << 17, raising=False)
    files = glob.glob(f"{Q._stage_stream_input(spark, '')}/*.parquet")
    assert len(files) <= cores and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 100_000


def test_state_partitions_are_bounded_by_the_cores(spark, monkeypatch):
    frame = spark.createDataFrame([raw(i, url=f"u{i // 2}") for i in range(20)], RAW_SCHEMA).coalesce(1)
    monkeypatch.setattr(Q, "_raw", lambda spark_, sf_dir: frame)
    monkeypatch.setattr(Q, "STATE_PER_CORE", 1, raising=False)
    kept, path = [], Q.scratch_path
    monkeypatch.setattr(Q, "scratch_path", lambda *a: kept.append(path(*a)) or kept[-1])
    key, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(3 * cores))
    try:
        assert Q.QUERIES["stream_dedup"](spark, "").count() == 10
        assert spark.conf.get(key) == str(3 * cores)
    finally:
        spark.conf.set(key, before)
    (ck,) = [p for p in kept if "stream-ck" in p]
    assert len([d for d in os.listdir(f"{ck}/state/0") if d.isdigit()]) == cores
