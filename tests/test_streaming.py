"""ST1-ST7 with file sources, availableNow triggers and checkpoints."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException

from pagemill.streaming import pipeline as SP

from .fixtures import RAW_SCHEMA, raw


def stage(spark, path, rows):
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_dedup_across_batches_and_restart(spark, tmp_dir):
    src, sink, ck = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/ck"
    stage(spark, src, [raw(1, url="a"), raw(2, url="b"), raw(3, url="a", title=" ")])
    stage(spark, src, [raw(4, url="a"), raw(5, url="c")])
    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src, 1)), SP.parquet_batch_sink(sink), ck)
    SP.drain(q, 120)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]
    prog = SP.progress(q)
    assert prog.batches >= 2 and prog.processed == 3
    # restart from the checkpoint: only new files are read, old URLs stay known
    stage(spark, src, [raw(6, url="b"), raw(7, url="d")])
    q2 = SP.start(SP.prepare_stream(SP.item_stream(spark, src, 1)), SP.parquet_batch_sink(sink), ck)
    SP.drain(q2, 120)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c", "d"]


def test_sink_error_surfaces(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    stage(spark, src, [raw(1, url="a")])

    def failing(df, batch_id):
        raise RuntimeError("disk full")

    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src)), failing, f"{tmp_dir}/ck")
    with pytest.raises(StreamingQueryException):
        SP.drain(q, 120)


def test_replay_of_a_committed_batch_keeps_the_state(spark, tmp_dir):
    """A crash between the commit record and the end of the batch: later batches still know its URLs."""
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/items.csv", f"{tmp_dir}/ck"
    stage(spark, src, [raw(1, url="a"), raw(2, url="b")])
    sink = SP.items_batch_sink(out)

    def crashing(df, batch_id):
        sink(df, batch_id)
        raise OSError("driver lost")

    with pytest.raises(StreamingQueryException):
        SP.drain(SP.start(SP.prepare_stream(SP.item_stream(spark, src, 1)), crashing, ck), 120)
    stage(spark, src, [raw(3, url="b"), raw(4, url="c")])
    SP.drain(SP.start(SP.prepare_stream(SP.item_stream(spark, src, 1)), sink, ck), 120)
    assert sorted(r.url for r in SP.S.read_csv_items(spark, out).collect()) == ["a", "b", "c"]


def test_bounded_dedup_mode(spark, tmp_dir):
    src, sink = f"{tmp_dir}/src", f"{tmp_dir}/sink"
    stage(spark, src, [raw(1, url="a"), raw(2, url="a"), raw(3, url="b")])
    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src), "bounded", "1 hour"),
                 SP.parquet_batch_sink(sink), f"{tmp_dir}/ck")
    SP.drain(q, 120)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        SP.prepare_stream(SP.item_stream(spark, src), "lru")


def test_deterministic_winner_sink(spark, tmp_dir):
    src, sink = f"{tmp_dir}/src", f"{tmp_dir}/sink"
    stage(spark, src, [raw(5, url="a", title="late"), raw(1, url="a", title="early"), raw(2, url="b", rating="")])
    stage(spark, src, [raw(0, url="a", title="next batch"), raw(3, url="b", title="b ok")])
    q = SP.start(SP.item_stream(spark, src, 1), SP.deterministic_dedup_sink(sink), f"{tmp_dir}/ck")
    SP.drain(q, 120)
    got = sorted((r["url"], r["title"]) for r in spark.read.parquet(sink).collect())
    assert got == [("a", "early"), ("b", "b ok")]
    # replaying a batch rewrites the same rows
    batch0 = sorted(map(tuple, spark.read.parquet(f"{sink}/batch_id=0").collect()))
    SP.deterministic_dedup_sink(sink)(spark.read.parquet(src).filter("seq in (1, 2, 5)"), 0)
    assert sorted(map(tuple, spark.read.parquet(f"{sink}/batch_id=0").collect())) == batch0


def test_bounded_mode_loses_no_old_row(spark, tmp_dir):
    """The second batch is nine days older than the first one: its URL is still written."""
    import datetime as dt
    src, sink = f"{tmp_dir}/src", f"{tmp_dir}/sink"
    stage(spark, src, [raw(1, url="new", ts=dt.datetime(2024, 1, 10))])
    stage(spark, src, [raw(2, url="old", ts=dt.datetime(2024, 1, 1)), raw(3, url="new", ts=dt.datetime(2024, 1, 1))])
    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src, 1), "bounded", "1 hour"), SP.parquet_batch_sink(sink), f"{tmp_dir}/ck")
    SP.drain(q, 120)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["new", "old"]
    p = SP.progress(q)
    assert (p.processed, p.duplicate_url, p.input_rows) == (2, 1, 3)


@pytest.mark.parametrize("fmt", ["csv", "json", "dual"])
def test_stream_job_from_pages(spark, tmp_dir, fmt):
    from pagemill.options import JobOptions
    from pagemill.plans.stream_run import run_stream
    from pagemill.sinks import writers as S

    from .fixtures import PAGES_SCHEMA, catalogue_pages
    for row in catalogue_pages(3) + catalogue_pages(1):
        spark.createDataFrame([row], PAGES_SCHEMA).write.mode("append").parquet(f"{tmp_dir}/pages")
    opts = JobOptions(output_file=f"{tmp_dir}/out/b.csv", output_format=fmt, pipeline_buffer_size=64, parallelism=2)
    s = run_stream(spark, opts, f"{tmp_dir}/pages", f"{tmp_dir}/ck", kind="pages", timeout_s=200)
    assert (s["processed"], s["duplicate_url"], s["invalid_record"], s["batches"] >= 4) == (60, 20, 0, True)
    if fmt != "json":
        assert S.read_csv_items(spark, f"{tmp_dir}/out/b.csv").count() == 60
    if fmt != "csv":
        assert S.read_jsonl_items(spark, f"{tmp_dir}/out/b.json" if fmt == "dual" else f"{tmp_dir}/out/b.csv").count() == 60


def test_stream_job_without_items_fails_json(spark, tmp_dir):
    from pagemill.options import JobOptions
    from pagemill.plans.stream_run import run_stream
    from pagemill.sinks.writers import OutputValidationError
    stage(spark, f"{tmp_dir}/src", [raw(1, title=" ")])
    opts = JobOptions(output_file=f"{tmp_dir}/o.json", output_format="json", parallelism=2)
    with pytest.raises(OutputValidationError):
        run_stream(spark, opts, f"{tmp_dir}/src", f"{tmp_dir}/ck", timeout_s=200)


def test_cancel_and_resume(spark, tmp_dir):
    src, sink, ck = f"{tmp_dir}/src", f"{tmp_dir}/sink", f"{tmp_dir}/ck"
    stage(spark, src, [raw(1, url="a")])
    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src)), SP.parquet_batch_sink(sink), ck, available_now=False)
    q.processAllAvailable()
    SP.cancel(q)
    assert not q.isActive
    stage(spark, src, [raw(2, url="a"), raw(3, url="b")])
    q = SP.start(SP.prepare_stream(SP.item_stream(spark, src)), SP.parquet_batch_sink(sink), ck)
    SP.drain(q, 120)
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]
