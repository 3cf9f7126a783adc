"""N8/W1/A2-A8 on small fetch logs."""

from __future__ import annotations

import datetime as dt

from pagemill.operators import fetchlog as L
from pagemill.operators import items as I

from .fixtures import FETCH_SCHEMA, RAW_SCHEMA, raw

T = dt.datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(rows, FETCH_SCHEMA)


def att(i, url, status=200, kind=None, sec=0, d=0.1):
    return (i, url, T + dt.timedelta(seconds=sec), status, kind, d)


def test_retry_cap_two_of_three(spark):
    rows = [att(1, "u", 500, "http", 0), att(2, "u", 500, "http", 1), att(3, "u", 500, "http", 2)]
    plan = L.retry_plan(log(spark, rows), 2, 200, 500).orderBy("attempt").collect()
    assert [r["scheduled"] for r in plan] == [True, True, False]
    assert [r["backoff_ms"] for r in plan] == [200, 400, None]
    assert plan[0]["retry_at"] == T + dt.timedelta(milliseconds=200)
    assert L.retries_total(log(spark, rows), 2).first()[0] == 2
    assert [(r["url"], r["n_failed"]) for r in L.failed_urls(log(spark, rows), 2).collect()] == [("u", 1)]
    assert L.retries_total(log(spark, rows), 0).first()[0] == 0


def test_errors_and_phases(spark):
    rows = [att(1, "a"), att(2, "b", 403, "http"), att(3, "c", 404, "http"), att(4, "d", 429, "http"),
            att(5, "e", 0, "deadline"), att(6, "f", 0, "op_error")]
    by = {r["error_type"]: r["n_errors"] for r in L.errors_by_type(log(spark, rows)).collect()}
    assert by == {"forbidden": 1, "not_found": 1, "rate_limited": 1, "timeout": 1, "connection": 1}
    ph = {r["phase"]: r["n_requests"] for r in L.requests_by_phase(log(spark, rows)).collect()}
    assert ph == {"started": 6, "success": 1, "error": 5}


def test_latency_histogram_cumulative(spark):
    rows = [att(1, "a", d=0.004), att(2, "b", d=0.3), att(3, "c", d=20.0), att(4, "d", 0, "deadline", d=5.0)]
    h = {r["le"]: r["cumulative_count"] for r in L.latency_histogram(log(spark, rows)).collect()}
    assert h[0.005] == 1 and h[0.25] == 1 and h[0.5] == 2 and h[10.0] == 2 and h[float("inf")] == 3
    one = L.latency_histogram(log(spark, rows)).first()
    assert one["count"] == 3 and abs(one["sum_s"] - 20.304) < 1e-9


def test_run_summary_success_rate(spark):
    """requests 5, errors 1 -> 80.00 %; retries and failures from the plan."""
    rows = [att(1, "a", sec=0), att(2, "b", sec=1), att(3, "c", sec=2), att(4, "d", sec=3),
            att(5, "e", 500, "http", sec=4)]
    items = spark.createDataFrame([raw(1, url="x"), raw(2, url="y"), raw(3, url="z")], RAW_SCHEMA)
    s = L.run_summary(log(spark, rows), I.pipeline_stats(items), 2).first()
    assert (s["total_requests"], s["total_errors"], s["success_rate"]) == (5, 1, 80.0)
    assert (s["retries"], s["failed_entries"], s["items_processed"]) == (1, 0, 3)
    assert s["errors_by_type"] == {"other": 1} and s["validation_errors"] == {}
    assert s["duration_s"] == 4.0 and s["items_per_second"] == 0.75
