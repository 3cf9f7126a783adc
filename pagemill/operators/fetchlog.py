"""Fetch-log analytics: N8 labels, W1 retry plan, A2-A4, A6-A8.

Skew: one URL may hold a third of all attempts.  Everything except the
full retry numbering is a plain aggregate with map-side partial combine.
``retry_plan`` numbers every error of a URL, which needs order within the
URL; it goes through ``plans.ordered.number_within`` (range-partitioned, so
a hot URL is split over many tasks).  The retry counts (A6, A7) do not need
the numbering at all: the first ``max_retries`` errors of a URL are retried,
so per-URL error counts suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fetch import ERROR_LABELS, classify_error, per_second, retry_backoff, success_rate
from ..plans.ordered import number_within

# Default latency histogram upper bounds in seconds (+Inf last).
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf")]

# Request phases.
PHASES = ["started", "success", "error"]


def is_error() -> Column:
    """An attempt failed: a recorded error, or an HTTP status >= 400."""
    return F.col("error_kind").isNotNull() | (F.coalesce(F.col("status"), F.lit(0)) >= 400)


def classify_errors(log: DataFrame) -> DataFrame:
    """N8 over the log: every attempt with ``is_error`` and ``error_type``
    (NULL for successful attempts)."""
    err = is_error()
    return log.select("attempt_id", "url", "status", "error_kind", err.alias("is_error"),
                      F.when(err, classify_error("error_kind", "status")).alias("error_type"))


def errors_by_type(log: DataFrame) -> DataFrame:
    """A2: ``(error_type, n_errors)``."""
    return log.filter(is_error()) \
        .groupBy(classify_error("error_kind", "status").alias("error_type")) \
        .agg(F.count(F.lit(1)).alias("n_errors"))


def requests_by_phase(log: DataFrame) -> DataFrame:
    """A3: ``(phase, n_requests)``: every attempt is started, then counted once
    as success or error.  One aggregate row, unpivoted: no row blow-up."""
    agg = log.agg(F.count(F.lit(1)).alias("started"),
                  F.count_if(~is_error()).alias("success"),
                  F.count_if(is_error()).alias("error"))
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("phase"), F.col(p).cast("long").alias("n_requests")) for p in PHASES])))


def latency_histogram(log: DataFrame) -> DataFrame:
    """A4: cumulative histogram of response latency.

    Only attempts that got a response (status > 0) are observed.  Output
    ``(le, cumulative_count, sum_s, count)``, ``le = inf`` for +Inf.
    """
    obs = log.filter(F.coalesce(F.col("status"), F.lit(0)) > 0)
    d = F.col("duration_s")
    aggs = [F.count_if(d <= F.lit(le)).alias(f"b{i}") for i, le in enumerate(LATENCY_BUCKETS)]
    one = obs.agg(*aggs, F.sum(d).alias("sum_s"), F.count(F.lit(1)).alias("count"))
    rows = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"b{i}").cast("long").alias("cumulative_count"))
                     for i, le in enumerate(LATENCY_BUCKETS)])
    return one.select(F.inline(rows), F.coalesce(F.round("sum_s", 6), F.lit(0.0)).alias("sum_s"),
                      F.col("count").cast("long").alias("count"))


def retry_plan(log: DataFrame, max_retries: int = 2, base_ms: int = 200, max_ms: int = 2000) -> DataFrame:
    """The n-th error of a URL (by attempt time, then id) is scheduled
    for retry iff n <= max_retries (0 disables), after ``retry_backoff(n)``.

    Output: ``attempt_id, url, attempt_ts, error_type, attempt, scheduled,
    backoff_ms, retry_at``.
    """
    errs = log.filter(is_error()).select(
        "attempt_id", "url", "attempt_ts", classify_error("error_kind", "status").alias("error_type"))
    numbered = number_within(errs, "url", ["attempt_ts", "attempt_id"], "attempt")
    scheduled = (F.lit(max_retries) > 0) & (F.col("attempt") <= F.lit(max_retries))
    backoff = F.when(scheduled, retry_backoff(F.col("attempt"), F.lit(base_ms), F.lit(max_ms)))
    return numbered.select(
        "attempt_id", "url", "attempt_ts", "error_type", "attempt", scheduled.alias("scheduled"),
        backoff.alias("backoff_ms"),
        F.when(scheduled, F.col("attempt_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff / 1000.0))
        .alias("retry_at"))


def _errors_per_url(log: DataFrame) -> DataFrame:
    return log.filter(is_error()).groupBy("url").agg(F.count(F.lit(1)).alias("n_errors"))


def retries_total(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """Number of scheduled retries = sum over URLs of min(errors, cap)."""
    per = _errors_per_url(log)
    return per.agg(F.coalesce(F.sum(F.least("n_errors", F.lit(max(max_retries, 0)))), F.lit(0))
                   .cast("long").alias("retries_total"))


def failed_urls(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """URLs with errors that got no retry, ``(url, n_failed)``."""
    per = _errors_per_url(log)
    n = (F.col("n_errors") - F.least("n_errors", F.lit(max(max_retries, 0)))).cast("long")
    return per.select("url", n.alias("n_failed")).filter(F.col("n_failed") > 0)


def run_summary(log: DataFrame, item_stats: DataFrame, max_retries: int = 2) -> DataFrame:
    """One row: requests, errors, success rate, retries, failed entries,
    error map, validation map, start/end, duration and items per second.

    The log is read once: per URL (combined map-side) its requests, first and
    last attempt and errors per label, which reduce to one row.  That row and
    the item statistics are tagged, unioned and reduced by one conditional
    aggregate, so nothing is joined.
    """
    k = F.lit(max(max_retries, 0))
    label = F.when(is_error(), classify_error("error_kind", "status"))
    labels = [F.count_if(label == name).alias(f"_{name}") for name in ERROR_LABELS]
    per_url = log.groupBy("url").agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_error()).alias("_e"),
                                     F.min("attempt_ts").alias("_lo"), F.max("attempt_ts").alias("_hi"), *labels)
    total = per_url.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_e"), F.lit(0)).alias("e"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"),
        F.coalesce(F.sum(F.least("_e", k)), F.lit(0)).alias("retries"), F.coalesce(F.sum(F.col("_e") - F.least("_e", k)), F.lit(0)).alias("failed"),
        F.array(*[F.struct(F.lit(name).alias("error_type"), F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias("n_errors"))
                  for name in sorted(ERROR_LABELS)]).alias("types"))
    found = F.filter("types", lambda t: t["n_errors"] > 0)
    u = total.select(F.struct("n", "e", "lo", "hi", "retries", "failed", found.alias("types")).alias("log"),
                     F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("value")) \
        .unionByName(item_stats.select(F.lit(None).alias("log"), F.col("metric").alias("name"), F.col("value").cast("long").alias("value")))
    one = u.agg(
        F.max("log").alias("log"),
        F.coalesce(F.max(F.when(F.col("name") == "processed", F.col("value"))), F.lit(0)).alias("items_processed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name") != "processed", F.struct(
            F.col("name").alias("metric"), "value"))))).alias("validation_errors"))
    one = one.select(F.col("log.n").alias("total_requests"), F.col("log.e").alias("total_errors"), F.col("log.lo").alias("started_at"),
                     F.col("log.hi").alias("finished_at"), F.col("log.retries").cast("long").alias("retries"),
                     F.col("log.failed").cast("long").alias("failed_entries"), "items_processed",
                     F.map_from_entries("log.types").alias("errors_by_type"), "validation_errors")
    dur = (F.unix_micros(F.col("finished_at").cast("timestamp"))
           - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return one.select(
        F.col("total_requests").cast("long").alias("total_requests"),
        F.col("total_errors").cast("long").alias("total_errors"),
        F.round(success_rate("total_requests", "total_errors"), 2).alias("success_rate"),
        "retries", "failed_entries", "items_processed", "errors_by_type", "validation_errors",
        "started_at", "finished_at",
        F.coalesce(dur, F.lit(0.0)).alias("duration_s"),
        F.round(F.coalesce(per_second("items_processed", dur), F.lit(0.0)), 6).alias("items_per_second"))
