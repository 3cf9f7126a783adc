"""The batch run (section 3.1 of the survey): options -> lazy plan -> staged
write with in-pass statistics -> validation -> publish -> run summary.

Input is a table of already fetched pages (and optionally the fetch log);
the network crawler itself is not Spark work.  The crawl rules become
DataFrame operators:

T2 page de-dup -> F2 allowed host -> F3 robots rules -> T1/F6 pages reachable
from the seed in at most ``max_pages`` hops -> E0 extraction -> C1 items with
the A1 counters in the same pass as the write -> K1-K6 sink -> A8 summary and
the retries that the back-off options ask for.

Usage::

    python -m pagemill.plans.run --pages PATH [--fetch-log PATH] [--robots PATH]
        [--output books.csv] [--format csv|json|dual] [--base-url URL] [--max-pages N]
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import fetchlog as L
from ..operators import filters as R
from ..functions.urls import url_host
from ..operators import items as I
from ..operators.items import dedup_first
from ..options import JobOptions
from ..session import input_bytes, size_shuffle_partitions
from ..sinks import writers as S
from ..sources import tables as src
from .traverse import follow_next


def crawl_pages(pages: DataFrame, opts: JobOptions, robots: DataFrame | None = None,
                spec: X.ExtractSpec = X.CATALOGUE, seeds: DataFrame | None = None) -> DataFrame:
    """Pages the crawl would process: de-duplicated, on the seeds' hosts,
    allowed by robots rules (when respected) and reachable from a seed in at
    most ``max_pages`` pages.  ``seeds`` has ``url`` (default: the base URL).

    The base URL's host is a filter of the scan.  Everything else is decided on URLs,
    64-bit hashes of the fetches and link rows, which are made where markup is read; markup
    is joined to the decision once, and crosses no other exchange.
    """
    spark = pages.sparkSession
    # a fetch is known by its place and markup: the same page may have been fetched twice under one id
    place = [c for c in ("page_id", "url", "fetched_at") if c in pages.columns]
    stored = pages.withColumn("_fetch", F.xxhash64(*place, "html"))
    if seeds is None:
        seeds = spark.createDataFrame([(opts.base_url,)], "url string")
        own = stored = stored.filter(url_host("url") == opts.allowed_host)
    else:
        own = R.allowed_domains(stored, seeds.select(url_host("url").alias("host")))
    kept = dedup_first(own.select(*place, "_fetch"), "url", [*place, "_fetch"]).select("page_id", "url", "_fetch")
    if robots is not None and opts.respect_robots_txt:
        kept = R.robots_filter(kept, robots)
    # pages of other hosts are none of the kept ones
    links = X.next_links(stored, spec, keep=("_fetch",)).join(kept, ["url", "_fetch"], "left_semi").select("url", "next_url")
    reached = follow_next(links, seeds, opts.max_pages).select("url").distinct()
    same = stored.join(kept.join(reached, "url", "left_semi"), ["url", "_fetch"], "left_semi")
    # what is left of a URL is one fetch, perhaps stored twice: by both columns, as the join has dealt the markup by them
    return same.dropDuplicates(["url", "_fetch"]).select(*pages.columns)


def _stats_frame(spark: SparkSession, counts: dict) -> DataFrame:
    rows = [(I.PROCESSED, int(counts.get(I.PROCESSED, 0)))]
    rows += [(k, int(counts.get(k, 0))) for k in (I.INVALID, I.DUPLICATE, I.UNPARSEABLE) if counts.get(k, 0)]
    return spark.createDataFrame(rows, "metric string, value long")


def run(spark: SparkSession, opts: JobOptions, pages: DataFrame | None = None,
        raw_items: DataFrame | None = None, fetch_log: DataFrame | None = None,
        robots: DataFrame | None = None, spec: X.ExtractSpec = X.CATALOGUE) -> dict:
    """Run one batch job and return the summary as a dict (A8 fields plus the
    written row counts).  Raises on invalid options, failed writes and failed
    output validation; the previous output then stays in place."""
    opts.validate()
    t0 = time.time()
    if raw_items is None:
        if pages is None:
            raise ValueError("pages or raw_items is required")
        raw_items = X.extracted_raw_items(crawl_pages(pages, opts, robots, spec), spec)
    raw_items = src.submit_items(raw_items)  # F5
    seen = Observation("pipeline")
    written = S.write_items(I.prepare_counted(raw_items, seen), opts.output_format, opts.output_file)
    counts = {k: int(seen.get.get(k) or 0) for k in (I.PROCESSED, I.INVALID, I.DUPLICATE, I.UNPARSEABLE)}
    elapsed = time.time() - t0
    summary = {"written": written, "pipeline": dict(counts), "elapsed_s": round(elapsed, 3),
               "items_per_second": round(counts.get(I.PROCESSED, 0) / elapsed, 3) if elapsed > 0 else 0.0}
    if fetch_log is not None:
        row = L.run_summary(fetch_log, _stats_frame(spark, counts), opts.max_retries).first()
        summary["crawl"] = {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in row.asDict().items()}
        plan = L.retry_plan(fetch_log, opts.max_retries, opts.retry_backoff_ms, opts.retry_backoff_max_ms)
        row = plan.agg(F.count_if("scheduled").alias("scheduled"), F.coalesce(F.sum("backoff_ms"), F.lit(0)).alias("backoff_ms"),
                       F.max("retry_at").alias("last_retry_at")).first()
        summary["retries"] = {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in row.asDict().items()}
    return summary


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pagemill-run")
    ap.add_argument("--pages")
    ap.add_argument("--raw-items")
    ap.add_argument("--fetch-log")
    ap.add_argument("--robots")
    ap.add_argument("--output")
    ap.add_argument("--format")
    ap.add_argument("--base-url")
    ap.add_argument("--max-pages", type=int)
    a = ap.parse_args(argv)
    over = {k: v for k, v in {"output_file": a.output, "output_format": a.format, "base_url": a.base_url,
                              "max_pages": a.max_pages}.items() if v is not None}
    try:
        opts = replace(JobOptions.from_env(), **over).validate()
    except ValueError as ex:
        print(json.dumps({"error": f"invalid options: {ex}"}))
        return 2
    spark = SparkSession.builder.appName("pagemill-run").getOrCreate()
    inputs = [x for x in (a.pages, a.raw_items, a.fetch_log) if x]
    size_shuffle_partitions(spark, input_bytes(spark, inputs))
    pages = src.read_pages(spark, a.pages) if a.pages else None
    raw = src.read_raw_items(spark, a.raw_items) if a.raw_items else None
    log = src.read_fetch_log(spark, a.fetch_log) if a.fetch_log else None
    robots = spark.read.schema("host string, allow boolean, path_prefix string").parquet(a.robots) \
        if a.robots else None
    try:
        print(json.dumps(run(spark, opts, pages, raw, log, robots), default=str))
        return 0
    except Exception as ex:  # noqa: BLE001
        print(json.dumps({"error": f"{type(ex).__name__}: {ex}"}))
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
