"""The driver query map: one callable per operator, ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (through the views in
``sources.driver``) over their whole extent.  ``follow_next`` and
``chain_page_count`` walk every chain to its end, their ``_all`` forms with the
job's default cap on pages.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fetch import retry_backoff
from ..functions.urls import absolute_url, url_host, url_path
from ..operators import extract as X
from ..operators import fetchlog as L
from ..operators import filters as R
from ..operators import history as H
from ..operators import items as I
from ..options import JobOptions
from ..session import ensure_core_conf, scratch_path
from ..sinks import manifest as M
from ..sinks import writers as S
from ..streaming import pipeline as SP
from ..streaming.recency import recency_dedup_sink
from ..sources import driver as D
from ..sources.tables import submit_items
from .run import crawl_pages
from .stream_run import run_stream
from .traverse import chain_page_count, follow_next

OPTS = JobOptions()
TO_THE_END = 1 << 30  # pages of a chain: path doubling stops where chains end

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_core_conf(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = name
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        return wrapped
    return deco


@query("prepare_items")
def q_prepare_items(spark, sf_dir):
    """C1 over raw_items <- lineitem."""
    return I.prepare_items(D.raw_items(spark, sf_dir))


# --- raw_items <- lineitem -------------------------------------------------

def _raw(spark, sf_dir):
    return D.raw_items(spark, sf_dir)


@query("validate_items")
def q_validate_items(spark, sf_dir):
    """every raw row with its first failing check (NULL = valid)."""
    return I.validate_items(_raw(spark, sf_dir))


@query("normalize_price")
def q_normalize_price(spark, sf_dir):
    """N2 on every raw price."""
    r = _raw(spark, sf_dir)
    return r.select("seq", "url", "price", T.normalize_price("price").alias("price_normalized"))


@query("parse_price")
def q_parse_price(spark, sf_dir):
    """N3 on every raw price (NULL = unparseable)."""
    r = _raw(spark, sf_dir)
    return r.select("seq", "url", "price", T.parse_price("price").alias("price_value"))


@query("normalize_availability")
def q_normalize_availability(spark, sf_dir):
    """N4 on every raw availability text."""
    r = _raw(spark, sf_dir)
    return r.select("seq", "url", "availability",
                    T.normalize_availability("availability").alias("availability_normalized"))


@query("rating_to_numeric")
def q_rating_to_numeric(spark, sf_dir):
    """N5 on every raw rating text."""
    r = _raw(spark, sf_dir)
    return r.select("seq", "url", "rating", T.rating_to_numeric("rating").alias("rating_numeric"))


@query("dedup_items")
def q_dedup_items(spark, sf_dir):
    """D1 after F1: first valid record per URL."""
    return I.dedup_first(I.valid_items(_raw(spark, sf_dir)))


@query("tag_items")
def q_tag_items(spark, sf_dir):
    """Every raw row with its outcome."""
    return I.tag_items(_raw(spark, sf_dir))


@query("pipeline_stats")
def q_pipeline_stats(spark, sf_dir):
    """A1: processed and validation counters."""
    return I.pipeline_stats(_raw(spark, sf_dir))


@query("catalog_rollup")
def q_catalog_rollup(spark, sf_dir):
    """Price statistics by rating and availability."""
    return H.catalog_rollup(_raw(spark, sf_dir))


@query("price_changes")
def q_price_changes(spark, sf_dir):
    """R2: consecutive price changes per URL."""
    return H.price_changes(_raw(spark, sf_dir))


CRAWL_SPLIT = "1998-01-01"


@query("crawl_diff")
def q_crawl_diff(spark, sf_dir):
    """Previous crawl = scraped before 1998, current = the rest."""
    r = _raw(spark, sf_dir)
    cut = F.lit(CRAWL_SPLIT).cast("timestamp_ntz")
    return H.crawl_diff(r.filter(F.col("scraped_at") < cut), r.filter(F.col("scraped_at") >= cut))


# --- fetch_log <- events ---------------------------------------------------

def _log(spark, sf_dir):
    return D.fetch_log(spark, sf_dir)


@query("classify_errors")
def q_classify_errors(spark, sf_dir):
    """N8 on every attempt."""
    return L.classify_errors(_log(spark, sf_dir))


@query("errors_by_type")
def q_errors_by_type(spark, sf_dir):
    """A2."""
    return L.errors_by_type(_log(spark, sf_dir))


@query("requests_by_phase")
def q_requests_by_phase(spark, sf_dir):
    """A3."""
    return L.requests_by_phase(_log(spark, sf_dir))


@query("latency_histogram")
def q_latency_histogram(spark, sf_dir):
    """A4."""
    return L.latency_histogram(_log(spark, sf_dir))


@query("retry_plan")
def q_retry_plan(spark, sf_dir):
    """W1 with the default options (2 retries, 200 ms base, 2 s cap)."""
    return L.retry_plan(_log(spark, sf_dir), OPTS.max_retries, OPTS.retry_backoff_ms, OPTS.retry_backoff_max_ms)


@query("retry_backoff")
def q_retry_backoff(spark, sf_dir):
    """N9 for every error's attempt number, base 200 ms, cap 500 ms."""
    plan = L.retry_plan(_log(spark, sf_dir), 0)
    return plan.select("attempt_id", "attempt",
                       retry_backoff(F.col("attempt"), F.lit(200), F.lit(500)).alias("backoff_ms"))


@query("retries_total")
def q_retries_total(spark, sf_dir):
    """A6."""
    return L.retries_total(_log(spark, sf_dir), OPTS.max_retries)


@query("failed_urls")
def q_failed_urls(spark, sf_dir):
    """A7."""
    return L.failed_urls(_log(spark, sf_dir), OPTS.max_retries)


@query("run_summary")
def q_run_summary(spark, sf_dir):
    """A8 over the fetch log and the item pipeline."""
    return L.run_summary(_log(spark, sf_dir), I.pipeline_stats(_raw(spark, sf_dir)), OPTS.max_retries)


# --- pages -----------------------------------------------------------------

@query("extract_items")
def q_extract_items(spark, sf_dir):
    """E0 with the article spec (title = h1, URL = page)."""
    it = X.extract_items(D.pages(spark, sf_dir), X.ARTICLES)
    return it.drop("scraped_at")


@query("items_scraped")
def q_items_scraped(spark, sf_dir):
    """A5."""
    return X.items_scraped(X.extract_items(D.pages(spark, sf_dir), X.ARTICLES))


@query("resolve_links")
def q_resolve_links(spark, sf_dir):
    """E8 on every list link of every page."""
    return X.links(D.pages(spark, sf_dir), "li a")


@query("next_links")
def q_next_links(spark, sf_dir):
    """Next links; the driver pages chain by host order (no li.next)."""
    ln = D.next_chain_links(spark, sf_dir)
    html_links = X.next_links(D.pages(spark, sf_dir)).select("url", "next_url")
    both = ln.unionByName(html_links)
    return both.select("url", absolute_url(F.col("url"), F.col("next_url")).alias("next_url"))


@query("dedup_pages")
def q_dedup_pages(spark, sf_dir):
    """T2 on pages unioned with a re-fetch of every page."""
    p = D.pages(spark, sf_dir).select("page_id", "url")
    again = p.select((F.col("page_id") + 1000000000).alias("page_id"), "url")
    return R.dedup_pages(p.unionByName(again))


@query("allowed_domains")
def q_allowed_domains(spark, sf_dir):
    """pages on hosts that serve English pages."""
    p = D.pages(spark, sf_dir).select("page_id", "url")
    hosts = p.filter(url_path("url").startswith("/en/")).select(url_host("url").alias("host"))
    return R.allowed_domains(p, hosts)


@query("robots_filter")
def q_robots_filter(spark, sf_dir):
    """F3 with per-host rules derived from the pages."""
    p = D.pages(spark, sf_dir).select("page_id", "url")
    return R.robots_filter(p, D.robots_rules(spark, sf_dir))


@query("robots_patterns")
def q_robots_patterns(spark, sf_dir):
    """F3 with patterns: ``*``, ``$``, and a tie that allow wins."""
    p = D.pages(spark, sf_dir).select("page_id", "url")
    return R.robots_filter(p, D.robots_patterns(spark, sf_dir))


@query("resolve_references")
def q_resolve_references(spark, sf_dir):
    """E8 on well-formed and malformed references of every kind."""
    r = D.odd_references(spark, sf_dir)
    return r.select("page_id", "url", "ref", absolute_url(F.col("url"), F.col("ref")).alias("abs_url"))


@query("follow_next")
def q_follow_next(spark, sf_dir):
    """T1 over every host chain, to its end."""
    return follow_next(D.next_chain_links(spark, sf_dir), D.chain_seeds(spark, sf_dir), TO_THE_END)


@query("follow_next_all")
def q_follow_next_all(spark, sf_dir):
    """T1 over every host chain with the job's default cap."""
    return follow_next(D.next_chain_links(spark, sf_dir), D.chain_seeds(spark, sf_dir), OPTS.max_pages)


# --- sinks and streams (write to a new folder under the checkpoint dir) -----

def _text_items(df):
    """Common text projection of read-back items (CSV and JSON alike)."""
    return df.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "price", "rating", "availability",
                                                             "image_url", "url")],
        F.col("rating_numeric").cast("string").alias("rating_numeric"),
        F.col("scraped_at").alias("scraped_at"), F.col("price_numeric").alias("price_numeric"))


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """K1 + K4: prepared items published as CSV, read back as text."""
    out = scratch_path(spark, "csv")
    S.write_csv(I.prepare_items(_raw(spark, sf_dir)), out)
    return _text_items(S.read_csv_items(spark, out))


@query("jsonl_roundtrip")
def q_jsonl_roundtrip(spark, sf_dir):
    """K2 + K4: prepared items published as JSON Lines, read back typed."""
    out = scratch_path(spark, "jsonl")
    S.write_jsonl(I.prepare_items(_raw(spark, sf_dir)), out)
    back = S.read_jsonl_items(spark, out)
    return back.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "scraped_at" else F.col(c)
                         for c in back.columns])


@query("dual_roundtrip")
def q_dual_roundtrip(spark, sf_dir):
    """K3: one prepared frame to both formats; both read back as text rows."""
    base = scratch_path(spark, "dual")
    csv_path = base + ".csv"
    S.write_items(I.prepare_items(_raw(spark, sf_dir)), "dual", csv_path)
    csv = _text_items(S.read_csv_items(spark, csv_path))
    js = S.read_jsonl_items(spark, S.dual_json_path(csv_path))
    js = _text_items(js.select(*[c for c in js.columns if c not in ("scraped_at", "price_numeric")],
                               T.format_rfc3339("scraped_at").alias("scraped_at"),
                               T.format_2dp("price_numeric").alias("price_numeric")))
    return csv.withColumn("format", F.lit("csv")).unionByName(js.withColumn("format", F.lit("json")))


def _drain(started) -> None:
    """Wait until all input is written; the ended query's listener goes."""
    try:
        SP.drain(started, None)
    finally:
        SP.forget(started)


STREAM_BLOCK = 4 << 20  # bytes of a row group, of which a task reads one or more
STATE_PER_CORE = 4  # state partitions, at most


def _written_stream(raw, src: str) -> None:
    """Raw items or pages as files of a stream, a file per core at most, so that
    the number of micro-batches does not grow with the table; their row groups
    are small, so that all cores read a file."""
    raw.coalesce(raw.sparkSession.sparkContext.defaultParallelism) \
        .write.mode("append").option("parquet.block.size", STREAM_BLOCK).parquet(src)


def _stage_stream_input(spark, sf_dir) -> str:
    """Raw items (derived from lineitem) as parquet files."""
    src = scratch_path(spark, "stream-src")
    _written_stream(_raw(spark, sf_dir), src)
    return src


def _start_items(spark, src: str, files: int, sink, ck: str, **dedup):
    """The C1 stream into ``sink``, with state partitions by the session's cores."""
    stream = SP.prepare_stream(SP.item_stream(spark, src, files), **dedup)
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_PER_CORE * spark.sparkContext.defaultParallelism)
    return SP.start(stream, sink, ck, state_partitions=partitions)


def _stream_keys(spark, sink_path):
    return spark.read.parquet(sink_path).groupBy("url").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """ST3: stateful exact de-dup across micro-batches (2 files per trigger);
    every valid URL is written exactly once."""
    src, sink, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    _drain(_start_items(spark, src, 2, SP.parquet_batch_sink(sink), ck))
    return _stream_keys(spark, sink)


@query("stream_drain")
def q_stream_drain(spark, sf_dir):
    """ST1/ST2/ST4: the C1 stream, one file per trigger, drained to the end
    (availableNow); no row is lost and none is written twice."""
    src, sink, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    _drain(_start_items(spark, src, 1, SP.parquet_batch_sink(sink), ck))
    return _stream_keys(spark, sink)


@query("chain_page_count")
def q_chain_page_count(spark, sf_dir):
    """Per chain seed, next links seen on visited pages (the reference's
    page counter) and pages visited, to the end of every chain."""
    links = D.next_chain_links(spark, sf_dir)
    visited = follow_next(links, D.chain_seeds(spark, sf_dir), TO_THE_END)
    return chain_page_count(links, visited)


@query("chain_page_count_all")
def q_chain_page_count_all(spark, sf_dir):
    """T3 over every host chain with the job's default cap."""
    links = D.next_chain_links(spark, sf_dir)
    return chain_page_count(links, follow_next(links, D.chain_seeds(spark, sf_dir), OPTS.max_pages))


@query("stream_deterministic")
def q_stream_deterministic(spark, sf_dir):
    """ST3 deterministic-winner option: the raw item stream through the
    foreachBatch de-dup sink (one availableNow batch), payload compared in
    full with C1."""
    src, sink, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = SP.start(SP.item_stream(spark, src), SP.deterministic_dedup_sink(sink), ck)
    _drain(q)
    return spark.read.parquet(sink).drop("batch_id")


@query("stream_bounded")
def q_stream_bounded(spark, sf_dir):
    """A horizon of an hour over seven years of time stamps in any order
    loses no URL (rows age by arrival)."""
    src, sink, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    _drain(_start_items(spark, src, 1, SP.parquet_batch_sink(sink), ck, dedup="bounded", horizon="1 hour"))
    return spark.read.parquet(sink).select("url").distinct()


def _in_batches(spark, sf_dir, n: int, sink, ck: str) -> None:
    """The raw items as ``n`` micro-batches, by the remainder of ``seq``; the stream stops and resumes between them."""
    src = scratch_path(spark, "stream-src")
    for k in range(n):
        _written_stream(_raw(spark, sf_dir).filter(F.pmod("seq", F.lit(n)) == k), src)
        _drain(SP.start(SP.item_stream(spark, src), sink, ck))


RECENT = 2000


@query("stream_recency")
def q_stream_recency(spark, sf_dir):
    """D2 by number: four micro-batches, the 2,000 most recently seen URLs
    remembered; how often each URL is written."""
    out = scratch_path(spark, "stream-out")
    _in_batches(spark, sf_dir, 4, recency_dedup_sink(scratch_path(spark, "stream-recency"), SP.parquet_batch_sink(out), RECENT), scratch_path(spark, "stream-ck"))
    return _stream_keys(spark, out)


@query("stream_deterministic_batches")
def q_stream_deterministic_batches(spark, sf_dir):
    """ST3 deterministic-winner option over four micro-batches: the first batch
    that holds a URL wins it, and in the batch the first row."""
    out = scratch_path(spark, "stream-out")
    _in_batches(spark, sf_dir, 4, SP.deterministic_dedup_sink(out), scratch_path(spark, "stream-ck"))
    return spark.read.parquet(out).drop("batch_id")


@query("manifest_roundtrip")
def q_manifest_roundtrip(spark, sf_dir):
    """K3 + K4 by commit files: a first version is replaced by the whole one;
    both formats are read back through the commit."""
    root = scratch_path(spark, "manifest")
    items = I.prepare_items(_raw(spark, sf_dir))
    M.write_items(items.filter(F.col("rating_numeric") == 5), "dual", root)
    M.write_items(items, "dual", root)
    csv = _text_items(M.read_csv_items(spark, root))
    js = M.read_jsonl_items(spark, root)
    js = _text_items(js.select(*[c for c in js.columns if c not in ("scraped_at", "price_numeric")],
                               T.format_rfc3339("scraped_at").alias("scraped_at"), T.format_2dp("price_numeric").alias("price_numeric")))
    return csv.withColumn("format", F.lit("csv")).unionByName(js.withColumn("format", F.lit("json")))


def _stream_job(spark, sf_dir, fmt: str) -> str:
    out = scratch_path(spark, f"stream-{fmt}")
    opts = JobOptions(output_file=f"{out}/items.csv", output_format=fmt, dedupe_max_size=0)
    run_stream(spark, opts, _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-ck"))
    return f"{out}/items.csv"


@query("stream_csv")
def q_stream_csv(spark, sf_dir):
    """ST1 into K1: the streaming job's CSV batches, URLs read back."""
    return S.read_csv_items(spark, _stream_job(spark, sf_dir, "csv")).groupBy("url").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_dual")
def q_stream_dual(spark, sf_dir):
    """ST1 into K3: both formats hold every URL once."""
    csv = _stream_job(spark, sf_dir, "dual")
    rows = S.read_csv_items(spark, csv).select(F.lit("csv").alias("format"), "url") \
        .unionByName(S.read_jsonl_items(spark, S.dual_json_path(csv)).select(F.lit("json").alias("format"), "url"))
    return rows.groupBy("format", "url").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_pages")
def q_stream_pages(spark, sf_dir):
    """S1 + E0 + C1 as a stream over catalogue pages; counters of ST7."""
    src, out = scratch_path(spark, "stream-pages"), scratch_path(spark, "stream-json")
    _written_stream(D.catalogue_pages(spark, sf_dir), src)
    opts = JobOptions(output_file=f"{out}/items.json", output_format="json", dedupe_max_size=0)
    s = run_stream(spark, opts, src, scratch_path(spark, "stream-ck"), kind="pages")
    back = S.read_jsonl_items(spark, f"{out}/items.json")
    return back.agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("url").alias("n_urls")) \
        .withColumns({k: F.lit(s[k]).cast("long") for k in ("processed", "invalid_record", "duplicate_url")})


def _wall_clock(df):
    """Time stamps as the tables hold them (the session is in UTC)."""
    return df.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


# --- catalogue pages ---------------------------------------------------------

@query("extract_catalogue")
def q_extract_catalogue(spark, sf_dir):
    """E0 with the catalogue spec (E1-E9, F4) on markup of every kind."""
    return _wall_clock(X.extract_items(D.catalogue_pages(spark, sf_dir)))


@query("catalogue_next_links")
def q_catalogue_next_links(spark, sf_dir):
    """``li.next a`` of catalogue pages."""
    return X.next_links(D.catalogue_pages(spark, sf_dir))


@query("submit_items")
def q_submit_items(spark, sf_dir):
    """S4 + F5: two item frames of different columns, empty records dropped."""
    return submit_items(_raw(spark, sf_dir), D.partial_items(spark, sf_dir)).select(
        "seq", "title", "price", "rating", "availability", "image_url", "url", "scraped_at")


def _written_catalogue(spark, sf_dir):
    """Catalogue pages (derived from lineitem) written once, as the plan of a run reads its pages many times;
    in small row groups, so that all cores share a file."""
    path = scratch_path(spark, "catalogue")
    pages = D.catalogue_pages(spark, sf_dir)
    pages.write.option("parquet.block.size", STREAM_BLOCK).parquet(path)
    return spark.read.schema(pages.schema).parquet(path)


def _refetched_and_foreign(pages):
    """Catalogue pages with re-fetches of other content and a foreign host's pages."""
    again = pages.withColumn("page_id", F.col("page_id") + 1000000000).withColumn("html", F.lit("<html></html>"))
    foreign = pages.withColumn("url", F.replace("url", F.lit("shop.test"), F.lit("other.test")))
    return pages.unionByName(again).unionByName(foreign)


@query("crawl_run_all")
def q_crawl_run_all(spark, sf_dir):
    """The batch run's plan from the head of every chain with the default cap;
    each host forbids what begins like one of its pages whose number leaves 14
    modulo 97."""
    pages = _written_catalogue(spark, sf_dir)
    robots = pages.filter(F.col("page_id") % 97 == 14).select(
        url_host("url").alias("host"), F.lit(False).alias("allow"), F.regexp_replace(url_path("url"), r"\.html$", "").alias("path_prefix"))
    seeds = pages.filter(F.col("page_id") % 10 == 0).select("url")
    kept = crawl_pages(_refetched_and_foreign(pages), OPTS, robots, seeds=seeds)
    return _wall_clock(I.prepare_items(X.extracted_raw_items(kept)))


@query("crawl_run")
def q_crawl_run(spark, sf_dir):
    """The batch run's plan: T2 -> F2 -> T1/F6 -> E0 -> C1 over catalogue pages,
    their re-fetches and a foreign host, from the head of every chain, with an
    option from the environment that leaves robots rules aside (U4)."""
    pages = _written_catalogue(spark, sf_dir)
    robots = pages.select(url_host("url").alias("host")).distinct() \
        .select("host", F.lit(False).alias("allow"), F.lit("/catalogue/page-1").alias("path_prefix"))
    opts = JobOptions.from_env(environ={"PAGEMILL_RESPECT_ROBOTS_TXT": "false"}).validate()
    seeds = pages.filter(F.col("page_id") % 10 == 0).select("url")
    kept = crawl_pages(_refetched_and_foreign(pages), opts, robots, seeds=seeds)
    return _wall_clock(I.prepare_items(X.extracted_raw_items(kept)))


# --- failures, cancellation and options --------------------------------------

@query("retry_plan_options")
def q_retry_plan_options(spark, sf_dir):
    """U4: W1 with retries and back-off from the environment."""
    opts = JobOptions.from_env(environ={"PAGEMILL_MAX_RETRIES": "3", "PAGEMILL_RETRY_BACKOFF_MS": "150",
                                        "PAGEMILL_RETRY_BACKOFF_MAX_MS": "500"}).validate()
    return L.retry_plan(_log(spark, sf_dir), opts.max_retries, opts.retry_backoff_ms, opts.retry_backoff_max_ms)


@query("output_validation")
def q_output_validation(spark, sf_dir):
    """K5 + K7: every format is published into folders that are not there yet,
    and a run without records follows: CSV is replaced by its header, JSON
    Lines refuse the run and keep what they had.  What is read back then."""
    items, read, copy = I.prepare_items(_raw(spark, sf_dir)), [], scratch_path(spark, "prepared")
    items.write.parquet(copy)  # prepared once, for all formats
    items = spark.read.schema(items.schema).parquet(copy)
    for fmt in S.FORMATS:
        path = f"{scratch_path(spark, 'validated')}/of/{fmt}/items.csv"
        counts, refused = S.write_items(items, fmt, path), False
        try:
            S.write_items(items.filter(F.lit(False)), fmt, path)
        except S.OutputValidationError:
            refused = True
        for kind, n in counts.items():
            back = S.read_csv_items(spark, path) if kind == "csv" else \
                S.read_jsonl_items(spark, S.dual_json_path(path) if fmt == "dual" else path)
            read.append(back.agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("url").alias("n_urls")).select(
                F.lit(fmt).alias("format"), F.lit(kind).alias("output"), F.lit(n).cast("long").alias("first_run"),
                F.lit(refused).alias("refused"), "n_items", "n_urls"))
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    return out


@query("stream_resume")
def q_stream_resume(spark, sf_dir):
    """ST5: the stream is cancelled once its first batch is written and resumes
    from its checkpoint; every valid URL is written once."""
    src, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-ck")
    out = f"{scratch_path(spark, 'stream-out')}/items.csv"
    sink, written = SP.items_batch_sink(out), threading.Event()

    def announced(df, batch_id):
        sink(df, batch_id)
        written.set()

    def begin(to):
        return _start_items(spark, src, 1, to, ck)

    first = begin(announced)
    while first.isActive and not written.wait(0.1):
        pass
    SP.cancel(first)
    SP.forget(first)
    _drain(begin(sink))
    return S.read_csv_items(spark, out).groupBy("url").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_failure")
def q_stream_failure(spark, sf_dir):
    """ST6: a sink that fails after it has written its first batch ends the
    stream, and the error surfaces where the stream is drained; the next run
    repeats the batch and both formats hold every valid URL once."""
    src, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-ck")
    out = f"{scratch_path(spark, 'stream-out')}/items.csv"
    sink, surfaced = SP.items_batch_sink(out, "dual"), False

    def failing(df, batch_id):
        sink(df, batch_id)
        raise OSError("the disk is full")

    def begin(to):
        return _start_items(spark, src, 2, to, ck)

    try:
        _drain(begin(failing))
    except StreamingQueryException as ex:
        surfaced = "the disk is full" in str(ex)
    _drain(begin(sink))
    rows = S.read_csv_items(spark, out).select(F.lit("csv").alias("format"), "url") \
        .unionByName(S.read_jsonl_items(spark, S.dual_json_path(out)).select(F.lit("json").alias("format"), "url"))
    return rows.groupBy("format", "url").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("surfaced", F.lit(surfaced))


@query("stream_own_sink")
def q_stream_own_sink(spark, sf_dir):
    """A user's callable as the stream's output, here a roll-up per batch
    of URLs by their last number."""
    src, out, ck = _stage_stream_input(spark, sf_dir), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")

    def rollup(df, batch_id):
        df.groupBy(F.regexp_extract("url", "-([0-9]+)$", 1).alias("line")).agg(F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _drain(_start_items(spark, src, 1, rollup, ck))
    return spark.read.parquet(out).groupBy("line").agg(F.sum("n").alias("n_urls"))
