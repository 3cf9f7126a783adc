"""Views of the driver's test tables as the library's input relations.

``raw_items`` comes from ``lineitem``, ``fetch_log`` from ``events`` and the
page relations from ``pages``.  The expressions are fixed by FIXTURES.md
section 3 so that the DuckDB oracles can inline the very same SELECT.
All of them are narrow projections: no shuffle, scan columns pruned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of a test table at least the session's parallelism.

    For the driver's tables only, which are single files of one row group;
    the library's readers leave scans to the file source.  Large inputs are split by the file source (many files / row groups) and
    are returned unchanged.  A scan with fewer partitions than half the
    default parallelism (a single small file with one row group) would run
    all per-row work in one task; it is hash-repartitioned (deterministic on
    retry).
    Catalyst pushes filters through a repartition, which would move the
    row-level work back into the single scan task; the ``observe`` node (a
    row counter on the scan) is not crossed by that rule and keeps the work
    after the repartition.
    """
    spark = df.sparkSession
    try:
        target = spark.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: keep the scan as is
        return df
    if n >= max(2, target // 2):
        return df
    # Hash of (up to four) fixed-width columns: deterministic on retry without the
    # local sort a round-robin repartition needs, cheap to compute, and string
    # columns (e.g. page HTML) stay prunable.  Round-robin only as fallback.
    fixed = [c for c, t in df.dtypes
             if t in _FIXED_TYPES or t.startswith("decimal") or t.startswith("timestamp")][:4]
    spread_df = df.repartition(target, F.xxhash64(*fixed)) if fixed else df.repartition(target)
    return spread_df.observe(f"scan_rows_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


_FIXED_TYPES = {"bigint", "int", "smallint", "tinyint", "double", "float", "date", "boolean"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


# The rating word for l_suppkey % 7 (index = remainder).
RATING_BY_REMAINDER = ["Zero", "One", "Two", "Three", "Four", "Five", "three"]


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rating = F.when(sk % 53 == 0, F.lit(""))
    for i, word in enumerate(RATING_BY_REMAINDER):
        rating = rating.when(sk % 7 == i, F.lit(word))
    price_txt = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return li.select(
        (ok * 10 + ln).alias("seq"),
        F.when(ok % 41 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Item "), pk.cast("string"))).alias("title"),
        F.when(pk % 97 == 0, F.lit("POA")).when(pk % 89 == 0, F.lit(""))
        .otherwise(F.concat(F.lit(" £"), price_txt, F.lit(" "))).alias("price"),
        rating.alias("rating"),
        F.when(F.col("l_returnflag") == "R", F.lit("  In stock  ")).otherwise(F.lit("Out of stock")).alias("availability"),
        F.concat(F.lit("http://example.test/img/"), pk.cast("string"), F.lit(".jpg")).alias("image_url"),
        F.concat(F.lit("http://example.test/item/"), pk.cast("string"), F.lit("-"), ln.cast("string")).alias("url"),
        F.col("l_shipdate").alias("scraped_at"),
    )


# Status and error kind by event_id % 5 / % 3 for error events.
STATUS_BY_REMAINDER = [403, 404, 429, 500, 0]
KIND_BY_REMAINDER = ["deadline", "op_error", "other"]


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, is_err = F.col("event_id"), F.col("event_type") == "error"
    status = F.when(~is_err, F.lit(200))
    for i, code in enumerate(STATUS_BY_REMAINDER):
        status = status.when(eid % 5 == i, F.lit(code))
    kind = F.when(~is_err, F.lit(None).cast("string")).when(eid % 5 != 4, F.lit("http"))
    for i, k in enumerate(KIND_BY_REMAINDER):
        kind = kind.when(eid % 3 == i, F.lit(k))
    return ev.select(
        eid.alias("attempt_id"),
        F.concat(F.lit("http://example.test/u/"), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").alias("attempt_ts"),
        status.cast("int").alias("status"),
        kind.alias("error_kind"),
        (F.col("value") / 100).alias("duration_s"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def page_host(url_col="url"):
    """Host with port, as the driver's next-chain view defines it."""
    c = F.col(url_col) if isinstance(url_col, str) else url_col
    return F.regexp_extract(c, r"^https?://([^/?#]+)", 1)


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the previous page of its host in ``page_id`` order
    (skew-safe chunked ``previous``: a host holding most pages is split)."""
    from ..plans.ordered import previous_within
    p = pages(spark, sf_dir).select("page_id", "url", page_host("url").alias("_host"))
    return previous_within(p, "_host", ["page_id"], ["url"])


def next_chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver pages carry no ``li.next``; chain each host's pages in
    ``page_id`` order instead: ``(url, next_url)`` - the previous page links
    to the current one."""
    c = _chain(spark, sf_dir)
    return c.filter(F.col("prev_url").isNotNull()).select(F.col("prev_url").alias("url"), F.col("url").alias("next_url"))


def chain_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of every host chain: pages with no predecessor."""
    return _chain(spark, sf_dir).filter(F.col("prev_url").isNull()).select("url")


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per host derived from the pages: disallow each language path
    except its ``/en`` tree, and re-allow one longer prefix there."""
    hosts = pages(spark, sf_dir).select(url_host("url").alias("host")).distinct()
    rules = F.array(
        F.struct(F.lit(False).alias("allow"), F.lit("/fr/").alias("path_prefix")),
        F.struct(F.lit(False).alias("allow"), F.lit("/es/").alias("path_prefix")),
        F.struct(F.lit(False).alias("allow"), F.lit("/de/").alias("path_prefix")),
        F.struct(F.lit(True).alias("allow"), F.lit("/fr/1").alias("path_prefix")),
    )
    return hosts.select("host", F.inline(rules))


def robots_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern rules for every host of the pages."""
    hosts = pages(spark, sf_dir).select(url_host("url").alias("host")).distinct()
    rules = F.array(*[F.struct(F.lit(allow).alias("allow"), F.lit(p).alias("path_prefix")) for allow, p in (
        (False, "/*.html$"), (False, "/en/*7"), (True, "/en/1*"), (False, "/fr/*2*?"), (False, "/de/$"))])
    return hosts.select("host", F.inline(rules))


def odd_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference per page, well formed or not, by the remainder of its number."""
    n = F.col("page_id").cast("string")
    kinds = [("a%zz/", ""), ("http://[::1/", ""), ("http://h.test:80x/", ""), ("", ":x/y"), ("/a%20b/", ""), ("http://[::1]:8080/", ""),
             ("http://us er@h.test/", ""), ("//cdn.test/", "?q=%zz"), ("x\x07/", ""), ("/p#%zq", ""), ("/ü/", ""), ("mailto:", "@h.test")]
    ref = F.lit(None).cast("string")
    for i, (before, after) in enumerate(kinds):
        ref = F.when(F.col("page_id") % len(kinds) == i, F.concat(F.lit(before), n, F.lit(after))).otherwise(ref)
    return pages(spark, sf_dir).select("page_id", "url", ref.alias("ref"))


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages built from ``lineitem``: a page per order, an item per
    line, in the many ways real markup writes the same thing.

    Chains of ten pages follow ``li.next``.  By remainders of the part key:
    a ``>`` inside the title attribute, single quotes, bare attributes, swapped
    and extra classes, named and numeric references, nested articles, missing
    titles and links.  Some pages carry items in comments and scripts.
    """
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    # lines are gathered as they are, and their markup, ten times as long, is written behind the exchange
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("_lines"), F.min("l_shipdate").alias("fetched_at"))
    pid = F.col("page_id")
    body = F.array_join(F.transform("_lines", lambda line: _catalogue_item(pid, line)), "\n")
    hidden = F.when(pid % 4 == 0, F.lit('<!-- <article class="product_pod"><h3><a title="x" href="x">x</a></h3></article> -->')) \
        .when(pid % 4 == 1, F.lit('<script>var a = \'<article class="product_pod"><h3><a title="y" href="y">y</a></h3></article>\';</script>')).otherwise(F.lit(""))
    follow = F.when(pid % 10 == 9, F.lit("")).otherwise(F.concat(
        F.lit('<ul class="pager"><li class="current">Page <ul><li><a href="#">1</a></li></ul></li><li class="next"><a href="page-'),
        (pid + 1).cast("string"), F.lit('.html">next</a></li></ul>')))
    return orders.select("page_id", F.concat(F.lit("http://shop.test/catalogue/page-"), pid.cast("string"), F.lit(".html")).alias("url"),
                         F.concat(F.lit("<html><body>"), hidden, F.lit("<ol>"), body, F.lit("</ol>"), follow, F.lit("</body></html>")).alias("html"),
                         "fetched_at")


def _catalogue_item(ok: Column, line: Column) -> Column:
    """The markup of one line of a catalogue page."""
    pk, ln = line["l_partkey"], line["l_linenumber"]
    p, n = pk.cast("string"), F.concat(ok.cast("string"), F.lit("-"), ln.cast("string"))
    price = line["l_extendedprice"].cast("decimal(18,2)").cast("string")
    title = F.when(pk % 31 == 0, F.lit("")).when(pk % 3 == 0, F.concat(F.lit('title="5 > '), p, F.lit(' &amp;lt; Caf&eacute;"'))) \
        .when(pk % 3 == 1, F.concat(F.lit("title=' It&#39;s "), p, F.lit(" '"))).otherwise(F.concat(F.lit("title=Item"), p))
    href = F.when(pk % 37 == 0, F.lit("")).when(pk % 2 == 0, F.concat(F.lit('href="../item/'), n, F.lit('.html"'))) \
        .otherwise(F.concat(F.lit("href=/item/"), n))
    words = F.array(*[F.lit(w) for w in RATING_BY_REMAINDER])
    rating = F.element_at(words, (line["l_suppkey"] % 7 + 1).cast("int"))
    stars = F.when(pk % 2 == 0, F.concat(F.lit("star-rating "), rating)).otherwise(F.concat(rating, F.lit(" star-rating big")))
    sign = F.when(pk % 4 == 0, F.lit("&pound;")).when(pk % 4 == 1, F.lit("&#163;")).when(pk % 4 == 2, F.lit("&#x000A3;")).otherwise(F.lit("&euro; "))
    stock = F.when(line["l_returnflag"] == "R", F.lit('<p class="availability">Old</p><p class="instock availability"><i class="icon"></i> In stock </p>')) \
        .otherwise(F.lit('<p class="availability out">\n Sold out\t</p>'))
    image = F.when(pk % 2 == 0, F.concat(F.lit('<img alt="a > b" src="//cdn.test/'), p, F.lit('.jpg">'))) \
        .otherwise(F.concat(F.lit("<img src='img/"), p, F.lit(".png'/>")))
    note = F.when(pk % 11 == 0, F.lit('<article class="note">seen</article>')).otherwise(F.lit(""))
    return F.concat(
        F.when(pk % 2 == 0, F.lit('<article class="product_pod">')).otherwise(F.lit("<ARTICLE data-a='>' class='wide product_pod'>")), note,
        F.lit("<h3><a "), title, F.lit(" "), href, F.lit(">short</a></h3><p class='"), stars, F.lit('\'></p><p class="price_color">'), sign,
        F.lit("<b>"), price, F.lit("</b></p>"), stock, image, F.lit("</article>"))


def partial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items submitted with some columns only, one in ten of them empty, from ``part``."""
    pk = F.col("p_partkey")
    empty = pk % 10 == 0
    return table(spark, sf_dir, "part").select(
        pk.alias("seq"), F.when(~empty, F.col("p_name")).alias("title"),
        F.when(~empty, F.concat(F.lit("http://example.test/part/"), pk.cast("string"))).alias("url"))
