"""F2 allowed domains, F3 robots rules, T2 page de-dup."""

from __future__ import annotations

from pagemill.operators import filters as R


def urls(spark, *u):
    return spark.createDataFrame([(i, x) for i, x in enumerate(u)], "id int, url string")


def test_allowed_domains_exact_host_port_case(spark):
    df = urls(spark, "http://Books.test:8080/a", "https://books.test/b", "http://sub.books.test/c",
              "http://other.test/d", "not a url")
    hosts = spark.createDataFrame([("books.test",)], "host string")
    assert sorted(r["id"] for r in R.allowed_domains(df, hosts).collect()) == [0, 1]


def test_robots_longest_prefix_allow_wins_ties(spark):
    rules = spark.createDataFrame([("h.test", False, "/private/"), ("h.test", True, "/private/open"),
                                   ("h.test", False, "/tie"), ("h.test", True, "/tie"),
                                   ("x.test", False, "/")], "host string, allow boolean, path_prefix string")
    df = urls(spark, "http://h.test/private/a", "http://h.test/private/open/b", "http://h.test/tie/x",
              "http://h.test/public", "http://x.test/anything", "http://y.test/private/a",
              "http://h.test/private/a")
    kept = sorted(r["id"] for r in R.robots_filter(df, rules).collect())
    assert kept == [1, 2, 3, 5]
    assert R.robots_filter(df, rules, enabled=False).count() == 7


def test_dedup_pages_first_fetch_wins(spark):
    df = spark.createDataFrame([(3, "u"), (1, "u"), (2, "v")], "page_id long, url string")
    assert sorted(tuple(r) for r in R.dedup_pages(df).collect()) == [(1, "u"), (2, "v")]


def test_robots_patterns(spark):
    cases = [  # path, rules of its host (allow, pattern), allowed
        ("/fish", [(False, "/fish*")], False), ("/fish.html", [(False, "/*.html$")], False), ("/fish.html?x", [(False, "/*.html$")], True),
        ("/a/b/c", [(False, "/a/*/c")], False), ("/a/c", [(False, "/a/*/c")], True), ("/a/b/c/d", [(False, "/a/*/c$")], True),
        ("/page", [(False, "/*"), (True, "/page")], True), ("/page.htm", [(True, "/page"), (False, "/*.htm")], False),
        ("/", [(False, "/$")], False), ("/x", [(False, "/$")], True), ("/a.b(c)+", [(False, "/a.b(c)+$")], False), ("/aXb(c)+", [(False, "/a.b(c)+")], True),
        ("/q?a=1&b=2", [(False, "/q?*b=")], False), ("/x/y", [(False, "*y")], False), ("/x/**/y", [(False, "/x/**/y")], False), ("/é/ü", [(False, "/é/*ü$")], False),
        ("/p$q", [(False, "/p$q")], False), ("/none", [], True), ("/same", [(True, "/s*e"), (False, "/same")], False), ("/tie", [(True, "/t*e"), (False, "/t?e")], True)]
    urls = spark.createDataFrame([(i, f"http://h{i}.test{p}") for i, (p, _, _) in enumerate(cases)], "page_id int, url string")
    rules = spark.createDataFrame([(f"h{i}.test", a, x) for i, (_, rs, _) in enumerate(cases) for a, x in rs], "host string, allow boolean, path_prefix string")
    got = {r.page_id for r in R.robots_filter(urls, rules).collect()}
    assert [(c, i in got) for i, c in enumerate(cases) if (i in got) != c[2]] == []


def test_heavy_hosts_are_dealt_by_measured_size(spark):
    """A host with a third of the rows: the same rows stay, and no share holds more than its part."""
    from pyspark.sql import functions as F

    from pagemill.functions.urls import url_host
    from pagemill.operators.heavy import Shares, heavy_keys
    urls = [(i, f"http://hot.test/{i}" if i % 3 == 0 else f"http://h{i % 400}.test/{i}") for i in range(6000)]
    df = spark.createDataFrame(urls, "page_id int, url string")
    heavy = heavy_keys(df, url_host("url"), 100)
    assert len(heavy) == 1 and abs(max(heavy.values()) - 2000) <= 20
    shares = Shares(heavy, 100)
    dealt = df.groupBy(url_host("url").alias("h"), shares.one(url_host("url"), F.col("url")).alias("s")).count().collect()
    assert max(r["count"] for r in dealt) <= 160 and len({r["s"] for r in dealt if r["h"] == "hot.test"}) == 20
    hosts = spark.createDataFrame([("HOT.test",), ("h1.test",)], "host string")
    want = {i for i, u in urls if "//hot." in u or "//h1." in u}
    for rows in (100, 10**6):
        assert {r.page_id for r in R.allowed_domains(df, hosts, share_rows=rows).collect()} == want
    rules = spark.createDataFrame([("hot.test", False, "/*7$"), ("h1.test", False, "/")], "host string, allow boolean, path_prefix string")
    blocked = {i for i, u in urls if ("//hot." in u and u.endswith("7")) or "//h1." in u}
    for rows in (100, 10**6):
        assert {r.page_id for r in R.robots_decisions(df, rules, share_rows=rows).join(df, "url").filter("not allowed").collect()} == blocked
