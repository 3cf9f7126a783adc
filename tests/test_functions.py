"""Scalar rules N1-N10 and E8: golden tables plus property tests against
pure-Python statements of the same rules."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import fetch as FF
from pagemill.functions import text as T
from pagemill.functions import urls as U


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def many(spark, expr, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["r"] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


# --- N2 normalize_price ---
NORMALIZE_PRICE = [("£51.77", "51.77"), ("  £10.50  ", "10.50"), ("25.99", "25.99"),
                   ("£ 99.99 £", "99.99"), ("", ""), ("$5", "$5"), (" £3.00 ", "3.00")]


def test_normalize_price(spark):
    got = many(spark, T.normalize_price, [a for a, _ in NORMALIZE_PRICE])
    assert got == [b for _, b in NORMALIZE_PRICE]


# --- N3 parse_price ---
PARSE_PRICE = [("£12.34", 12.34), ("£0.00", 0.0), ("£1,234.56", 1234.56), ("", None), ("POA", None),
               ("5.", 5.0), (".5", 0.5), (".", None), ("1.2.3", None), ("-5.00", 5.0), ("1e5", 15.0),
               ("12,34", 1234.0), ("9" * 400, None)]


def test_parse_price(spark):
    got = many(spark, T.parse_price, [a for a, _ in PARSE_PRICE])
    assert got == [b for _, b in PARSE_PRICE]


# --- N5 rating_to_numeric ---
RATINGS = [("Zero", 0), ("One", 1), ("Two", 2), ("Three", 3), ("Four", 4), ("Five", 5), ("Invalid", 0),
           ("", 0), ("three", 0), (" Two ", 2), (None, 0)]


def test_rating_to_numeric(spark):
    got = many(spark, T.rating_to_numeric, [a for a, _ in RATINGS])
    assert got == [b for _, b in RATINGS]


# --- N4 normalize_availability ---
def test_normalize_availability(spark):
    vals = ["  In stock (22 available)  ", "In stock", ""]
    assert many(spark, T.normalize_availability, vals) == ["In stock (22 available)", "In stock", ""]


# --- N1 trim_ws: property test against Python's statement of the rule ---
GO_SPACE = set(T.UNICODE_SPACE)


def py_trim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and s[i] in GO_SPACE:
        i += 1
    while j > i and s[j - 1] in GO_SPACE:
        j -= 1
    return s[i:j]


def test_unicode_space_set_is_white_space_property():
    assert GO_SPACE == {c for c in map(chr, range(0x3001)) if c.isspace()} - {"\x1c", "\x1d", "\x1e", "\x1f"}


ws_text = st.text(alphabet=st.sampled_from(list("ab £.,9 ") + [" ", "　", "\t", "\n", " ", "\x1f"]),
                  max_size=12)


@settings(max_examples=30, deadline=None)
@given(st.lists(ws_text, min_size=1, max_size=25))
def test_trim_and_price_properties(spark, values):
    got = many(spark, lambda c: F.struct(T.trim_ws(c).alias("t"), T.normalize_price(c).alias("n"),
                                         T.parse_price(c).alias("p")), values)
    for v, r in zip(values, got):
        assert r["t"] == py_trim(v)
        assert r["n"] == py_trim(py_trim(v).replace("£", ""))
        digits = re.sub(r"[^0-9.]", "", v)
        try:
            expect = float(digits) if digits and re.fullmatch(r"\d*\.?\d*", digits) else None
        except ValueError:
            expect = None
        assert r["p"] == expect


# --- N6/N7 formats ---
def test_format_2dp_ties_to_even_exact_binary(spark):
    assert many(spark, T.format_2dp, [0.125, 2.675, 10.0, 0.0, 1234567.5], "v double") == \
        ["0.12", "2.67", "10.00", "0.00", "1234567.50"]


def test_format_rfc3339(spark):
    import datetime as dt
    assert one(spark, T.format_rfc3339, dt.datetime(2025, 11, 4, 13, 9, 13), "v timestamp") == "2025-11-04T13:09:13Z"


def test_decode_entities(spark):
    assert one(spark, T.decode_entities, "&pound;1 &amp;lt; &quot;x&quot; &#39;") == "£1 &lt; \"x\" '"


# --- N8 classify_error ---
CLASSIFY = [(None, 0, "unknown"), ("deadline", 0, "timeout"), ("net_timeout", 0, "timeout"),
            ("op_error", 0, "connection"), (None, 403, "forbidden"), (None, 404, "not_found"),
            (None, 429, "rate_limited"), ("other", 0, "other"), ("http", 500, "other"),
            (None, 500, "unknown"), ("op_timeout", 0, "timeout"), ("http", 403, "forbidden")]


def test_classify_error(spark):
    df = spark.createDataFrame([(i, k, s) for i, (k, s, _) in enumerate(CLASSIFY)], "i int, k string, s int")
    got = [r[0] for r in df.select(FF.classify_error("k", "s")).collect()]
    assert got == [lbl for _, _, lbl in CLASSIFY]


# --- N9 retry_backoff ---
BACKOFF = [(4, 200, 500, 500), (1, 200, 500, 200), (2, 200, 500, 400), (3, 200, 500, 500),
           (3, 200, 0, 800), (1, 0, 500, 100), (0, 200, 500, 200), (-3, 200, 0, 200), (70, 200, 0, None)]


def test_retry_backoff(spark):
    df = spark.createDataFrame(BACKOFF, "a int, b long, m long, e long")
    got = [(r["r"], r["e"]) for r in df.select(FF.retry_backoff("a", "b", "m").alias("r"), "e").collect()]
    assert all(r == e for r, e in got), got


# --- N10 ---
def test_success_rate_and_rate(spark):
    df = spark.createDataFrame([(5, 1, 3, 2.0), (0, 0, 0, 0.0)], "r long, e long, n long, s double")
    got = df.select(F.round(FF.success_rate("r", "e"), 2).alias("sr"), FF.per_second("n", "s").alias("ps")).collect()
    assert (got[0]["sr"], got[0]["ps"]) == (80.0, 1.5)
    assert (got[1]["sr"], got[1]["ps"]) == (0.0, 0.0)


# --- E8 absolute_url ---
RESOLVE = [
    ("http://example.test/", "catalogue/book-1/index.html", "http://example.test/catalogue/book-1/index.html"),
    ("http://example.test/catalogue/page-2.html", "page-3.html", "http://example.test/catalogue/page-3.html"),
    ("http://example.test/a/b/c.html", "../media/x.jpg", "http://example.test/a/media/x.jpg"),
    ("http://example.test/a/b/c.html", "../../../x.jpg", "http://example.test/x.jpg"),
    ("http://example.test/a/b/", "./x/./y/../z", "http://example.test/a/b/x/z"),
    ("https://example.test/a", "//cdn.test/x.png", "https://cdn.test/x.png"),
    ("http://example.test/a/b", "/root.html", "http://example.test/root.html"),
    ("http://example.test/a/b?x=1", "?y=2", "http://example.test/a/b?y=2"),
    ("http://example.test/a", "https://other.test/z", "https://other.test/z"),
    ("http://example.test/a", "#frag", ""),
    ("http://example.test/a", "", ""),
    ("http://example.test", "x.html", "http://example.test/x.html"),
    ("http://example.test/a/b", "..", "http://example.test/"),
    ("http://example.test/a/b", "c?q=1#f", "http://example.test/a/c?q=1#f"),
]


def test_absolute_url(spark):
    df = spark.createDataFrame([(i, b, r) for i, (b, r, _) in enumerate(RESOLVE)], "i int, b string, r string")
    got = [x[0] for x in df.orderBy("i").select(U.absolute_url("b", "r")).collect()]
    assert got == [e for _, _, e in RESOLVE]


def test_url_host(spark):
    vals = ["http://Example.TEST:8080/x", "https://user@h.test/p", "ftp://[::1]:21/", "relative/path", None]
    assert many(spark, U.url_host, vals) == ["example.test", "h.test", "[::1]", "", ""]


@pytest.mark.parametrize("bad", ["a>b", "h3 > a", "a[href]"])
def test_selector_rejects_unsupported(bad):
    from pagemill.operators.extract import Selector
    with pytest.raises(ValueError):
        Selector.parse(bad)


def test_numeric_character_references(spark):
    vals = ["&#163;1", "&#xA3;2 &#XA3;", "a&#39;b", "&amp;#163;", "none", "&#x1F600;"]
    assert many(spark, T.decode_entities, vals) == ["£1", "£2 £", "a'b", "&#163;", "none", "\U0001F600"]


def test_references_decode_once_and_never_fail(spark):
    cases = {"&#38;lt;b&#38;gt;": "&lt;b&gt;", "&amp;lt;": "&lt;", "Caf&eacute; &rsquo; &euro;": "Café ’ €", "&#1114112;": "\ufffd",
             "&#xD800;": "\ufffd", "&#0;": "\ufffd", "&#0000000000163;": "£", "&#x00000A3;": "£", "&#99999999999999999999;": "\ufffd",
             "&#x1F600;": "\U0001F600", "&#146;": "\u2019", "&#129;": "\x81", "&nosuch; & &; &#; &#x;": "&nosuch; & &; &#; &#x;", "a&b": "a&b",
             "&apos;&nbsp;": "'\xa0", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", T.decode_entities("s").alias("d")).collect()}
    assert got == cases
