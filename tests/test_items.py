"""F1, D1, C1, C2, A1 on small raw-item frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import items as I
from pagemill.sources.tables import submit_items

from .fixtures import RAW_SCHEMA, raw


def df(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_validation_order_and_reasons(spark):
    rows = [raw(1), raw(2, title="  "), raw(3, price="  "), raw(4, rating=""), raw(5, title="", price="")]
    got = {r["seq"]: r["reason"] for r in I.validate_items(df(spark, rows)).collect()}
    assert got == {1: None, 2: "missing_title", 3: "missing_price", 4: "missing_rating", 5: "missing_title"}


def test_pipeline_valid_invalid_duplicate(spark):
    """valid (URL 1), blank title (URL 2), same URL 1 again -> 1 row."""
    rows = [raw(1, url="u1"), raw(2, title=" ", url="u2"), raw(3, url="u1", title="Other")]
    out = I.prepare_items(df(spark, rows)).collect()
    assert [(r["url"], r["title"]) for r in out] == [("u1", "Lamp")]
    stats = {r["metric"]: r["value"] for r in I.pipeline_stats(df(spark, rows)).collect()}
    assert stats == {"processed": 1, "invalid_record": 1, "duplicate_url": 1}


def test_invalid_first_does_not_claim_url(spark):
    rows = [raw(1, url="u1", rating=""), raw(2, url="u1", title="Good")]
    out = I.prepare_items(df(spark, rows)).collect()
    assert [r["title"] for r in out] == ["Good"]


def test_empty_url_is_a_key(spark):
    rows = [raw(1, url=""), raw(2, url="", title="B"), raw(3, url="x")]
    out = sorted((r["url"], r["title"]) for r in I.prepare_items(df(spark, rows)).collect())
    assert out == [("", "Lamp"), ("x", "Lamp")]


def test_unparseable_price_kept_as_zero(spark):
    rows = [raw(1, price="POA", url="a"), raw(2, price=" £1,234.50 ", url="b", availability="  In stock  ")]
    out = {r["url"]: r for r in I.prepare_items(df(spark, rows)).collect()}
    assert out["a"]["price_numeric"] == 0.0 and out["a"]["price"] == "POA"
    assert out["b"]["price"] == "1,234.50" and out["b"]["price_numeric"] == 1234.5
    assert out["b"]["availability"] == "In stock" and out["b"]["rating_numeric"] == 4
    stats = {r["metric"]: r["value"] for r in I.pipeline_stats(df(spark, rows)).collect()}
    assert stats == {"processed": 2, "unparseable_price": 1}


def test_first_wins_by_seq(spark):
    rows = [raw(5, url="u", title="late"), raw(1, url="u", title="early"), raw(3, url="u", title="mid")]
    assert [r["title"] for r in I.prepare_items(df(spark, rows)).collect()] == ["early"]


def test_tag_items_invariant_and_identical_rows(spark):
    rows = [raw(1, url="u"), raw(1, url="u"), raw(1, url="u"), raw(2, url="u", rating=""),
            raw(3, url="v", price="x"), raw(4, url="w")] * 3
    tags = I.tag_items(df(spark, rows)).collect()
    assert len(tags) == len(rows)
    by = {}
    for r in tags:
        by.setdefault(r["outcome"], []).append(r)
    assert sorted((r["url"]) for r in by["processed"]) == ["u", "v", "w"]
    assert len(by["invalid_record"]) == 3
    assert len(by["duplicate_url"]) == len(rows) - 3 - 3
    assert [r["url"] for r in tags if r["price_unparseable"]] == ["v"]
    stats = {r["metric"]: r["value"] for r in I.pipeline_stats(df(spark, rows)).collect()}
    assert stats == {"processed": 3, "invalid_record": 3, "duplicate_url": len(rows) - 6, "unparseable_price": 1}


def test_tag_items_moves_full_rows_once(spark):
    """One exchange deals the rows by all columns; the other one carries at most one row per URL and task."""
    plan = I.tag_items(df(spark, [raw(1), raw(2, url="v")]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert "WindowGroupLimit" in plan


def test_tag_items_null_and_empty_url_are_one_key(spark):
    tags = I.tag_items(df(spark, [raw(1, url=None), raw(2, url=""), raw(1, url="")])).collect()
    assert sorted(r["outcome"] for r in tags) == ["duplicate_url", "duplicate_url", "processed"]


def test_hot_url_partial_limit_plan(spark):
    """D1 trims a hot key before the exchange (partial WindowGroupLimit)."""
    rows = [raw(i, url="hot") for i in range(200)] + [raw(1000 + i, url=f"u{i}") for i in range(50)]
    out = I.dedup_first(df(spark, rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = {r["url"]: r["seq"] for r in out.collect()}
    assert got["hot"] == 0 and len(got) == 51


def test_submit_items_drops_nil_records(spark):
    a = df(spark, [raw(1), (2, None, None, None, None, None, None, None)])
    b = df(spark, [raw(3)])
    assert submit_items() is None
    assert submit_items(a, b).count() == 2


def test_no_nulls_in_output(spark):
    rows = [(1, "T", "£1", "Two", None, None, "u", None)]
    r = I.prepare_items(df(spark, rows)).first()
    assert r["availability"] == "" and r["image_url"] == ""
    assert all(r[c] is not None for c in r.asDict() if c != "scraped_at")
    assert I.prepare_items(df(spark, rows)).select(F.count("*")).first()[0] == 1


def test_tag_items_hot_identical_group_is_split(spark):
    """A group of identical rows larger than the emit block is emitted in
    blocks; exactly one copy is processed."""
    rows = [raw(1, url="hot")] * 25 + [raw(2, url="hot"), raw(3, url="x", title=" ")]
    tags = I.tag_items(df(spark, rows), emit_block=4)
    got = [r["outcome"] for r in tags.collect()]
    assert len(got) == 27 and got.count("processed") == 1 and got.count("invalid_record") == 1
    assert got.count("duplicate_url") == 25


def test_null_url_is_the_empty_key(spark):
    rows = [raw(1, url=None, title="A"), raw(2, url="", title="B"), raw(3, url="x")]
    out = sorted((r["url"], r["title"]) for r in I.prepare_items(df(spark, rows)).collect())
    assert out == [("", "A"), ("x", "Lamp")]
    tags = {r["seq"]: r["outcome"] for r in I.tag_items(df(spark, rows)).collect()}
    assert tags == {1: "processed", 2: "duplicate_url", 3: "processed"}
    stats = {r["metric"]: r["value"] for r in I.pipeline_stats(df(spark, rows)).collect()}
    assert stats == {"processed": 2, "duplicate_url": 1}
