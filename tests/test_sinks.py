"""K1-K7: formats, staged publish, failure safety, validation."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import items as I
from pagemill.sinks import writers as S

from .fixtures import RAW_SCHEMA, raw


def items(spark, rows=None):
    rows = rows or [raw(1, title="Desk Lamp", price="£7.25", url="http://shop.test/item/7")]
    return I.prepare_items(spark.createDataFrame(rows, RAW_SCHEMA))


def read_text(path, pattern):
    out = []
    for f in sorted(glob.glob(os.path.join(path, pattern))):
        with open(f, encoding="utf-8") as fh:
            out.append(fh.read())
    return "".join(out)


def test_csv_record_layout(spark, tmp_dir):
    out = f"{tmp_dir}/books.csv"
    df = items(spark).withColumn("price_numeric", F.lit(0.0))
    assert S.write_csv(df, out) == 1
    text = read_text(out, "part-*.csv")
    lines = [x for x in text.splitlines() if x]
    assert lines[0] == "title,price,rating,rating_numeric,availability,image_url,url,scraped_at,price_numeric"
    assert lines[1] == ("Desk Lamp,7.25,Four,4,On shelf,http://shop.test/pic/7.png,"
                        "http://shop.test/item/7,2024-02-29T06:05:04Z,0.00")
    assert not glob.glob(f"{tmp_dir}/_staging-*")


def test_csv_quoting_roundtrip(spark, tmp_dir):
    tricky = 'He said "hi", then\nleft'
    df = items(spark, [raw(1, title=tricky, url="q")])
    S.write_csv(df, f"{tmp_dir}/q.csv")
    assert '"He said ""hi"", then\nleft"' in read_text(f"{tmp_dir}/q.csv", "part-*.csv")
    back = S.read_csv_items(spark, f"{tmp_dir}/q.csv").first()
    assert back["title"] == tricky


def test_jsonl_all_fields_present(spark, tmp_dir):
    S.write_jsonl(items(spark, [raw(1, availability=None, url="j")]), f"{tmp_dir}/b.json")
    rec = json.loads(read_text(f"{tmp_dir}/b.json", "part-*.json").splitlines()[0])
    assert list(rec) == ["title", "price", "price_numeric", "rating", "rating_numeric", "availability",
                         "image_url", "url", "scraped_at"]
    assert rec["availability"] == "" and rec["scraped_at"].startswith("2024-02-29T06:05:04")


def test_dual_and_json_path(spark, tmp_dir):
    counts = S.write_items(items(spark), "DUAL", f"{tmp_dir}/out.csv")
    assert counts == {"csv": 1, "json": 1}
    assert os.path.isdir(f"{tmp_dir}/out.json") and os.path.isdir(f"{tmp_dir}/out.csv")
    assert S.dual_json_path("a/b.csv") == "a/b.json" and S.dual_json_path("a/b.CSV") == "a/b.CSV.json" and S.dual_json_path("x") == "x.json"


def test_unknown_format(spark, tmp_dir):
    with pytest.raises(ValueError):
        S.write_items(items(spark), "xml", f"{tmp_dir}/o")


def test_failed_write_keeps_previous_output(spark, tmp_dir):
    out = f"{tmp_dir}/keep.csv"
    S.write_csv(items(spark), out)
    before = read_text(out, "part-*.csv")
    bad = items(spark).withColumn("title", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception):
        S.write_csv(bad, out)
    assert read_text(out, "part-*.csv") == before
    assert not glob.glob(f"{tmp_dir}/_staging-*")


def test_empty_json_fails_empty_csv_publishes_header(spark, tmp_dir):
    empty = items(spark).filter("false")
    with pytest.raises(S.OutputValidationError):
        S.write_jsonl(empty, f"{tmp_dir}/e.json")
    assert not os.path.exists(f"{tmp_dir}/e.json")
    assert S.write_csv(empty, f"{tmp_dir}/e.csv") == 0
    assert read_text(f"{tmp_dir}/e.csv", "part-*.csv").startswith("title,price")


def test_success_replaces_and_creates_parents(spark, tmp_dir):
    out = f"{tmp_dir}/deep/er/x.csv"
    S.write_csv(items(spark), out)
    S.write_csv(items(spark, [raw(1, url="a"), raw(2, url="b")]), out)
    assert S.read_csv_items(spark, out).count() == 2
    assert sorted(os.listdir(f"{tmp_dir}/deep/er")) == ["x.csv"]


def test_relative_path_stages_next_to_output(spark, tmp_dir, monkeypatch):
    staged = S._sibling(spark, "books.csv", "_staging-{}-x")
    assert staged.endswith("/_staging-books.csv-x") and not staged.endswith("file:/_staging-books.csv-x")
    assert S._sibling(spark, f"{tmp_dir}/a/b.csv", "{}.old-1").endswith(f"{tmp_dir}/a/b.csv.old-1")


def test_crash_between_renames_is_repaired(spark, tmp_dir):
    out = f"{tmp_dir}/r.csv"
    S.write_csv(items(spark), out)
    before = read_text(out, "part-*.csv")
    os.rename(out, f"{out}.old-1234")  # as a crash after the first rename leaves it
    S.recover(spark, out)
    assert read_text(out, "part-*.csv") == before and not glob.glob(f"{out}.old-*")
    os.makedirs(f"{out}.old-zzzz")  # a crash after the second rename
    S.write_csv(items(spark, [raw(1, url="a"), raw(2, url="b")]), out)
    assert not glob.glob(f"{out}.old-*") and S.read_csv_items(spark, out).count() == 2
