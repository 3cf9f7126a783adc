"""Very long texts, pages and conversations go through every operator whole."""

import hashlib

from pagemill.llm import chat, decontaminate, exact_dedup, licenses, line_dedup, packing, quality, simhash, toxicity, wrapper
from tests.llm.data import documents
from tests.llm.test_packing import PATH


def test_long_documents(spark):
    one_line = "word and more words " * 100_000
    many_lines = "\n".join(f"line number {i % 1000} that is long enough to be a key of its own" for i in range(60_000))
    no_space = "x" * 500_000
    texts = [one_line, many_lines, many_lines, no_space, "mit license " * 50_000, "short", None] + [f"line number {i % 7} that is long enough to be a key of its own" for i in range(40)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word and more words " * 5)], "item_id long, text string")
    assert exact_dedup.duplicate_report(docs).filter("group_size = 2").count() == 2
    lines = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert lines[1].n_lines == 60_000 and lines[1].n_dropped == lines[2].n_dropped == 7 * 60
    assert simhash.near_duplicate_groups(docs).count() == len(texts)
    scan = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (scan[4].n_base, scan[4].last_word) == (50_000, 99_998)
    hits = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert hits[0].n_hit == 400_000 and hits[1].n_hit == 0
    assert quality.quality_scores(docs, labels).count() == len(texts)
    assert toxicity.toxicity_scores(docs, labels).count() == len(texts)
    pieces = packing.pack_report(docs, PATH).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == len(texts) and all(r[1] == r[2] for r in pieces)


def test_long_pages(spark):
    flat = "<article>" + "".join(f"<p>paragraph {i}</p>" if i % 3 else f"<h2>head {i}</h2>" for i in range(20_000)) + "</article>"
    other = "<article>" + "".join(f"<p>text {i}</p>" if i % 5 else f"<ul><li>item {i}</ul>" for i in range(20_000)) + "</article>"
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    open_tags = "<p>a" * 50_000
    rows = [(i, "http://h.test/", h) for i, h in enumerate([flat, other, deep, open_tags, "<" * 100_000, "<a " * 50_000])]
    got = {r.page_id: r for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text.count("\n") == got[1].text.count("\n") == 19_999
    assert got[2].text == "core" and got[3].text.count("a") == 50_000 and got[4].n_chars == 100_000


def test_long_conversation_text(spark):
    said = "\\<|[INST] " * 100_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said)]
    r = next(r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.conv_id == 1)
    assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
