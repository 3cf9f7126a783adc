"""URL filter: rules and models against DuckDB and a plain Python version."""

import random
from collections import Counter, defaultdict
from math import log

import duckdb
import pytest

from pagemill.llm import url_filter

ODD = [None, "", "x", "no scheme/at all", "http://", "HTTP://EXAMPLE.NET", "a://b://c/d", "http://net", "http://net/", "http://xnet/", "http://a.net?q=/",
       "http://www.Example.NET/en/x", "http://example.net/EN/x", "http://example.com/de", "http://example.com/de/?a#b", "http://fr.org/fr/", "http://org/fr/x",
       "http://é.org/fr/ü", "http://日本.example.com/日本/😀", "http://a..net/x", "http://.net/x", "http://user@net:80/", "\x02\x03://\x02net/\x03", "http://h.org#/fr/"]


def urls(seed, n):
    rng = random.Random(seed)
    hosts = ["example.net", "a.example.net", "spam.net", "example.com", "b.example.com", "news.org", "c.org", "d.info"]
    out = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'win'])}/{rng.choice(['casino', 'pills', 'garden', 'river'])}{rng.randint(0, 40)}"
           f"{rng.choice(['', '?page=2', '#top'])}" for _ in range(n)]
    return out + ODD + out[:20] + ["http://spam.net/en/same"] * 40


def pages(spark, texts):
    rows = [(i, u, "<p>x</p>", "allow", 3) for i, u in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, _row int")


@pytest.mark.parametrize("n", [0, 300])
def test_report_equals_sql(spark, n):
    texts = urls(1, n)
    got = sorted(map(tuple, url_filter.url_report(pages(spark, texts)).collect()))
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.execute(url_filter.QUERY_SQL).fetchall())
    assert len(got) == len(texts)


def plain_weights(rows, order, least):
    """Log ratio of every gram, by recursion over contexts; rows are (text, label or None if it does not teach)."""
    counts = {c: defaultdict(Counter) for c in (True, False)}
    grams, symbols = set(), set()
    for text, label in rows:
        s = url_filter.START * order + text + url_filter.END
        for i in range(order, len(s)):
            symbols.add(s[i])
            grams.add(s[i - order:i + 1])
            if label is not None:
                for k in range(order + 1):
                    counts[label][s[i - k:i]][s[i]] += 1

    def p(c, context, symbol):
        lower = p(c, context[1:], symbol) if context else 1 / len(symbols)
        after = counts[c][context]
        total = sum(after.values())
        return (after[symbol] + len(after) * lower) / (total + len(after)) if total >= least else lower

    return {g: log(p(True, g[:-1], g[-1]) / p(False, g[:-1], g[-1])) for g in grams}


def test_weights_equal_recursion(spark):
    rows = url_filter.judged_by_rule(pages(spark, urls(2, 60)), url_filter.RULES)
    local = [(r._text, None if r._held else r._label) for r in rows.collect()]
    for order, least in ((3, 2), (0, 1)):
        counts = url_filter.gram_counts(rows, order)
        got = {r._gram: r._w / url_filter.SCALE for r in url_filter.gram_weights(counts, order, least).collect()}
        want = plain_weights(local, order, least)
        assert got.keys() == want.keys()
        assert max(abs(got[g] - want[g]) for g in want) < 1e-5


def test_scores_with_and_without_hot_grams(spark, monkeypatch):
    rows = url_filter.judged_by_rule(pages(spark, urls(3, 80)), url_filter.RULES)
    counts = url_filter.gram_counts(rows)
    weights = url_filter.gram_weights(counts)
    places = sum(len(r._text) + 1 for r in rows.collect())
    by_gram = {r._gram: r._w for r in weights.collect()}
    k = url_filter.ORDER
    padded = {r._row: url_filter.START * k + r._text + url_filter.END for r in rows.collect()}
    want = {r: sum(by_gram[s[i - k:i + 1]] for i in range(k, len(s))) / url_filter.SCALE / (len(s) - k) for r, s in padded.items()}
    for hot in (4, 1 << 20):  # hardly any gram, every gram
        monkeypatch.setattr(url_filter, "HOT", hot)
        got = {r._row: r._score for r in url_filter.scores(rows, weights, places).collect()}
        assert got.keys() == want.keys() and all(abs(got[r] - want[r]) < 1e-12 for r in want)


def test_models_tell_classes_apart(spark):
    rng = random.Random(4)
    good = [f"http://site{i}.org/fr/{rng.choice(['garden', 'river', 'stone'])}-{rng.choice(['walk', 'view'])}" for i in range(60)]
    bad = [f"http://x{i}.net/{rng.choice(['casino', 'pills', 'bets'])}/{rng.choice(['win', 'cheap'])}" for i in range(60)]
    new = ["http://a.info/fr/river-walk", "http://b.info/fr/garden-view", "http://c.info/casino/win", "http://d.info/pills/cheap"]
    got = {r.page_id: r for r in url_filter.judge_urls(pages(spark, good + bad + new), url_filter.RULES).collect()}
    assert [got[120 + i].verdict for i in range(4)] == ["allow", "allow", "block", "block"]
    assert all(got[120 + i].rule is None for i in range(4))
    strict = url_filter.judge_urls(pages(spark, good + bad + new), url_filter.RULES, allow_from=0.99).collect()
    assert all((r.verdict == "allow") == (r.allow_probability >= 0.99) for r in strict if r.rule is None)
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages(spark, new), url_filter.RULES, allow_from=1.0)


def test_one_class_only_and_no_rules(spark):
    texts = ["http://a.net/x", "http://b.info/y", None]
    for rules in (url_filter.RULES, []):
        got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages(spark, texts), rules).collect()}
        assert got.keys() == {0, 1, 2} and (got[0] == "block" or not rules)
    assert all(r.verdict == "allow" for r in url_filter.judge_urls(pages(spark, texts), []).collect())  # no model: every score is zero


def test_keep_allowed_keeps_columns(spark):
    texts = urls(5, 100)
    table = pages(spark, texts)
    verdicts = {r.page_id: r.verdict for r in url_filter.url_report(table).collect()}
    kept = url_filter.keep_allowed(table, url_filter.RULES)
    assert kept.columns == table.columns
    by_rule = {r.page_id: r for r in url_filter.url_report(table).collect() if r.rule}
    ids = {r.page_id for r in kept.collect()}
    assert all((i in ids) == (r.verdict == "allow") for i, r in by_rule.items())
    assert len(ids) > 0 and len(verdicts) == len(texts)


def test_empty_and_long(spark):
    assert url_filter.url_report(pages(spark, [])).count() == 0
    long = "http://a.net/" + "abcdefghij" * 30_000
    got = url_filter.url_report(pages(spark, [long, "http://b.info/" + "é" * 50_000, *["http://h.org" + ".x" * 20_000 + ".org/fr/"]])).collect()
    assert sorted((r.page_id, r.rule) for r in got) == [(0, "net/"), (1, None), (2, "org/fr/")]
