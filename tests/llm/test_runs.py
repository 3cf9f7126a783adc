"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import runs
from tests.llm.data import documents, empty_documents, prose


def brute(ids):
    """Every run, by trying all periods and extending."""
    n, out = len(ids), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)  # periods grow: the first is the smallest
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic(rng, n):
    """Words with runs of several periods, some side by side, nested or interleaved."""
    out = []
    while len(out) < n:
        kind = rng.random()
        base = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        if kind < 0.3:
            base = base * rng.randint(2, 4) + [rng.randint(0, 3)]
        out += base * rng.randint(1, 8) + base[:rng.randint(0, len(base))] if kind < 0.8 else [rng.randint(0, 50) for _ in range(rng.randint(1, 30))]
    return out[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    ids = periodic(rng, rng.choice([23, 24, 60, 200, 500]))
    assert runs.find_runs(np.array(ids)) == brute(ids)
    words = [[b"%d" % x for x in ids], [], [b"a"] * 24, [b"a"] * 23]
    assert runs.batch_runs(words) == [brute(ids), [], [(0, 24, 1)], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=12))
def test_filter_and_runs_on_any_words(parts):
    ids = [x for base, times in parts for x in base * times]
    assert runs.batch_runs([[b"%d" % x for x in ids]]) == [brute(ids)]


def test_fibonacci_and_constant_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == brute(b)
    assert runs.find_runs(np.zeros(3000, int)) == [(0, 3000, 1)]
    # a pattern met in many places, each with another word to its left
    many = [x for k in range(300) for x in (100 + k, *[1, 2] * 13)]
    assert runs.find_runs(np.array(many)) == brute(many)


def digest(text, doc_id):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_report_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 250)) for _ in range(150)] + [None, "", " \t\n", "a\x0bb\x0cc\x85d\xa0e f " * 30, "x " * 100, "é é " * 20]
    texts += [" ".join(f"w{x}" for x in periodic(rng, 300)) for _ in range(30)] + ["line one of a text that repeats here\nand " + prose(rng, 3)] * 4
    got = runs.run_report(documents(spark, texts))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert rows == {i: digest(t, i) for i, t in enumerate(texts)}
    assert sum(r[1] > 0 for r in rows.values()) > 20


def test_runs_of_and_collapse(spark):
    texts = ["start " + "one two  three\n" * 20 + "end", "no run at all", None, "x " * 30]
    docs = documents(spark, texts, ids=[5, 6, 7, 7])
    assert sorted(map(tuple, runs.runs_of(docs).collect())) == [(5, 1, 60, 3), (7, 0, 30, 1)]
    out = runs.collapse_runs(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()] == ["start one two three end", "no run at all", None, "x"]


def test_empty_null_ids_and_clashing_names(spark):
    assert runs.run_report(empty_documents(spark)).count() == 0
    rows = runs.run_report(documents(spark, ["a " * 40, None], ids=[None, None]).withColumnRenamed("kept", "n_runs")).collect()
    assert sorted((r.doc_id, r.n_runs) for r in rows) == [(None, 0), (None, 1)]


def test_long_texts(spark):
    rng = random.Random(9)
    phrase = prose(rng, 20)
    texts = ["word " * 60_000, " ".join(f"{phrase} w{i}" for i in range(3000)), prose(rng, 60_000), " ".join([phrase] * 4000)]
    rows = {r.doc_id: r for r in runs.run_report(documents(spark, texts, ids=[1, 2, 3, 5])).collect()}
    assert (rows[1].n_runs, rows[1].length, rows[1].period) == (1, 60_000, 1)
    assert rows[2].n_runs == 0 and rows[5].length == 80_000 and rows[5].period == 20
