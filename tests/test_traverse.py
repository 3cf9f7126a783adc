"""T1 by path doubling: long chains, cycles, caps, joining chains and branching links."""

from __future__ import annotations

import random

import pytest

from pagemill.plans import traverse
from pagemill.plans.traverse import follow_next


def links(spark, pairs):
    return spark.createDataFrame(list(pairs), "url string, next_url string")


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def walk(pairs, start, cap):
    """Breadth-first: hop of every page, each page once."""
    after = {}
    for a, b in pairs:
        if b is not None:
            after.setdefault(a, set()).add(b)
    hops, front = {start: 1}, {start}
    for hop in range(2, cap + 1):
        front = {b for a in front for b in after.get(a, ())} - hops.keys()
        hops.update(dict.fromkeys(front, hop))
    return {(start, h, u) for u, h in hops.items()}


def check(spark, pairs, starts, cap):
    got = follow_next(links(spark, pairs), seeds(spark, *starts), cap).collect()
    want = set().union(*(walk(pairs, s, cap) for s in starts))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_chain_takes_few_jobs(spark, monkeypatch):
    rounds = []
    write = traverse._write_round
    monkeypatch.setattr(traverse, "_write_round", lambda *a, **k: rounds.append(1) or write(*a, **k))
    pairs = [(f"p{i}", f"p{i + 1}") for i in range(999)]
    # adaptive shuffles and broadcasts count as jobs of their own
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    try:
        out = follow_next(links(spark, pairs), seeds(spark, "p0"), 1000)
        jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.hop, r.url) for r in out.collect()} == {(i + 1, f"p{i}") for i in range(1000)}
    assert len(rounds) == 11 and jobs <= 12


@pytest.mark.parametrize("cap", [1, 2, 3, 7, 8, 9, 100])
def test_caps_cycles_and_joining_chains(spark, cap):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(20)]
    pairs += [("b0", "b1"), ("b1", "b2"), ("b2", "b0")]  # a cycle
    pairs += [("c0", "c1"), ("c1", "b1")]  # leads into it
    pairs += [("d", "d"), ("e", "a15"), ("f", None), ("a3", "a4")]  # itself, into a chain, no next, a repeated link
    check(spark, pairs, ["a0", "a7", "b0", "c0", "d", "e", "f", "unknown"], cap)


def test_random_paths(spark):
    rng = random.Random(5)
    for _ in range(2):
        pairs = [(f"n{i}", f"n{rng.randrange(60)}") for i in range(60) if rng.random() < 0.9]
        check(spark, pairs, [f"n{i}" for i in range(0, 60, 7)], 13)


def test_branching_links(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("c", "e")]
    check(spark, pairs, ["a", "d"], 4)


@pytest.mark.parametrize("cap", [5, 1000])
def test_forks_on_chains(spark, cap):
    """Chains that pass pages twice, with cycles, self-links, joining chains and seeds on forks, and a seed without a URL."""
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(12)]
    pairs += [("a3", "a9"), ("a9", "a1"), ("a5", "a5"), ("a7", "b0"), ("b0", "b1"), ("b1", "a3"), ("c0", "a4"), ("c0", "c1"), ("c1", None), ("x", "x")]
    starts = ["a0", "a3", "a9", "b0", "c0", "c1", "x", "unknown", None]
    check(spark, pairs, starts, cap)


def test_random_forks(spark):
    rng = random.Random(7)
    pairs = [(f"n{i}", f"n{rng.randrange(50)}") for i in list(range(50)) + rng.sample(range(50), 12)]
    check(spark, pairs, [f"n{i}" for i in range(0, 50, 9)], 100)


def test_repeated_pages_take_few_jobs(spark):
    """A long chain that passes some pages again is not walked hop by hop."""
    order = [f"p{i}" for i in range(600)]
    order[100], order[250], order[400] = "p40", "p300", "p50"
    pairs = list(zip(order, order[1:]))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    sc.setJobGroup("forks", "forks")
    try:
        out = follow_next(links(spark, pairs), seeds(spark, "p0"), 1 << 30)
        jobs = len(sc.statusTracker().getJobIdsForGroup("forks"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in out.collect()} == walk(pairs, "p0", 700)
    assert jobs < 40  # a hop took two


def test_many_seeds_on_one_page(spark):
    """A hot page: every chain leads to it."""
    pairs = [(f"s{i}", "hub") for i in range(500)] + [("hub", "x"), ("x", "y")]
    check(spark, pairs, [f"s{i}" for i in range(500)], 10)


def test_empty_tables(spark):
    assert follow_next(links(spark, [("a", "b")]), seeds(spark), 5).count() == 0
    assert [tuple(r) for r in follow_next(links(spark, []), seeds(spark, "a", "a"), 5).collect()] == [("a", 1, "a")]
    with pytest.raises(ValueError):
        follow_next(links(spark, []), seeds(spark, "a"), 0)
