"""Exact, line and near de-duplication against brute force."""

import hashlib
import random
from collections import defaultdict

import xxhash

from pagemill.llm import exact_dedup, line_dedup, simhash
from tests.llm.data import documents, empty_documents, prose


def _texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    near = [b + " tail" for b in base[:10]] + [b.upper() for b in base[:5]]
    return base + base[:15] + base[:3] * 20 + near + ["", None, "", " ", "one", "two words", "Straße É é"]


def test_exact_report_matches_brute_force(spark):
    texts = _texts()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in enumerate(texts)}
    for bound in (1 << 26, 0):  # broadcast filter, joined filter
        got = exact_dedup.duplicate_report(documents(spark, texts), broadcast_bytes=bound).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
        assert len(got) == len(texts)


def test_exact_filter_lets_no_repeat_pass(spark):
    docs = documents(spark, _texts(2))
    keys = exact_dedup.keys_of(docs)
    marked = exact_dedup.repeat_test(keys)(keys)
    sizes = keys.groupBy("_sha").count().filter("count > 1").select("_sha")
    assert marked.join(sizes, "_sha").filter("not _maybe").count() == 0
    assert marked.filter("not _maybe").count() > 0


def test_deduplicate_keeps_columns_and_one_row_each(spark):
    texts = _texts(3) + ["same row", "same row"]
    ids = [*range(len(texts) - 2), 900, 900]
    docs = documents(spark, texts, ids)
    for bound in (1 << 26, 0):
        got = exact_dedup.deduplicate(docs, broadcast_bytes=bound)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == len({t or "" for t in texts})
        last = {t or "": i for i, t in zip(ids, texts)}
        assert {(r.text or "", r.doc_id) for r in rows} == set(last.items())


def test_exact_null_ids_and_empty(spark):
    rows = exact_dedup.duplicate_report(documents(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows) == [
        ("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 1, True)]
    assert exact_dedup.duplicate_report(empty_documents(spark)).count() == 0
    assert exact_dedup.deduplicate(empty_documents(spark)).count() == 0


def _line_key(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(rng, 12) for _ in range(6)]
    texts = []
    for i in range(60):
        lines = [prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 5))] + rng.sample(shared, rng.randint(0, 4))
        rng.shuffle(lines)
        lines = ["\t " + x.upper() + "\r" if rng.random() < 0.3 else x for x in lines]
        texts.append("\n".join(lines + lines[:1]))
    texts += [None, "", "\n", "\n\n", "É" * 39, "É" * 40]
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(_line_key(x)) >= 40:
                holders[_line_key(x)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert drop
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(documents(spark, texts)).collect()}
    report = {r.doc_id: r for r in line_dedup.line_report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(_line_key(x), i) == i]
        assert got[i].kept_text == "\n".join(kept)
        assert (report[i].n_lines, report[i].n_dropped) == (len(lines), len(lines) - len(kept))
        assert report[i].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert got[i].kept == "x" and got[i]._id == 7  # other columns stay


def test_lines_repeated_rows_and_empty(spark):
    line = "this line is long enough to be counted as a key"
    texts = [line] * 6 + ["other\n" + line]
    ids = [0, 0, 1, 2, 3, 4, 9]  # five documents and the holder that stays; document 0 twice
    rows = line_dedup.line_report(documents(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in rows) == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 0)]
    four = line_dedup.line_report(documents(spark, texts[:5], [0, 0, 1, 2, 3])).collect()
    assert all(r.n_dropped == 0 for r in four)  # a repeated document counts once
    assert line_dedup.line_report(empty_documents(spark)).count() == 0


def test_line_columns_of_the_same_names_are_replaced(spark):
    docs = documents(spark, ["a line", None]).selectExpr("*", "7 as n_lines", "'old' as kept_text")
    rows = line_dedup.drop_repeated_lines(docs).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in rows) == [(1, 0, ""), (1, 0, "a line")]


def _brute_fingerprint(text, k=3):
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
          .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_groups(fps, bits):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(9)
    long = [prose(rng, 300) for _ in range(8)]
    near = [t.replace(t.split()[k], "changed", 1) for t in long for k in (5, 90)]
    texts = _texts(7) + long + near + ["\x0bA\x0cb\tc d", "a b c d", "x y z"]
    fps = {i: _brute_fingerprint(t) for i, t in enumerate(texts)}
    for bits in (0, 1, 2):
        want = _brute_groups(fps, bits)
        got = simhash.near_duplicate_groups(documents(spark, texts), max_bits=bits).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
        assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_links_equal_brute_force_on_chains_and_crowds(spark):
    """Chains of single bits, and crowds around a centre that fill buckets, with and without pair comparison."""
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for _ in range(25):
        values.add(chain)
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    for _ in range(80):
        v = centre
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | (1 << 31), 1 << 32}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "_fp long")
    for bits in (0, 1, 2):
        whole = _brute_groups({v: v & ((1 << 64) - 1) for v in signed}, bits)
        classes = {frozenset(k for k in whole if whole[k] == c) for c in whole.values()}
        for bucket in (1, 16):
            label = {r.node: r.label for r in simhash.components(simhash.links(fps, bits, bucket)).collect()}
            found = defaultdict(set)
            for v in signed:
                found[label.get(v, v)].add(v)
            assert {frozenset(g) for g in found.values()} == classes


def test_simhash_keep_one(spark):
    texts = ["a b c d e", "A b c d e", "unrelated words in here", "", None, "a b c d e"]
    docs = documents(spark, texts, [5, 3, 4, 8, 9, None])
    got = simhash.keep_one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 8]
    assert simhash.keep_one_per_group(empty_documents(spark)).count() == 0
    assert simhash.near_duplicate_groups(empty_documents(spark)).count() == 0
