"""License scan, decontamination, toxicity and quality against brute force and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np

from pagemill.llm import decontaminate, licenses, quality, toxicity
from pagemill.llm.common import words
from tests.llm.data import documents, empty_documents, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_words_follow_the_pattern():
    for t in ["", "A b-c_d9é", "x\x7fy\x80z É", "[a]{b}~c`d", "日本 語!x y"]:
        assert [w.decode() for w in words(t)] == _words(t)
    assert words(None) == []


def _license_texts(seed):
    rng = random.Random(seed)
    lines = ["Released under the MIT License.", "mit\nlicense", "Licensed under the Apache License, Version 2.0.", "apache, license; apache license",
             "GNU General Public License, version 3.", "general public", "license general public license", "Licensed under CC BY-NC 4.0.",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"]
    out = []
    for _ in range(80):
        parts = [prose(rng, rng.randint(0, 90)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(lines))
        out.append(" ".join(parts))
    return out + ["mit license " * 300, None, "", "mit", "license"]


def test_license_base_places_match_brute_force(spark):
    texts = _license_texts(3)
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = _words(t)
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(ws))
                  if ws[p:p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        base = sorted({label for _, label in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(base))
        assert set(base) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not base)


def test_license_join_is_exact():
    """The filters lose no block that brute-force containment finds."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    wider = {" ".join(rng.choices(vocabulary, k=rng.randint(3, 9))): f"l{i}" for i in range(25)}
    found = licenses.templates({}, wider, licenses.Fraction(3, 5))
    index = licenses.Index(found, {w.encode(): rng.randint(0, 50) for w in vocabulary})
    matches = 0
    for _ in range(400):
        block = [w.encode() for w in rng.choices([*vocabulary, "x", "y"], k=rng.randint(0, 25))]
        want = {k: len(set(t.words) & set(block)) / len(set(t.words)) for k, t in enumerate(found) if len(set(t.words) & set(block)) >= t.need}
        assert index.join(block) == want
        matches += len(want)
    assert matches > 100


def test_license_method_labels(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "plain words under the sun mit der license", "x"]
    rows = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert (rows[0].labels, rows[0].base_labels, rows[0].n_base) == ("cc-by-nc", "", 0) and rows[0].score >= 0.9
    assert (rows[1].labels, rows[1].score) == ("", 0.0)
    assert licenses.license_scan(empty_documents(spark)).count() == 0


def _brute_hits(texts, items, window=10):
    out = []
    for t in texts:
        ws, hit, found, longest = _words(t), set(), set(), 0
        for i, item in items:
            iw = _words(item)
            n = min(window, len(iw))
            keys = {tuple(iw[p:p + n]) for p in range(len(iw) - n + 1)} if n else set()
            for p in range(len(ws) - n + 1):
                if n and tuple(ws[p:p + n]) in keys:
                    hit.update(range(p, p + n))
                    found.add(str(i))
            for p in range(len(ws)):
                for q in range(len(iw)):
                    k = 0
                    while p + k < len(ws) and q + k < len(iw) and ws[p + k] == iw[q + k]:
                        k += 1
                    if n and k >= n:
                        longest = max(longest, k)
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest))
    return out


def _benchmark_case(spark, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([0, 1, 4, 9, 10, 11, 25]))) for i in range(14)]
    items += [(50, items[6][1]), (51, None), (52, "a a a a a a a a a a a a"), (100, prose(rng, 30)), (9, "zz")]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(2)]
        for _ in range(rng.randint(0, 2)):
            ws = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(ws) - 10))
            parts.insert(rng.randrange(3), " ".join(ws[a:a + rng.randint(5, 30)]).upper())
        texts.append(", ".join(parts))
    texts += [None, "", "a " * 40, items[8][1]]
    return documents(spark, texts), texts, spark.createDataFrame(items, "item_id long, text string"), items


def test_decontamination_matches_brute_force(spark):
    docs, texts, bench, items = _benchmark_case(spark, 6)
    want = _brute_hits(texts, items)
    assert sum(w[4] for w in want) > 10
    for block in (1 << 20, 200):  # one block, many blocks
        rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_bytes=block).collect()}
        got = [(rows[i].n_words, sum(x.stop - x.start for x in rows[i].ranges), len(rows[i]["items"]),
                hashlib.sha256(",".join(rows[i]["items"]).encode()).hexdigest(), bool(rows[i].ranges), rows[i].longest) for i in range(len(texts))]
        assert got == want
        kept = decontaminate.remove_contaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[4]]
    report = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for _, r in sorted(report.items())] == [w[:5] for w in want]


def test_decontamination_longest_match_place(spark):
    words_ = [f"w{i}" for i in range(30)]
    docs = documents(spark, ["start here " + " ".join(words_[3:20]) + " end"])
    r = decontaminate.contamination(docs, spark.createDataFrame([(7, " ".join(words_))], "item_id long, text string")).first()
    assert (r.longest, r.longest_at, r.longest_item, [tuple(x) for x in r.ranges]) == (17, 2, "7", [(2, 19)])


def test_license_blocks_of_whole_texts(spark):
    """Long and short templates; every block whose containment reaches the threshold, against all blocks."""
    rng = random.Random(21)
    texts = {"long": prose(rng, 700), "middle": prose(rng, 120), "short": "released under the zeta license", "empty": " ."}

    def spoil(t, share):
        return " ".join(w for w in t.split() if rng.random() > share)

    docs = [prose(rng, 300) + " " + spoil(texts["long"], 0.02) + " " + prose(rng, 300), texts["middle"] + " " + prose(rng, 900) + " " + texts["middle"],
            "x " + texts["short"].upper() + " y", spoil(texts["long"], 0.3), None, "", prose(rng, 50)]
    rows = licenses.license_blocks(documents(spark, docs), texts).collect()
    assert sorted((r.doc_id, r.template) for r in rows) == [(0, "long"), (1, "middle"), (1, "middle"), (2, "short")]
    by = {r.template: r for r in rows}
    assert (by["short"].first_word, by["short"].last_word, by["short"].containment) == (1, 5, 1.0) and by["long"].containment >= 0.9
    found = [licenses.Template(tuple(words(t)), n, False, -(-len(set(words(t))) * 9 // 10)) for n, t in texts.items() if words(t)]
    for index in licenses.by_length(found, {}):
        for d in docs:
            ws = words(d)
            held = {b: {k for k, t in enumerate(index.templates) if len(set(t.words) & set(ws[b * index.stride:b * index.stride + index.reach])) >= t.need}
                    for b in range(len(ws) // index.stride + 1)}
            runs = sum(k not in held.get(b - 1, ()) for b, ks in held.items() for k in ks)
            assert len(index.matches(ws)) == runs
    assert licenses.license_blocks(empty_documents(spark), texts).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 3), (1, 3), (300, 3), (300, 40), (400, 1)):
        ids = np.append(rng.integers(0 if kinds > 1 else 1, kinds + 1, n), 0).astype(np.uint32)
        if kinds == 1:
            ids[200:] = 0

        def suffix(p):
            stop = p + int(np.flatnonzero(ids[p:] == 0)[0])
            return ids[p:stop].tolist()
        array = decontaminate.suffix_array(ids).tolist()
        assert sorted(array) == np.flatnonzero(ids).tolist()
        assert all(suffix(a) <= suffix(b) for a, b in zip(array, array[1:]))


def test_matches_equal_brute_force():
    """Every left- and right-maximal match of at least a window, against trying all pairs of places."""
    rng = random.Random(4)
    for window in (2, 3, 10):
        items = [(f"i{k}", [b"%d" % rng.randint(0, 4) for _ in range(rng.randint(0, 14))]) for k in range(12)]
        tests = decontaminate.TestSuffixes(items, window)
        doc = [rng.randint(0, 6) for _ in range(200)]
        ids = np.array([tests.number.get(b"%d" % x, 0) for x in doc] + [0], np.uint32)
        want = []
        for k, (_, ws) in enumerate(items):
            num = [tests.number[w] for w in ws]
            for p in range(200):
                for q in range(len(num)):
                    if q and p and num[q - 1] == ids[p - 1]:
                        continue
                    n = 0
                    while q + n < len(num) and num[q + n] == ids[p + n]:
                        n += 1
                    if n and n >= min(window, len(num)):
                        want.append((p, n, k))
        got = decontaminate._search(ids, tests)
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(want) and len(want) > 5


def test_longest_match_is_told_alike_by_any_blocks(spark):
    docs = documents(spark, ["a b c d e f g h i j k l m x a b c d e f g h i j k l m n", "q " * 30, "r s t u v w x y z A B C"])
    bench = spark.createDataFrame([("b", "a b c d e f g h i j k l m"), ("a", "a b c d e f g h i j k l m"), ("c", "q " * 12), ("d", "q " * 14),
                                   ("e", "s t u v w x y z A B"), ("f", "r s t u v w x y z a")], "item_id string, text string")
    rows = {}
    for block in (1 << 20, 30, 1):
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        rows[block] = sorted((r.doc_id, r.longest, r.longest_at, r.longest_item, tuple(map(tuple, r.ranges)), tuple(r["items"])) for r in got)
    assert rows[1 << 20] == rows[30] == rows[1]
    assert [r[1:4] for r in rows[1]] == [(13, 0, "a"), (14, 0, "d"), (10, 0, "f")]


def test_decontamination_empty_tables(spark):
    docs, texts, bench, _ = _benchmark_case(spark, 8)
    assert decontaminate.contamination_report(empty_documents(spark), bench).count() == 0
    clean = decontaminate.contamination_report(docs, bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)
    repeated = decontaminate.contamination_report(docs.unionAll(docs), bench).count()
    assert repeated == 2 * len(texts)


def _labelled(spark, seed, bad_text):
    rng = random.Random(seed)
    texts, marks = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        t = prose(rng, rng.randint(5, 120))
        texts.append(bad_text(rng, t) if bad else t)
        marks.append(int(bad))
    return documents(spark, texts + ["", None, "one"]), marks


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_whole_text_marginals_equal_one_pass():
    """Blocks of words with messages between them give what one forward-backward over each text gives."""
    rng = np.random.default_rng(5)
    for trans in (np.array([[0.0, -2.0], [-1.0, 1.5]]), np.array([[0.0, 3.0], [0.5, -4.0]])):
        lengths = [0, 1, 5, 63, 64, 65, 128, 129, 400, 0, 700]
        values = [rng.normal(-1, 3, n) for n in lengths]
        blocks = toxicity.Blocks(lengths)
        before, previous, ahead = toxicity.messages(blocks.lay(np.concatenate(values)), blocks, trans)
        got = blocks.take(toxicity._marginal(before, ahead))
        for v, m in zip(values, got):
            assert len(m) == len(v) and (not len(v) or np.allclose(m, toxicity.forward_backward(v[None], trans)[0][0], atol=1e-9))


def test_field_fits_across_block_borders():
    """Runs of toxic words across every 64th word: the fitted transitions know them."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        y = np.zeros(300)
        y[50:80] = 1
        y[180:200] = 1
        x = np.stack([y * (rng.random(300) < 0.5) * 3 + rng.normal(0, 0.2, 300), np.zeros(300)], axis=1)
        texts.append((x, y))
    weights, trans = toxicity.fit_field(texts)
    assert trans[1, 1] - trans[1, 0] > 1 and trans[0, 1] < -1 and weights[1] > 0.5
    blocks = toxicity.Blocks([300])
    before, _, ahead = toxicity.messages(blocks.lay(weights[0] + texts[0][0] @ weights[1:]), blocks, trans)
    assert ((toxicity._marginal(before, ahead).reshape(-1)[blocks.at] > 0.5) == texts[0][1]).mean() > 0.97


def test_shared_passages_are_no_copies():
    """Texts that share 30 % of their words stay, and their toxic words still count; copies go."""
    rng = random.Random(12)
    shared = prose(rng, 30)
    texts = [f"{shared} {prose(rng, 70)}" + (f" vilefoo nastybar {prose(rng, 3)}" if i % 2 else "") for i in range(400)]
    sample = [(words(t), i % 2) for i, t in enumerate(texts)]
    kept = toxicity.without_copies(sample)
    assert len(kept) > 340 and 0.4 < sum(y for _, y in kept) / len(kept) < 0.6
    evidence = toxicity.evidence_of(kept)
    assert {b"=vilefoo", b"=nastybar"} <= evidence.keys()
    copies = [(words(t), i % 2) for i, t in enumerate(texts)] + [(words(t + " tail"), i % 2) for i, t in enumerate(texts)]
    assert len(toxicity.without_copies(copies)) <= len(kept) + 25
    assert len(toxicity.without_copies([(words(texts[0]), 0), (words(texts[0]), 1)])) == 2  # of the other label


def test_toxicity_on_held_out_rows(spark):
    bad_words = ["vilefoo", "nastybar", "grimbaz"]

    def spoil(rng, t):
        ws = t.split()
        for _ in range(rng.randint(2, 5)):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad_words) + rng.choice(["", "an", "or"]))
        return " ".join(ws)

    docs, marks = _labelled(spark, 13, spoil)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(0, 1, marks[0]), (9999, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(rows) == len(marks) + 3 and all(rows[i].held_out == _held(i) for i in rows)
    held = [i for i in range(len(marks)) if _held(i)]
    assert np.mean([rows[i].predicted == marks[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert rows[len(marks)].score == rows[len(marks) + 1].score < 0.5
    spans = {r.doc_id: r for r in toxicity.toxic_spans(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in held:
        if marks[i]:
            assert any(w in texts[i][s.start:s.stop].lower() for s in spans[i].spans for w in bad_words)


def test_toxicity_ignores_held_out_labels(spark):
    docs, marks = _labelled(spark, 14, lambda rng, t: t + " vilefoo vilefoo")
    base = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - m if _held(i) else m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity_scores(docs, x).collect()} for x in (base, other))
    assert a == b


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    emission, trans = rng.normal(size=(3, 6)), np.array([[0.0, -1.2], [0.4, 0.7]])
    marginal, pairs, z = toxicity.forward_backward(emission, trans)
    expected = np.zeros((2, 2))
    for row, m, logz in zip(emission, marginal, z):
        total, hits = 0.0, np.zeros(6)
        for code in range(64):
            path = [code >> t & 1 for t in range(6)]
            weight = np.exp(sum(row[t] * path[t] for t in range(6)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += weight
            hits += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                expected[a, b] += weight / np.exp(logz)
        assert np.isclose(np.log(total), logz) and np.allclose(hits / total, m)
    assert np.allclose(pairs, expected)


def test_untrainable_classifiers_give_the_share(spark):
    docs = documents(spark, ["a", "b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    assert {(r.score, r.predicted) for r in quality.quality_scores(docs, none).collect()} == {(0.5, 1)}
    assert toxicity.toxicity_scores(empty_documents(spark), none).count() == 0
    assert quality.quality_scores(empty_documents(spark), none).count() == 0
    assert quality.keep_good(docs, none).count() == 3


def _junk(rng, t):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "$%&" for w in t.split())
    return t.upper().replace(" ", "!! ") if kind == 1 else " ".join(w for w in t.split()[:8] for _ in range(15))


def test_quality_matches_direct_fit_and_held_out_rows(spark):
    docs, marks = _labelled(spark, 21, _junk)
    good = [1 - m for m in marks]
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    train = {y: np.array([x[i] for i, g in enumerate(good) if g == y and not _held(i)]) for y in (0, 1)}
    total = sum(map(len, train.values()))
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in train.values()) / total
    density = {}
    for y, v in train.items():
        cov = (1 - quality.SHRINKAGE) * np.cov(v.T, bias=True) + quality.SHRINKAGE * pooled + quality.FLOOR * np.eye(len(pooled))
        inverse, log_det, prior = np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log((len(v) + 1) / (total + 2))
        density[y] = {i: prior - 0.5 * log_det - 0.5 * (a - v.mean(0)) @ inverse @ (a - v.mean(0)) for i, a in x.items()}
    for i, r in rows.items():
        assert np.isclose(r.score, 1 / (1 + np.exp(np.clip(density[0][i] - density[1][i], -500, 500))), atol=1e-6)
        assert r.held_out == _held(i) and r.predicted == int(r.score >= 0.3)
    held = [i for i in range(len(good)) if _held(i)]
    assert np.mean([rows[i].predicted == good[i] for i in held]) >= 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
