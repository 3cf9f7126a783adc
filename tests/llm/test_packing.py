"""Packing: exact cover of every document's ids, gapless sequences, and the mixture of windows."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import packing
from tests.llm.data import documents, empty_documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "it's can't I'LL 12ab <|endoftext|> x<|startoftext|>y", "é É é ﬁ Ǆ İ ß ẞ ª º µ 中文 ٣ ½ \x1c a\x0bb\x0cc d\x85e\xa0f",
       "'s's ''s 'sx x'S", " ​ à ','.;!!", " <| |> <|endof text|>", "ÀÖ×÷ÿ A1B2", "a.b,c..d,.e . , f", "tabs\tand\r\nlines"]


def _ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_piecewise_ids_are_the_tokenizers():
    ids = packing.Ids(PATH)
    rng = random.Random(1)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = "abcXYZ 019.,'’-\n\tsdéÉßœ中𝒳́ <|>"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)] + [prose(rng, 50) for _ in range(50)]
    for i in range(0, len(texts), 100):
        for t, got in zip(texts[i:i + 100], ids.of(texts[i:i + 100])):
            assert np.frombuffer(got, "<u2").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_ids_survive_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    ids, rng = packing.Ids(PATH), random.Random(2)
    for _ in range(20):
        texts = [prose(rng, 30) for _ in range(3)]
        assert [np.frombuffer(x, "<u2").tolist() for x in ids.of(texts)] == [_ids(t) for t in texts]


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_packing_covers_everything(spark, bound):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 5, 50, 400])) for _ in range(120)] + ODD
    sources = [rng.choice(["big"] * 6 + ["a", "b", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    length = 64
    rows = packing.pack(docs, PATH, length=length, window=4, broadcast_bytes=bound).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        want = _ids(t)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert all(r.doc_tokens == len(want) and r.length > 0 for r in pieces)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, places in by_sequence.items():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [o for o, _ in places] == [0, *ends[:-1]]
        assert ends[-1] == length or s == len(by_sequence) - 1 and ends[-1] <= length


def test_windows_hold_target_shares(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(20, 80)) for _ in range(200)]
    sources = ["big" if i % 3 else f"s{i % 5}" for i in range(len(texts))]
    length, window = 128, 8
    rows = packing.pack(documents(spark, texts, sources=sources), PATH, length=length, window=window).collect()
    total, given = defaultdict(int), defaultdict(int)
    for r in rows:
        total[sources[r.doc_id]] += r.length
    n = sum(total.values())
    for r in rows:  # the first window_count - 1 whole windows, from the layout's even split
        at = r.sequence_id * length + r.offset
        if at + r.length <= n // 2:
            given[sources[r.doc_id]] += r.length
    for s, t in total.items():
        assert abs(given[s] / (n // 2) - t / n) < 0.15
    layout = packing.Layout({1: 1000, 2: 300, 3: 7}, length=16, window=4)
    for w in range(layout.windows):
        sizes = [layout.given(t, w + 1) - layout.given(t, w) for t in layout.totals]
        for size, t in zip(sizes, layout.totals):  # a queue's share, with the deficit carried
            assert abs(size - t / layout.windows) < 1
    assert sum(layout.given(t, layout.windows) for t in layout.totals) == 1307


def _deficit_round_robin(docs, weights, quantum, queue_order):
    """Document order of the textbook loop; docs: queue -> [(id, size)]; a dry queue leaves its credit to the others."""
    left, credit, out = {q: list(d) for q, d in docs.items()}, dict.fromkeys(docs, Fraction(0)), []
    owed = {q: Fraction(sum(n for _, n in d)) for q, d in docs.items()}
    while any(left.values()):
        pool = Fraction(quantum)
        while pool and any(owed.values()):  # credit of this round, whose remainder goes to queues that are not dry
            active = {q: Fraction(weights[q]) for q in docs if owed[q]}
            share = {q: pool * w / sum(active.values()) for q, w in active.items()}
            part = min([Fraction(1)] + [owed[q] / share[q] for q in share])
            for q in share:
                credit[q], owed[q] = credit[q] + share[q] * part, owed[q] - share[q] * part
            pool -= pool * part
        for q in queue_order:
            while left[q] and left[q][0][1] <= credit[q]:
                doc, n = left[q].pop(0)
                credit[q] -= n
                out.append(doc)
    return out


@pytest.mark.parametrize("shares", [None, {"big": 1, "mid": 1, "tiny": 2.5}])
def test_whole_documents_by_deficit(spark, shares):
    rng = random.Random(5)
    sources = rng.choices(["big", "mid", "tiny"], [12, 5, 1], k=150)
    docs = documents(spark, [prose(rng, rng.randint(1, 40)) for _ in sources], sources=sources).coalesce(1)
    rows = packing.pack(docs, PATH, length=64, shares=shares).collect()
    at, size = defaultdict(lambda: 1 << 60), {}
    for r in rows:  # a document is one stretch, cut at sequence ends only
        at[r.doc_id], size[r.doc_id] = min(at[r.doc_id], r.sequence_id * 64 + r.offset - r.start), r.doc_tokens
        assert r.offset + r.length == 64 or r.start + r.length == r.doc_tokens
        assert r.sequence_id * 64 + r.offset == at[r.doc_id] + r.start
    total = sum(size.values())
    queues = {s: [(i, size[i]) for i, t in enumerate(sources) if t == s] for s in set(sources)}
    weights = shares or {s: sum(n for _, n in d) for s, d in queues.items()}
    number = {r.source: r.q for r in docs.select("source", packing._queue(docs["source"]).alias("q")).distinct().collect()}
    want = _deficit_round_robin(queues, weights, Fraction(total, -(-total // 64)), sorted(queues, key=number.get))
    assert sorted(size, key=at.get) == want


def test_target_shares_name_every_source(spark):
    docs = documents(spark, ["a", "b"], sources=["x", None])
    assert packing.pack(docs, PATH, shares={"x": 1, None: 2}).count() == 2
    for bad in ({"x": 1}, {"x": 1, None: 0}):
        with pytest.raises(ValueError):
            packing.pack(docs, PATH, shares=bad)


def test_report_digest_and_empty(spark):
    texts = ["one two three", None]
    rows = {r.doc_id: r for r in packing.pack_report(documents(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids_crc32 == zlib.crc32(np.array(_ids(t), "<u4").tobytes())
    assert packing.pack_report(empty_documents(spark)).count() == 0


def test_other_tokenizer_kind(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some text, it's here.  Twice spaced\n"
    r = packing.pack(documents(spark, [text]), path).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


def test_shares_of_many_sources(spark):
    """1,500 sources with their own shares: each keeps its order, and rounds follow the shares."""
    rng = random.Random(11)
    sources = [f"s{i}" for i in range(1500) for _ in range(2)]
    docs = documents(spark, [prose(rng, 3) for _ in sources], sources=sources)
    rows = packing.pack(docs, PATH, length=256, shares={f"s{i}": 1 + i % 7 for i in range(1500)}).collect()
    first = {r.doc_id: (r.sequence_id, r.offset) for r in rows if r.start == 0}
    assert len(first) == len(sources)
    place = defaultdict(list)
    for i, s in enumerate(sources):
        place[int(s[1:]) % 7].append(first[i][0])
    means = [np.mean(place[w]) for w in range(7)]
    assert means[6] < means[3] < means[0]  # a greater share is served earlier
