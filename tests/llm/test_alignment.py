"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagemill.llm import alignment
from tests.llm.data import documents, empty_documents, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "a<|endoftext|>b <s>x</s> <unk>", "it's I'LL don't 's 's", "é É é ﬁ Ǆ İ ß ½ ² ٣ 中文字 日本語のテキスト 😀 👩‍👩‍👧 à",
       "a▁b c", "▁", "x ▁y z", "tabs\tand\r\nlines\n\n\n  indent\n", "\x00\x01 \x1c \x85 \xa0   ​ ﻿ end", "=" * 500, " " * 300 + "x", "x" + " " * 77,
       "ａｂｃ ＡＢＣ ① ㎏ ﷺ", "12345 3.14159 1,000,000", "Ünïcödé wörds × ÷ ÿ Ā ſ", "l'été à Noël", "é gä ́", "▁▁ a", "ab\u0000cd ef", "a" * 2000]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        alphabet = alignment._byte_alphabet()
        self.a_bytes = lambda i: bytes(alphabet[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """Groups of a text as (A ids, B ids); none without tokens."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.a_bytes, a)) != (" " + text).encode() or b"".join(map(self.b_bytes, b)) != (" " + text).encode():
            return []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        out, i, j = [], 0, 0
        at = [{e: k + 1 for k, e in enumerate(es)} for es in ends]
        for cut in sorted(at[0].keys() & at[1].keys()):
            x, y = at[0][cut], at[1][cut]
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    def report(self, texts):
        split = [self.groups(t) for t in texts]
        links = [Counter((x, y) for a, b in gs for x in a for y in b) for gs in split]
        count = Counter(p for c in links for p in c)
        best = {}
        for (x, _), n in count.items():
            best[x] = max(n, best.get(x, 0))
        rows = []
        for i, (gs, c) in enumerate(zip(split, links)):
            digest = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs).encode()).hexdigest() if gs else ""
            rows.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(c.values()),
                         sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), digest))
        return rows, count, links


def mixed(seed, n):
    rng = random.Random(seed)
    alphabet = "abcXYZ 019.,'’-\n\tsdéÉßœ中𝒳́ <|>▁"
    return [prose(rng, rng.randint(0, 80)) for _ in range(n)] + ["".join(rng.choices(alphabet[:-1] if rng.random() < 0.8 else alphabet, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [8, 64, 8192])
def test_report_equals_plain(spark, chunk):
    texts = ODD + mixed(chunk, 60) + ["the same text the same"] * 30
    want, _, _ = Plain().report(texts)
    got = alignment.alignment_report(documents(spark, texts), chunk=chunk)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert sum(1 for r in want if not r[1]) > 3 and sum(r[3] for r in want) > 1000


def test_token_pairs(spark):
    texts = ODD + mixed(2, 30) + ["a a a a a b"] * 20
    _, count, links = Plain().report(texts)
    index = alignment.invert(documents(spark, texts), A, B, 16, most_links=200)
    got = {(r.id_a, r.id_b): (r.documents, r.links, r.best) for r in alignment.token_pairs(index).collect()}
    total = Counter()
    for c in links:
        total.update(c)
    best = {x: max(n for (a, _), n in count.items() if a == x) for x, _ in count}
    assert got == {p: (n, total[p], n == best[p[0]]) for p, n in count.items()}


@pytest.mark.parametrize("long, batch, wide", [(1 << 20, 1 << 20, 1 << 22), (5, 40, 7), (30, 10, 1)])
def test_parts_equal_whole_texts(monkeypatch, long, batch, wide):
    for name, value in (("LONG", long), ("BATCH", batch), ("WIDE", wide)):
        monkeypatch.setattr(alignment, name, value)
    plain, pair = Plain(), alignment.Pair(A, B)
    assert pair.parts
    texts = [t or "" for t in ODD] + mixed(5, 150)
    got = [x for i in range(0, len(texts), 9) for x in pair.align(texts[i:i + 9])]
    assert max(len(pair.cut(t)) for t in texts) > 3 or long > 100
    for t, (figures, pairs, times) in zip(texts, got):
        gs = plain.groups(t)
        links = Counter((x << 16) + y for a, b in gs for x in a for y in b)
        assert figures[:4] == [sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(links.values())], t
        assert figures[4] == (hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs).encode()).hexdigest() if gs else "")
        assert dict(zip(pairs.tolist(), times.tolist())) == links


def test_both_libraries_give_the_same_ids():
    pair = alignment.Pair(A, B)
    assert pair.ranked is not None
    texts = [" " + (t or "") for t in ODD] + mixed(9, 300) + [" " * 250_000, "\n" * 30_000 + "x", "a" * 50_000, "é" * 20_000]
    got = pair._ids_a(texts)
    pair.ranked = None
    assert got == pair._ids_a(texts)


@pytest.mark.parametrize("n_groups", [6, 40])
def test_wide_and_narrow_groups(monkeypatch, n_groups):
    monkeypatch.setattr(alignment, "WIDE", 5)
    rng = np.random.default_rng(1)
    ga, gb = (np.sort(np.concatenate([np.arange(n_groups), rng.integers(0, n_groups, k)])) for k in (54, 44))
    a, b, owner = rng.integers(0, 5, len(ga)), rng.integers(0, 5, len(gb)), np.sort(rng.integers(0, 3, n_groups))
    want = Counter((int(owner[g]) << 32) + int(x) * alignment.IDS_B + int(y) for g, x in zip(ga, a) for h, y in zip(gb, b) if g == h)
    per_a, per_b = np.bincount(ga), np.bincount(gb)
    keys, times = alignment._pairs(ga, a, gb, b, owner, per_a, per_b, np.cumsum(per_b) - per_b)
    assert dict(zip(keys.tolist(), times.tolist())) == want and (np.diff(keys) > 0).all()


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 1000, 1024])
def test_bitmaps(n):
    places = np.sort(np.random.default_rng(n).permutation(1024)[:n])
    bits = alignment.bitmap(places, 1024)
    assert len(bits) <= 128 and (alignment.places_of(bits, 1024) == places).all()


def test_empty_null_ids_and_bad_chunks(spark):
    assert alignment.alignment_report(empty_documents(spark)).count() == 0
    rows = alignment.alignment_report(documents(spark, ["a b", "a b", None], [None, None, 3])).collect()
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in rows) == [("3", 0, 0), ("None", 2, 4), ("None", 2, 4)]
    for chunk in (4, 12, 1 << 17):
        with pytest.raises(ValueError):
            alignment.invert(documents(spark, ["a"]), A, B, chunk)


def test_long_text(spark):
    rng = random.Random(3)
    texts = ["word " * 120_000, prose(rng, 60_000), "中" * 20_000]
    want, _, _ = Plain().report(["word " * 120_000, "", ""])
    got = sorted(map(tuple, alignment.alignment_report(documents(spark, texts)).collect()))
    assert got[0][1:6] == want[0][1:6] and got[0][7] == want[0][7]
    assert got[1][3] > 60_000 and got[2][1] > 0
