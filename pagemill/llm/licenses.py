"""License scan: exact set-similarity join of text blocks with license templates.

A text is covered by overlapping blocks of words so that any run as long as
the longest template lies whole in one block.  A block matches a template if it
contains at least ``threshold`` of the template's distinct words.  The join is
exact and filtered in the usual order:

* prefix: tokens are ordered by their document frequency in the whole corpus,
  rarest first; a match must share one of the ``|T| - need + 1`` rarest of ``T``;
* length: the block needs at least ``need`` template words;
* position: the shared token's places in both ordered lists must leave room
  for ``need`` tokens in common.

Survivors are verified by their complete overlap.  The base phrases are
templates with a threshold of one; where such a block is found, the phrase's
consecutive places are read off it.

The templates are a parameter of bounded size; the corpus is read twice (token
frequencies, join) and never shuffled.

Defined cases: null and empty texts have no words, no places, no labels and
score 0; repeated rows are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD_BYTES, add_columns, in_arrow, words

STRIDE = 32  # words from one block to the next
THRESHOLD = Fraction(9, 10)

# The phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences by which texts announce their license, and the label of each.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution license": "cc-by",
}


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool
    need: int  # distinct words a block must contain


def templates(base: dict[str, str], wider: dict[str, str], threshold: Fraction) -> list[Template]:
    out = []
    for phrases, is_base, t in ((base, True, Fraction(1)), (wider, False, threshold)):
        for phrase, label in phrases.items():
            ws = tuple(words(phrase))
            out.append(Template(ws, label, is_base, -(-len(set(ws)) * t.numerator // t.denominator)))
    return out


def token_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template word (a row per word reaches the driver)."""
    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                raw = t.as_py()
                if raw:
                    total.update(vocabulary.intersection(raw.encode().translate(WORD_BYTES).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    parts = in_arrow(docs.select("text"), count, "w binary, n long")
    return {bytes(r.w): r.n for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Prefix index of the templates over one global token order."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int], stride: int = STRIDE):
        vocabulary = sorted({w for t in found for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = found
        self.ordered = [sorted({self.rank[w] for w in t.words}) for t in found]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (t, ranks) in enumerate(zip(found, self.ordered)):
            for i, r in enumerate(ranks[:len(ranks) - t.need + 1]):
                self.prefix.setdefault(r, []).append((k, i))
        self.rare = {vocabulary[r] for r in self.prefix}
        self.stride = stride
        self.reach = stride + max(len(t.words) for t in found) - 1

    def join(self, block: list[bytes]) -> dict[int, float]:
        """Containment by template for every template that the block matches."""
        ranks = sorted({self.rank[w] for w in block if w in self.rank})
        out: dict[int, float] = {}
        tried = set()
        for j, r in enumerate(ranks):
            for k, i in self.prefix.get(r, ()):
                need, mine = self.templates[k].need, self.ordered[k]
                if k in tried or len(ranks) < need:
                    continue
                tried.add(k)  # the first shared token: none before it is in both
                if 1 + min(len(mine) - i - 1, len(ranks) - j - 1) >= need:
                    both = len(set(mine).intersection(ranks))
                    if both >= need:
                        out[k] = both / len(mine)
        return out

    def near(self, ws: list[bytes]) -> list[int]:
        """Numbers of the blocks that hold a word of some template's prefix."""
        if self.rare.isdisjoint(ws):
            return []
        at = np.array([i for i, w in enumerate(ws) if w in self.rare])
        return sorted({int(b) for back in range(0, self.reach + self.stride, self.stride) for b in (at // self.stride - back // self.stride) if b >= 0})

    def matches(self, ws: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment): the best of each stretch of neighbouring blocks that match."""
        best: dict[int, tuple] = {}  # of the stretch that a template is in: last block, block, containment
        out = []

        def end(k: int) -> None:
            _, b, containment = best.pop(k)
            known = {w for w in self.templates[k].words}
            at = [i for i in range(b * self.stride, min(b * self.stride + self.reach, len(ws))) if ws[i] in known]
            out.append((k, at[0], at[-1], containment))

        for b in self.near(ws):
            got = self.join(ws[b * self.stride:b * self.stride + self.reach])
            for k in [k for k, v in best.items() if k not in got or v[0] != b - 1]:
                end(k)
            for k, containment in got.items():
                last = best.get(k)
                best[k] = (b, b, containment) if last is None or containment > last[2] else (b, *last[1:])
        for k in list(best):
            end(k)
        return sorted(out)

    def scan(self, text: str) -> tuple:
        ws = words(text)
        blocks = self.near(ws)
        if not blocks:
            return len(ws), 0, None, None, "", "", 0.0
        starts, base, labels, score = [], set(), set(), 0.0
        for b in blocks:
            begin = b * self.stride
            for k, containment in self.join(ws[begin:begin + self.reach]).items():
                t = self.templates[k]
                if not t.base:
                    labels.add(t.label)
                    score = max(score, containment)
                    continue
                n = len(t.words)
                at = [p for p in range(begin, min(begin + self.stride, len(ws) - n + 1)) if ws[p] == t.words[0] and tuple(ws[p:p + n]) == t.words]
                if at:
                    starts += at
                    base.add(t.label)
                    score = 1.0
        labels |= base
        return (len(ws), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score)


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, wider: dict[str, str] = TEMPLATES,
                 threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = templates(base, wider, threshold)
    index = Index(found, token_frequencies(docs, {w for t in found for w in t.words}))
    got = add_columns(docs, "text", lambda: lambda texts: list(zip(*map(index.scan, texts))),
                      "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", keep=["doc_id"])
    return got.withColumnRenamed("_k0", "doc_id")


def by_length(found: list[Template], frequency: dict[bytes, int]) -> list[Index]:
    """An index for the templates of every size class, with blocks of that size: whole license texts beside single sentences."""
    classes: dict[int, list[Template]] = {}
    for t in found:
        classes.setdefault(len(t.words).bit_length(), []).append(t)
    return [Index(ts, frequency, max(STRIDE, max(len(t.words) for t in ts) // 2)) for _, ts in sorted(classes.items())]


def license_blocks(docs: DataFrame, texts: dict[str, str], threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per block that matches a template: doc_id, template, first_word, last_word, containment.

    ``texts`` maps names to license texts of any length.  Of neighbouring blocks that match one template,
    the one of greatest containment is told, from its first to its last word of the template.
    """
    names = {}
    for name, text in texts.items():  # templates without words match nothing
        if ws := tuple(words(text)):
            names[name] = Template(ws, name, False, -(-len(set(ws)) * threshold.numerator // threshold.denominator))
    indexes = by_length(list(names.values()), token_frequencies(docs, {w for t in names.values() for w in t.words}))

    def find(texts_: list) -> list:
        rows = []
        for text in texts_:
            ws = words(text)
            rows.append([{"template": x.templates[k].label, "first_word": i, "last_word": j, "containment": c} for x in indexes for k, i, j, c in x.matches(ws)])
        return [rows]

    got = add_columns(docs.select("doc_id", "text"), "text", lambda: find,
                      "_blocks array<struct<template:string,first_word:bigint,last_word:bigint,containment:double>>", keep=["doc_id"])
    return got.select(F.col("_k0").alias("doc_id"), F.inline("_blocks"))
