"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

SYLLABLES = "an ber con do el fin gar ho il jun ka lo mi nor op pra qui rus sta tur".split()


def prose(rng: random.Random, n: int) -> str:
    ws = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in ws)


def documents(spark, texts, ids=None, sources=None):
    """Documents with a few extra columns whose names operators use inside or return."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, len(t or ""), "x", 7, 0.5) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, _id int, score double")


def empty_documents(spark):
    return documents(spark, [])
