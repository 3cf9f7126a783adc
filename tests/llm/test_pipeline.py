"""The corpus pipeline against its stages done by hand, and its registered queries."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pagemill.llm import quality
from pagemill.llm.common import table
from tests.llm.test_dedup import _brute_fingerprint, _brute_groups
from tests.llm.test_scans import _words

SF = "/root/testdata/sf0.001"


def test_stages_on_small_table(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in quality.quality_scores(docs, table(spark, SF, "labels")).collect() if r.score >= 0.3}
    assert 0 < len(good) < len(kept)
    kept = {i: t for i, t in kept.items() if i in good}
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    groups = _brute_groups({i: _brute_fingerprint(t) for i, t in kept.items()}, 2)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = _words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if n else set()
    lengths = {len(k) for k in windows}
    kept = {i: t for i, t in kept.items()
            if not any(tuple(w[p:p + n]) in windows for w in [_words(t)] for n in lengths for p in range(len(w) - n + 1))}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == columns, name
    assert {r.doc_id: r.text or "" for r in step.collect()} == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    filled = rows.groupby("sequence_id")["length"].sum()
    assert (filled[:-1] == 4096).all() and np.array_equal(filled.index, range(len(filled)))


def test_stages_on_empty_table(spark):
    step = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert step.count() == 0


def test_registration():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_oracles_agree(spark):
    import duckdb
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("op1_chat", "op4_exact_dedup", "op6_line_dedup", "op9_decontaminate"):
        got, want = queries[name](spark, SF).toPandas(), db.execute(oracles[name]).fetchdf()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(str, d[columns].itertuples(index=False, name=None))) for d in (got, want)]
        assert rows[0] == rows[1], name
