"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a vector of transformed, length-smoothed statistics.
Each class has a mean and a covariance shrunk towards the pooled one; the
score is the sigmoid of the difference of the Gaussian log-densities, whose
Mahalanobis terms use Cholesky factors computed once.

The fit uses every labelled row outside the held-out fold: sums and cross
products per class, added up by Spark.  No label, language, source or id is an
input of a score.

Defined cases: null and empty texts have the statistics of no words and are
scored like any other; a document labelled twice counts once with its larger
label; without labelled rows of both classes the score is the smoothed share
of good labels; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, held_out, in_arrow, materialise, original_columns

THRESHOLD = 0.3
SHRINKAGE = 0.05
FLOOR = 5e-4  # added to every variance
SMOOTH = 20.0  # words (or five times as many bytes) of average text mixed into every ratio

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"#$%&*+<=>@[\\]^_`{|}~/", "shout": b"!?",
            "stop": b".,;:'\"()-", "space": b" \t\n\x0b\x0c\r"}
_CLASS = np.full(256, len(_CLASSES))
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
# ratio by which smoothing pulls a short text: fixed values of ordinary prose
_PRIOR = {"upper": 0.02, "digit": 0.003, "mark": 0.0, "shout": 0.0, "stop": 0.02, "space": 0.15}
FEATURES = [*_CLASSES, "repeat", "distinct", "word_length", "words", "line_repeat"]


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of ``FEATURES``."""
    raw = text.encode()
    ws = raw.lower().split()
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES) + 1)
    size, n = len(raw) + 5 * SMOOTH, len(ws) + SMOOTH
    out = [math.sqrt((counts[i] + 5 * SMOOTH * _PRIOR[c]) / size) for i, c in enumerate(_CLASSES)]
    out.append(math.sqrt(sum(map(eq, ws, ws[1:])) / n))
    out.append(math.log((len(set(ws)) + SMOOTH) / n) / math.log(n))
    out.append(math.log((sum(map(len, ws)) + 5 * SMOOTH) / n))
    out.append(math.log(n) / 4)
    lines = raw.split(b"\n")
    out.append(math.sqrt(1 - (len(set(lines)) + 5) / (len(lines) + 5)))
    return out


@dataclass
class Model:
    """Per class: log prior plus log determinant term, mean, and Cholesky factor (None: constant score)."""
    share: float
    parts: list[tuple[float, np.ndarray, np.ndarray]] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        bad, good = (c - 0.5 * (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0) for c, mean, low in self.parts)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model:
    """The model of per-class (rows, sum, sum of outer products)."""
    total = sum(m[0] for m in moments.values())
    share = (moments[1][0] + 1 if 1 in moments else 1) / (total + 2)
    if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
        return Model(share, None)
    means = {k: moments[k][1] / moments[k][0] for k in (0, 1)}
    scatter = {k: moments[k][2] - moments[k][0] * np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / total
    parts = []
    for k in (0, 1):
        cov = (1 - shrinkage) * scatter[k] / moments[k][0] + shrinkage * pooled + FLOOR * np.eye(len(pooled))
        low = np.linalg.cholesky(cov)
        parts.append((math.log((moments[k][0] + 1) / (total + 2)) - np.log(np.diag(low)).sum(), means[k], low))
    return Model(share, parts)


def _document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, _x) of every row, written once."""
    x = add_columns(docs, "text", lambda: lambda texts: [[statistics(t) for t in texts]], "_x array<double>", keep=["doc_id"])
    return materialise(x.select(F.col("_k0").alias("doc_id"), "_x"), "statistics")


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on every labelled row that is not held out."""
    y = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
         .agg(F.max(label).cast("int").alias("_y")).filter(~held_out(F.col("doc_id"))))
    rows = features.join(y, "doc_id")
    d = len(FEATURES)
    xs = [F.col("_x")[i] for i in range(d)]
    cross = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("_y").agg(F.count(F.lit(1)).cast("double"), *[F.sum(x) for x in xs], *[F.sum(xs[i] * xs[j]) for i, j in cross])
    moments = {}
    for y_, n, *v in sums.collect():  # one row per class
        second = np.zeros((d, d))
        for (i, j), s in zip(cross, v[d:]):
            second[i, j] = second[j, i] = s
        moments[1 if y_ else 0] = (n, np.array(v[:d]), second)
    return fit_moments(moments)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    x = _document_statistics(docs)
    model = fit(x, labels)
    schema = "doc_id " + x.schema["doc_id"].dataType.simpleString() + ", score double"

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(m))], names=["doc_id", "score"])

    s = in_arrow(x.select("doc_id", "_x"), run, schema)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were; nothing is shuffled but statistics."""
    model = fit(_document_statistics(docs), labels)
    scored = add_columns(docs, "text", lambda: lambda texts: [model.score(np.array([statistics(t) for t in texts])).tolist()], "_score double")
    return scored.filter(F.col("_score") >= threshold).select(*original_columns(docs.columns))
