"""Toxic spans and document scores from a linear-chain conditional random field.

Training takes a bounded sample of labelled documents outside the held-out
fold, split in two.  The first half gives the evidence of words and word
beginnings: smoothed log-odds of appearing in toxic against clean documents.
In the second half, tokens of toxic documents with strong evidence are
labelled toxic, and the field's emission and transition weights are fitted to
these labels by maximum likelihood.  Forward-backward marginals of every token
then give the document's features (largest, expected and relative number of
toxic tokens), which a logistic fit on the second half turns into a score.

A chain is a whole text.  It is worked on in blocks of ``CHAIN`` words, all blocks of many texts
at a time: each block's transfer matrix first, then the messages that pass
from block to block, forward and backward, then the words within each block.  The result is that of one
pass over the text.

Defined cases: null and empty texts have no tokens and get the score of zero
features; a document labelled twice counts once with its larger label; without
training rows of both classes the score is the smoothed share of toxic labels;
repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, held_out, words

SAMPLE_ROWS = 8000  # labelled documents learned from, those with the smallest hashes of their ids
SAMPLE_CHARS = 20_000  # longer documents are scored but not learned from
CHAIN = 64
BEGINNINGS = (4, 5, 6)  # bytes of a word's beginning that are features
SURE = 16.0  # log-likelihood ratio that a feature's evidence must reach
STRONG = 2.0  # log-odds from which a token of a toxic document is labelled toxic
CACHE = 400_000  # words whose emission a task remembers
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _features(w: bytes) -> list[bytes]:
    return [b"=" + w, *(w[:n] for n in BEGINNINGS if len(w) >= n)]


def evidence_of(docs: list[tuple[list[bytes], int]]) -> dict[bytes, tuple[float, float]]:
    """Feature -> (log-odds, log of supporting toxic documents), for features that surely speak for toxicity."""
    seen = {0: Counter(), 1: Counter()}
    size = Counter(y for _, y in docs)
    for ws, y in docs:
        seen[y].update({f for w in set(ws) for f in _features(w)})
    out = {}
    rate = size[1] / (size[0] + size[1])
    for f, a in seen[1].items():
        b = seen[0][f]
        odds = math.log((a + 0.5) / (size[1] + 1)) - math.log((b + 0.5) / (size[0] + 1))
        ratio = 2 * (a * math.log(a / ((a + b) * rate)) + (b * math.log(b / ((a + b) * (1 - rate))) if b else 0))
        if odds > 1 and ratio >= SURE:
            out[f] = (odds, math.log(a))
    return out


def without_copies(sample: list[tuple[list[bytes], int]], shingle: int = 3, signs: int = 4) -> list[tuple[list[bytes], int]]:
    """The sample without near copies, which would pass for evidence: texts that share all but one of
    their ``signs`` min-hashes of shingles with an earlier text of the same label.

    A sign falls into a passage that many texts share as often as the passage's share of the
    text: where it is 0.3, 8 % of the texts go, and where it is 0.9, 95 % do.
    """
    seen: set[tuple] = set()
    out = []
    for ws, y in sample:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(ws[i:i + shingle])) for i in range(max(1, len(ws) - shingle + 1))], np.uint64)
        mine = [int((hashes * np.uint64(2 * k + 1) ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))).min()) for k in range(signs)]
        keys = {(y, left_out, *mine[:left_out], *mine[left_out + 1:]) for left_out in range(signs)}
        if seen.isdisjoint(keys):
            out.append((ws, y))
        seen |= keys
    return out


def _inputs(evidence: dict, w: bytes) -> tuple[float, float]:
    return max((evidence[f] for f in _features(w) if f in evidence), default=(0.0, 0.0))


def _logsumexp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state (chains x steps), expected transitions (2 x 2) and log-partitions.

    ``emission`` is the toxic state's score, the clean state scores zero.
    """
    n, steps = emission.shape
    fwd = np.zeros((steps, 2, n))
    fwd[0, 1] = emission[:, 0]
    for t in range(1, steps):
        for s in (0, 1):
            fwd[t, s] = _logsumexp(fwd[t - 1, 0] + trans[0, s], fwd[t - 1, 1] + trans[1, s])
        fwd[t, 1] += emission[:, t]
    z = _logsumexp(fwd[-1, 0], fwd[-1, 1])
    back = np.zeros((2, n))
    marginal, pairs = np.empty((n, steps)), np.zeros((2, 2))
    marginal[:, -1] = np.exp(fwd[-1, 1] - z)
    for t in range(steps - 2, -1, -1):
        ahead = np.stack([back[0], back[1] + emission[:, t + 1]])
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += np.exp(fwd[t, a] + trans[a, b] + ahead[b] - z).sum()
        back = np.stack([_logsumexp(trans[a, 0] + ahead[0], trans[a, 1] + ahead[1]) for a in (0, 1)])
        marginal[:, t] = np.exp(fwd[t, 1] + back[1] - z)
    return marginal, pairs, z


def _descend(value_and_gradient, x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """BFGS with backtracking on a smooth convex function of few variables."""
    value, grad = value_and_gradient(x)
    inverse = np.eye(len(x))
    for _ in range(rounds):
        step = -inverse @ grad
        rate = 1.0
        while rate > 1e-6:
            new_value, new_grad = value_and_gradient(x + rate * step)
            if new_value <= value + 1e-4 * rate * grad @ step:
                break
            rate /= 2
        else:
            return x
        s, y = rate * step, new_grad - grad
        x, done = x + s, value - new_value < 1e-7 * (1 + abs(value))
        value, grad = new_value, new_grad
        if done:
            return x
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
    return x


class Blocks:
    """Texts of the given lengths in rows of ``CHAIN`` words, each text beginning a row."""

    def __init__(self, lengths: list[int]):
        self.lengths = np.array(lengths, np.int64)
        self.per = -(-self.lengths // CHAIN)
        self.first = np.cumsum(self.per) - self.per
        total = int(self.per.sum())
        self.at = np.arange(self.lengths.sum()) + np.repeat(self.first * CHAIN - np.cumsum(self.lengths) + self.lengths, self.lengths)
        self.real = np.zeros(total * CHAIN, bool)
        self.real[self.at] = True
        self.real = self.real.reshape(total, CHAIN)
        self.begins = np.zeros(total, bool)
        self.begins[self.first[self.per > 0]] = True

    def lay(self, values: np.ndarray) -> np.ndarray:
        """Values of all words, one text after another, in rows."""
        out = np.zeros(self.real.size)
        out[self.at] = values
        return out.reshape(self.real.shape)

    def take(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows.reshape(-1)[self.at], np.cumsum(self.lengths)[:-1])

    def following(self, rank: int) -> np.ndarray:
        """The rows that are their text's number ``rank``, from 0."""
        return self.first[self.per > rank] + rank


def messages(emission: np.ndarray, blocks: Blocks, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word the log-odds of the toxic state by what is before it (itself included), the same
    of the word before it, and by what follows; forward-backward over whole texts."""
    (t00, t01), (t10, t11) = trans
    add, real = np.logaddexp, blocks.real
    n = len(real)
    to = np.full((2, 2, n), -np.inf)  # transfer of a row: from the state before it to the state of its last word
    to[0, 0] = to[1, 1] = 0
    for k in range(CHAIN):
        e = emission[:, k]
        clean, toxic = add(to[:, 0] + t00, to[:, 1] + t10), add(to[:, 0] + t01, to[:, 1] + t11) + e
        if k == 0:
            clean, toxic = np.where(blocks.begins, 0, clean), np.where(blocks.begins, e, toxic)
        to = np.where(real[:, k], np.stack([clean, toxic], axis=1), to)
    into, out_of = np.zeros(n), np.zeros(n)
    longest = int(blocks.per.max(initial=0))
    for r in range(1, longest):
        rows = blocks.following(r)
        m, x = to[:, :, rows - 1], into[rows - 1]
        into[rows] = add(m[0, 1], m[1, 1] + x) - add(m[0, 0], m[1, 0] + x)
    for r in range(longest - 1, 0, -1):
        rows = blocks.following(r)
        m, x = to[:, :, rows], out_of[rows]
        out_of[rows - 1] = add(m[1, 0], m[1, 1] + x) - add(m[0, 0], m[0, 1] + x)
    before, ahead, previous = np.empty((n, CHAIN)), np.empty((n, CHAIN)), np.empty((n, CHAIN))
    now = into
    for k in range(CHAIN):
        previous[:, k] = now
        new = emission[:, k] + add(t01, t11 + now) - add(t00, t10 + now)
        if k == 0:
            new = np.where(blocks.begins, emission[:, 0], new)
        now = np.where(real[:, k], new, now)
        before[:, k] = now
    now = ahead[:, -1] = out_of
    for k in range(CHAIN - 2, -1, -1):
        x = emission[:, k + 1] + now
        now = np.where(real[:, k + 1], add(t10, t11 + x) - add(t00, t01 + x), now)
        ahead[:, k] = now
    return before, previous, ahead


def _marginal(before: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(before + ahead, -500, 500)))


def fit_field(texts: list[tuple[np.ndarray, np.ndarray]], ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (bias, odds, support) and transitions of maximum likelihood.  texts: (inputs, token labels)."""
    blocks = Blocks([len(t) for _, t in texts])
    x, y = np.concatenate([v for v, _ in texts]), np.concatenate([t for _, t in texts])
    count = np.zeros((2, 2))
    for _, t in texts:
        np.add.at(count, (t[:-1].astype(int), t[1:].astype(int)), 1)
    flat = np.concatenate([[y.sum()], y @ x, [count[0, 1], count[1, 0], count[1, 1]]])
    size = max(1, len(y) / CHAIN)
    step = blocks.real.copy()  # words with one before them in their text
    step[blocks.begins, 0] = False
    last = blocks.at[np.cumsum(blocks.lengths)[blocks.lengths > 0] - 1]

    def loss(theta):
        trans = np.array([[0.0, theta[3]], [theta[4], theta[5]]])
        emission = blocks.lay(theta[0] + x @ theta[1:3])
        before, previous, ahead = messages(emission, blocks, trans)
        marginal = _marginal(before, ahead).reshape(-1)[blocks.at]
        u, e = previous[step], (emission + ahead)[step]
        joint = np.stack([np.zeros_like(u), trans[0, 1] + e, u + trans[1, 0], u + trans[1, 1] + e])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0)).sum(axis=1)
        z = np.logaddexp(0, trans[1, 0] + u).sum() + np.logaddexp(0, before.reshape(-1)[last]).sum()
        expected = np.concatenate([[marginal.sum()], marginal @ x, joint[1:]])
        return (z - flat @ theta) / size + ridge * theta @ theta, (expected - flat) / size + 2 * ridge * theta

    theta = _descend(loss, np.zeros(6))
    return theta[:3], np.array([[0.0, theta[3]], [theta[4], theta[5]]])


@dataclass
class Model:
    share: float
    evidence: dict = field(default_factory=dict)
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    logistic: np.ndarray | None = None

    def emission(self, w: bytes) -> float:
        odds, support = _inputs(self.evidence, w)
        return float(self.weights[0] + self.weights[1] * odds + self.weights[2] * support)


class Tagger:
    """Marginals and scores under a model; remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        if model.weights is not None:  # the marginal of a word far from any evidence
            far = Blocks([8 * CHAIN + 1])
            before, _, ahead = messages(far.lay(np.full(8 * CHAIN + 1, float(model.weights[0]))), far, model.trans)
            self.rest = float(_marginal(before, ahead)[4, 0])

    def emissions(self, ws: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(ws).difference(known):
            known[w] = self.model.emission(w)
        return np.fromiter(map(known.__getitem__, ws), float, len(ws))

    def marginals(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The toxic marginal of every word, by forward-backward over each whole text."""
        blocks = Blocks([len(ws) for ws in texts])
        before, _, ahead = messages(blocks.lay(np.concatenate([self.emissions(ws) for ws in texts])), blocks, self.model.trans)
        return blocks.take(_marginal(before, ahead))

    def describe(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Per text: the largest marginal, and the expected number and share of toxic words beyond those of a text without evidence."""
        sums = [max(0.0, float(m.sum()) - self.rest * len(m)) for m in marginals]
        return np.array([[1.0, m.max(initial=0.0), math.log1p(s), math.log((s + 0.1) / (len(m) + 100))] for m, s in zip(marginals, sums)])

    def score(self, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        """Scores, and the offending spans as character offsets with their largest marginal."""
        if self.model.weights is None:
            return [self.model.share] * len(texts), [[]] * len(texts)
        marginals = self.marginals([words(t) for t in texts])
        x = self.describe(marginals) @ self.model.logistic
        return (1 / (1 + np.exp(-np.clip(x, -500, 500)))).tolist(), [_spans(t, m) for t, m in zip(texts, marginals)]


def _spans(text: str, marginal: np.ndarray) -> list[dict]:
    hot = np.flatnonzero(marginal >= 0.5)
    if not len(hot):
        return []
    at = [m.span() for m in WORD.finditer(text)]
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    return [{"start": at[r[0]][0], "stop": at[r[-1]][1], "marginal": float(marginal[r].max())} for r in runs]


def fit(sample: list[tuple[str, int]]) -> Model:
    """Train on (text, label) pairs."""
    docs = without_copies([(words(t), y) for t, y in sample])
    share = (sum(y for _, y in docs) + 1) / (len(docs) + 2)
    halves = [docs[0::2], docs[1::2]]
    if any(len({y for _, y in h}) < 2 for h in halves):
        return Model(share)
    evidence = evidence_of(halves[0])
    toxic = [d for d in halves[1] if d[1]]
    clean = [d for d in halves[1] if not d[1]]
    chains = []
    for ws, y in toxic + clean[:2 * len(toxic)]:
        v = np.array([_inputs(evidence, w) for w in ws]).reshape(-1, 2)
        chains.append((v, (v[:, 0] >= STRONG) * float(y)))
    weights, trans = fit_field(chains)
    model = Model(share, evidence, weights, trans)
    tagger = Tagger(model)
    x = tagger.describe(tagger.marginals([ws for ws, _ in halves[1]]))
    y = np.array([y for _, y in halves[1]], float)

    def loss(theta):
        s = x @ theta
        return (np.logaddexp(0, s) - y * s).mean() + 1e-3 * theta[1:] @ theta[1:], \
            x.T @ (1 / (1 + np.exp(-s)) - y) / len(y) + 2e-3 * np.concatenate(([0], theta[1:]))

    model.logistic = _descend(loss, np.zeros(x.shape[1]), 200)
    model.evidence = evidence_of(docs)  # weights are set on the unseen half; scoring may use both
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> list[tuple[str, int]]:
    """At most ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_CHARS`` characters, outside the held-out fold."""
    y = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
         .filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    t = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = t.join(F.broadcast(y), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_ROWS).toPandas()
    return [(t, int(y > 0)) for t, y in zip(rows["text"], rows["_y"])]


def toxic_spans(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score and the offending spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels)))

    def make():
        tagger = Tagger(shared.value)

        def run(texts):
            got = [tagger.score(texts[i:i + 128]) for i in range(0, len(texts), 128)]
            return [[s for a, _ in got for s in a], [s for _, b in got for s in b]]
        return run

    fields = "score double, spans array<struct<start:long,stop:long,marginal:double>>"
    return add_columns(docs, "text", make, fields, keep=["doc_id"]).withColumnRenamed("_k0", "doc_id")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the number of offending spans."""
    return toxic_spans(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                            (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
