"""Periodic runs of words, by maximal pairs over the LCP-interval tree.

A run of period q that starts at word i and has length L is exactly a maximal
pair of places (i, i + q): the words before the two differ (or one has none),
the words from there on agree for l = L - q places and no further.  So all
pairs (i, j) of a document are enumerated whose distance q = j - i satisfies the
length constraint q + l >= max(24, 3 q), and no pair needs extension:

1. suffixes are ranked by prefix doubling, which gives the suffix array, and
   the ranks of all doublings give the longest common prefixes of neighbours;
2. the LCP-interval tree is walked bottom-up; every node keeps the places of
   its suffixes in order, in all and by class of the word to their left;
3. when children meet in a node of depth l, each place of the smaller lists
   looks for places of the other lists within the distance l / 2 that have another
   left word: through the classes, or through the near places if these are fewer.

A run with period q is also met at 2 q, 3 q, ...; of the pairs with the same
start and end the one of least distance is the run, as runs have three periods.

Two exact filters keep this from touching most words.  The constraint
needs l >= 16, so that only intervals of that depth take part.  And such a pair
has, for the 2^k with 2^k <= l < 2^(k + 1), the same 2^k words again less than 2^k
words on: documents without any such repeat, which hashes of whole batches find,
have no run.

A document is one row and its work is n log n in its words; no rows are moved.

Defined cases: a null or empty text has no words and no run; repeated rows are judged
each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import add_columns, original_columns

LEAST = 24  # words of a run
PERIODS = 3  # of a run
SHORTEST = -(-LEAST * (PERIODS - 1) // PERIODS)  # words that a pair of such a run agrees on
FEWEST = 1 << SHORTEST.bit_length() - 1  # the greatest power of two up to it
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplication by it loses nothing


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    h = (a * BASE) ^ (b + (b >> np.uint64(29)))
    return h ^ (h >> np.uint64(32))


def _shift(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    out[:max(0, len(h) - by)] = h[by:]
    return out


def suspects(docs: list[np.ndarray]) -> list[int]:
    """The documents of a batch in which 2^k words, 2^k >= ``FEWEST``, occur again less than 2^k words on: no other holds a run.

    Windows of 2^k words are compared by hash over all documents at once, so that
    a few more may be named.
    """
    found: set[int] = set()
    live = [k for k, d in enumerate(docs) if len(d) >= LEAST]
    size, hashed = 1, {k: docs[k].astype(np.uint64) + np.uint64(1) for k in live}
    while live:
        if size >= FEWEST:
            counts = [len(docs[k]) - size + 1 for k in live]
            number = np.repeat(np.arange(len(live), dtype=np.uint64), counts)
            key = _mix(np.concatenate([hashed[k][:c] for k, c in zip(live, counts)]), number)
            order = np.argsort(key, kind="stable")
            again = np.flatnonzero(np.diff(key[order]) == 0)
            near = again[np.diff(order)[again] < size]
            found.update(live[i] for i in np.unique(number[order[near]]).tolist())
            live = [live[i] for i in np.unique(number[order[again]]).tolist() if live[i] not in found]
        live = [k for k in live if len(docs[k]) >= 2 * size]
        hashed = {k: _mix(hashed[k], _shift(hashed[k], size)) for k in live}
        size *= 2
    return sorted(found)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    _, out = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
    return out


class Suffixes:
    """Suffixes of one document that share at least ``SHORTEST`` words with another: places in suffix order, and neighbours' LCPs."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        rank = np.unique(ids, return_inverse=True)[1] + 1  # 0: past the end
        self.ranks, size = [rank], 1
        while True:
            shifted = np.zeros(n, np.int64)
            shifted[:n - size] = rank[size:]
            rank = _ranks(rank, shifted) + 1
            if size * 2 >= n or rank.max() == n:
                break
            self.ranks.append(rank)
            size *= 2
        self.n = n
        order = np.argsort(rank, kind="stable")
        lcp = self._lcp(order[:-1], order[1:]) if n > 1 else np.zeros(0, np.int64)
        shared = np.zeros(n, bool)
        shared[1:] |= lcp >= SHORTEST
        shared[:-1] |= lcp >= SHORTEST
        self.places = order[shared]
        # between two kept places that are not neighbours lies a smaller LCP, which ends all intervals in question
        self.lcp = np.where(np.append(lcp, 0)[shared] >= SHORTEST, np.append(lcp, 0)[shared], 0)[:-1]

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = (a < self.n) & (b < self.n)
            rank = self.ranks[k]
            same = inside & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
            # equal ranks of windows that reach past the end are windows of equal length, of which only one can end there
            same &= (a + (1 << k) <= self.n) & (b + (1 << k) <= self.n)
            a, b, length = a + (same << k), b + (same << k), length + (same << k)
        return length


class Node:
    """Places below a node of the tree, in all and by left word."""

    __slots__ = ("all", "classes")

    def __init__(self, place: int, left: int):
        self.all, self.classes = [place], {left: [place]}

    def pairs(self, other: Node, left: list[int], reach: int) -> list[tuple[int, int]]:
        """(i, j), i < j, one place of each node, at most ``reach`` apart, with different left words; ``other`` is the smaller."""
        out = []
        for left_word, places in other.classes.items():
            for x in places:
                lo, hi = bisect_left(self.all, x - reach), bisect_right(self.all, x + reach)
                if lo == hi:
                    continue
                if hi - lo <= len(self.classes):
                    near = [y for y in self.all[lo:hi] if left[y] != left_word]
                else:
                    near = [y for c, ys in self.classes.items() if c != left_word for y in ys[bisect_left(ys, x - reach):bisect_right(ys, x + reach)]]
                out += [(y, x) if y < x else (x, y) for y in near]
        return out

    def absorb(self, other: Node) -> None:
        _merge(self.all, other.all)
        for c, places in other.classes.items():
            mine = self.classes.get(c)
            if mine is None:
                self.classes[c] = places
            elif len(mine) < len(places):
                _merge(places, mine)
                self.classes[c] = places
            else:
                _merge(mine, places)


def _merge(many: list[int], few: list[int]) -> None:
    if len(few) * 16 < len(many):
        for x in few:
            insort(many, x)
    else:
        many += few
        many.sort()  # two sorted stretches: linear


def maximal_pairs(suffixes: Suffixes, ids: np.ndarray):
    """(i, j, l) of every maximal pair with j - i <= l / (PERIODS - 1) and j - i + l >= LEAST."""
    left = [-1, *ids[:-1].tolist()]  # no word before the first: a class of its own
    places, lcps = suffixes.places.tolist(), [*suffixes.lcp.tolist(), 0]
    stack: list[tuple[int, Node]] = []  # open intervals: depth, what is below

    def meet(a: Node, b: Node, depth: int, out: list) -> Node:
        if len(a.all) < len(b.all):
            a, b = b, a
        out += [(i, j, depth) for i, j in a.pairs(b, left, depth // (PERIODS - 1)) if j - i + depth >= LEAST]
        a.absorb(b)
        return a

    for place, after in zip(places, lcps):
        node, out = Node(place, left[place]), []
        # intervals deeper than the LCP to the next suffix end here: they are met from the deepest on
        while stack and stack[-1][0] > after:
            depth, below = stack.pop()
            node = meet(below, node, depth, out)
        if after >= SHORTEST:
            if stack and stack[-1][0] == after:
                depth, below = stack.pop()
                node = meet(below, node, depth, out)
            stack.append((after, node))
        yield from out


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's word ids, by start, then period."""
    if len(ids) < LEAST:
        return []
    suffixes = Suffixes(ids)
    least: dict[tuple[int, int], int] = {}
    for i, j, depth in maximal_pairs(suffixes, ids):
        ends = (i, j - i + depth)
        least[ends] = min(j - i, least.get(ends, j - i))
    return sorted((start, length, period) for (start, length), period in least.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run, and the first period of runs where no other run drops them."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(edges).tolist()) if not over]


def batch_runs(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every document of a batch."""
    known: dict[bytes, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in words]
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for k in suspects(docs):
        out[k] = find_runs(docs[k])
    return out


def split_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8."""
    return text.encode().split()


def with_repeats(words: list[bytes], h: int) -> list[bytes]:
    """The words that the registered query judges: where the id's CRC-32 ``h`` ends in 0, a stretch of them repeats to the end."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def document_runs(docs: DataFrame, collapsed: bool = False) -> DataFrame:
    """``docs``' columns as ``_k0``, ... with ``runs`` of every text and, if ``collapsed``, ``collapsed_text``: its kept words joined by a space."""

    def make() -> Callable[[list], list]:
        def scan(texts: list[str]) -> list:
            words = [split_words(t) for t in texts]
            runs = batch_runs(words)
            out = [[[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]]
            if collapsed:
                out.append([b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs)])
            return out
        return scan

    return add_columns(docs, "text", make, f"runs {RUN}" + (", collapsed_text string" if collapsed else ""))


def runs_of(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period."""
    found = document_runs(docs.select("doc_id", "text")).select(F.col("_k0").alias("doc_id"), F.explode("runs").alias("_run"))
    return found.select("doc_id", "_run.*")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that hold runs replaced by their collapsed words; all columns, and other texts, as they were."""
    found = document_runs(docs, collapsed=True)
    cols = original_columns(docs.columns)
    at = docs.columns.index("text")
    cols[at] = F.when(F.size("runs") > 0, F.col("collapsed_text")).otherwise(F.col(f"_k{at}")).alias("text")
    return found.select(*cols)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods (ties: smallest start, then period)."""
    best = None
    for r in runs:  # in order of start and period: only a greater exponent replaces
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: n_runs, the run of most periods, and digests of all runs and of the collapsed words."""
    def make() -> Callable[[list], list]:
        def scan(pairs: list[str]) -> list:
            words = []
            for pair in pairs:
                h, _, text = pair.partition("\n")
                words.append(with_repeats(split_words(text), int(h)))
            rows = []
            for w, runs in zip(words, batch_runs(words)):
                start, length, period = _best(runs) or (None, None, None)
                rows.append((len(runs), start, length, period, None if start is None else 1000 * length // period,
                             hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                             hashlib.sha256(b" ".join(collapse(w, runs))).hexdigest()))
            return [list(c) for c in zip(*rows)]
        return scan

    named = docs.select("doc_id", F.concat(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)).cast("string"), F.lit("\n"),
                                             F.coalesce("text", F.lit(""))).alias("_pair"))  # a null id repeats nothing
    return add_columns(named, "_pair", make, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
                       keep=["doc_id"]).withColumnRenamed("_k0", "doc_id")
