"""Benchmark decontamination with suffix arrays of the training documents.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is
one window).  Every Arrow stretch of documents is a shard: its words become
numbers, words that the benchmark does not hold become zeros, which match nothing, and
all suffixes that begin with a benchmark word are sorted into a suffix array by prefix
doubling.  Every suffix of every benchmark item is binary-searched in every
shard, word by word: its interval of the array holds the places that agree so
far, and a place that drops out agrees for exactly the words so far.  So each
place gets the length of its longest match with each test suffix; those of at
least a window that cannot be extended to the left either are the longest
verbatim matches.  Documents that hold one are reported, or removed.

The documents are read once per block of the benchmark and never shuffled;
the benchmark is read in blocks of bounded size.  The driver holds one block and
each worker its arrays (16 bytes a word) and the numbers of its distinct words.

Defined cases: null and empty texts have no words and no hits; items without
words have no windows; repeated documents are each reported; items with equal
texts all count; of equally long matches the first place, then the smallest item
is told, whatever the blocks; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import in_arrow, original_columns, words

WINDOW = 10
BLOCK_BYTES = 16 * 1024 * 1024  # benchmark text per block
SHARD_WORDS = 1 << 18
FIELDS = ("_n_words long, _ranges array<struct<start:long,stop:long>>, _items array<string>, "
          "_longest long, _longest_at long, _longest_item string")
FIELD_NAMES = ["_n_words", "_ranges", "_items", "_longest", "_longest_at", "_longest_item"]


class TestSuffixes:
    """All suffixes of the items of one benchmark block, as places in one array of word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        sizes = np.array([len(ws) for _, ws in items], np.int64)
        self.ids = np.zeros(sizes.sum() + len(items) + 1, np.uint32)  # a zero before and after each item
        begin = 1
        for (_, ws), n in zip(items, sizes.tolist()):
            self.ids[begin:begin + n] = [self.number.setdefault(w, len(self.number) + 1) for w in ws]
            begin += n + 1
        self.at = np.flatnonzero(self.ids)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        self.need = np.minimum(window, sizes).astype(np.int32)  # words of an item's windows


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of the numbers above zero, sorted by what follows up to the next zero; ``ids`` ends with a zero."""
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    rank = np.zeros(len(ids), np.int64)
    head = np.flatnonzero(np.diff(ids[order], prepend=0))  # where equal suffixes begin in the order
    rank[order] = np.repeat(head + 1, np.diff(head, append=len(order)))
    zeros = np.flatnonzero(ids == 0)
    longest = np.diff(zeros, prepend=-1).max(initial=1)
    size = 1
    while size < longest:
        first = rank[order]
        same = first[1:] == first[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(tied):
            break
        places, first = order[tied], first[tied]
        second = rank[np.minimum(places + size, len(ids) - 1)]
        by = np.lexsort((second, first))  # within the ranks, by the rank of what follows
        places, second = places[by], second[by]
        order[tied] = places
        group = np.diff(first, prepend=0) != 0
        begin = np.flatnonzero(group | (np.diff(second, prepend=-1) != 0))
        of_group = np.maximum.accumulate(np.where(group, np.arange(len(tied)), 0))
        of_pair = np.repeat(begin, np.diff(begin, append=len(tied)))
        rank[places] = first + of_pair - of_group
        size *= 2
    return order


def _bisect(ids: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
    """The first place in each stretch [low, high) of the suffix array whose word at ``depth`` is at least ``want``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        word = ids[np.minimum(array[np.minimum(middle, len(array) - 1)] + depth, len(ids) - 1)]  # of a closed stretch: any
        below = open_ & (word < want)
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


def _search(ids: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, item) of every longest match of at least a window in a shard, sorted by place; ``ids`` ends with a zero."""
    found = [(np.zeros(0, np.int64),) * 3]
    array = suffix_array(ids)
    test, depth = np.arange(len(tests.at)), 0
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(array))

    def ended(begin: np.ndarray, end: np.ndarray, test: np.ndarray) -> None:
        """Places that agree with their test suffix for ``depth`` words and no further."""
        size = np.where(depth >= tests.need[tests.item[test]], end - begin, 0)
        if not size.any():
            return
        which = np.repeat(test, size)
        place = array[np.arange(len(which)) + np.repeat(begin - np.cumsum(size) + size, size)]
        before = tests.ids[tests.at[which] - 1]
        whole = (before == 0) | (place == 0) | (ids[place - 1] != before)  # else a longer one begins a word earlier
        found.append((place[whole], np.full(whole.sum(), depth), tests.item[which[whole]]))

    while len(test):
        want = tests.ids[tests.at[test] + depth]
        first = _bisect(ids, array, low, high, depth, want)
        after = _bisect(ids, array, first, high, depth, want + 1)
        over = want == 0  # the item ends: no place goes on
        first, after = np.where(over, high, first), np.where(over, high, after)
        if depth:
            ended(low, first, test)
            ended(after, high, test)
        depth += 1
        on = first < after
        test, low, high = test[on], first[on], after[on]
    place, length, item = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(place, kind="stable")
    return place[order], length[order], item[order]


def _describe(hits: list[tuple[int, int, int]], names: list[str]) -> tuple:
    """Merged word ranges, items and the longest match of one document's (place, length, item) matches."""
    ranges: list[list[int]] = []
    for p, n, _ in hits:
        if ranges and p <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], p + n)
        else:
            ranges.append([p, p + n])
    size, at, item = min((-n, p, names[i]) for p, n, i in hits)
    return [{"start": a, "stop": b} for a, b in ranges], sorted({names[i] for _, _, i in hits}), -size, at, item


def _scan(shard: list[list[bytes]], tests: TestSuffixes) -> list[list]:
    """The fields of ``FIELDS`` for the word numbers of a shard's documents."""
    n_words = np.array([len(x) for x in shard], np.int64)
    starts = np.concatenate(([0], np.cumsum(n_words + 1)))  # a zero after each document parts them
    ids = np.zeros(starts[-1] + 1, np.uint32)
    for s, x in zip(starts, shard):
        ids[s:s + len(x)] = x
    place, length, item = _search(ids, tests)
    doc = np.searchsorted(starts, place, "right") - 1
    out: list[list] = [n_words.tolist(), *([v] * len(shard) for v in ([], [], 0, None, None))]
    out = [list(c) for c in out]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for part in np.split(np.arange(len(doc)), cuts):
        if len(part):
            d = doc[part[0]]
            got = _describe(list(zip((place[part] - starts[d]).tolist(), length[part].tolist(), item[part].tolist())), tests.names)
            for c, v in zip(out[1:], got):
                c[d] = v
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded text; the driver holds one block and one partition's rows."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        if block and size + len(r.text or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i or "", words(r.text)))
        size += len(r.text or "")
    yield block


def _matches(docs: DataFrame, keep: list[Column], tests: TestSuffixes) -> DataFrame:
    """The ``keep`` columns of ``docs`` as ``_k0``... with the fields of ``FIELDS``."""
    inner = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *T.StructType.fromDDL(FIELDS).fields])
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()),
             pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        held = shared.value
        number = held.number
        for batch in batches:
            shard, size, begin, texts = [], 0, 0, batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                ws = words(texts[i].as_py())
                shard.append(np.fromiter((number.get(w, 0) for w in ws), np.uint32, len(ws)))
                size += len(ws)
                if size >= SHARD_WORDS or i == batch.num_rows - 1:
                    new = [pa.array(v, type=t) for v, t in zip(_scan(shard, held), types)]
                    old = [c.slice(begin, len(shard)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays(old + new, names=schema.names)
                    shard, size, begin = [], 0, i + 1
        pa.default_memory_pool().release_unused()

    return in_arrow(inner, run, schema)


def _merged(docs: DataFrame, benchmark: DataFrame, names: list[str], window: int, block_bytes: int) -> DataFrame:
    """The matches of all blocks.  A benchmark beyond one block adds a narrow row per document and block that is hit."""
    blocks = _blocks(benchmark, block_bytes)
    keep, row = [F.col(f"`{c}`") for c in names], [F.col("doc_id"), F.xxhash64("text")]
    first = _matches(docs, keep, TestSuffixes(next(blocks), window))
    more = None
    for block in blocks:
        got = (_matches(docs, row, TestSuffixes(block, window)).filter(F.size("_ranges") > 0)
               .dropDuplicates(["_k0", "_k1"]).select(F.col("_k0").alias("_mid"), F.col("_k1").alias("_mrow"), *FIELD_NAMES[1:]))
        more = got if more is None else more.unionAll(got)
    if more is None:
        return first
    best = F.min(F.struct((-F.col("_longest")).alias("_longest"), "_longest_at", "_longest_item"))
    more = more.groupBy("_mid", "_mrow").agg(F.flatten(F.collect_list("_ranges")).alias("_r2"),
                                             F.flatten(F.collect_list("_items")).alias("_i2"), best.alias("_b2"))
    first = _matches(docs, [*keep, *row], TestSuffixes(next(_blocks(benchmark, block_bytes)), window))
    k = len(keep)
    j = first.join(more, F.col(f"_k{k}").eqNullSafe(F.col("_mid")) & (F.col(f"_k{k + 1}") == F.col("_mrow")), "left")
    union = F.sort_array(F.concat("_ranges", F.coalesce("_r2", F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>"))))
    zero = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")

    def step(acc, r):
        top = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["stop"], r["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= r["start"]), grown).otherwise(F.concat(acc, F.array(r)))

    top = F.least(F.struct((-F.col("_longest")).alias("_longest"), "_longest_at", "_longest_item"), F.col("_b2"))
    return j.select(*[f"_k{i}" for i in range(k)], "_n_words", F.aggregate(union, zero, step).alias("_ranges"),
                    F.sort_array(F.array_distinct(F.concat("_items", F.coalesce("_i2", F.expr("cast(array() as array<string>)"))))).alias("_items"),
                    (-top["_longest"]).alias("_longest"), top["_longest_at"].alias("_longest_at"), top["_longest_item"].alias("_longest_item"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit ranges, items, and the longest verbatim match with its place and item."""
    m = _merged(docs, benchmark, ["doc_id"], window, block_bytes)
    return m.select(F.col("_k0").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_ranges").alias("ranges"), F.col("_items").alias("items"),
                    F.col("_longest").alias("longest"), F.col("_longest_at").alias("longest_at"), F.col("_longest_item").alias("longest_item"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``: counts and a hash of the items."""
    c = contamination(docs, benchmark)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return c.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns as they were."""
    m = _merged(docs, benchmark, docs.columns, window, block_bytes)
    return m.filter(F.size("_ranges") == 0).select(*original_columns(docs.columns))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERY_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[p:p + least({WINDOW}, len(w)) - 1], ' ') AS k
  FROM b, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS t(p) WHERE len(w) > 0),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM windows) AS l, unnest(generate_series(1, len(w) - n + 1)) AS t(p)),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, k)),
hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
