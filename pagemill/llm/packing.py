"""Mixture-controlled packing of documents into token sequences.

Every source is a queue of documents, served by deficit round-robin: a round is
a sequence long, credits every queue its target share of the tokens, and the
queue gives whole documents as long as its credit pays for them; the rest of
the credit is saved.  A queue that has run dry leaves its share to the others, in
proportion to theirs.  Without ``shares`` the targets are the corpus's own
shares, so that all queues run dry together.

Credit depends on the queues' totals alone, so the round of a document follows
from where it ends in its queue, and no queue is walked in one task:

1. every task tokenises its documents once and writes the ids, with the
   tokens its chunk gave the same queue before each document;
2. the chunks' totals per queue are added up in chunk order, which places every
   document in its queue and gives its round;
3. the tokens of every (round, queue) are added up in order, by blocks of rounds,
   and met by the documents: the one shuffle of ids.

The rounds are laid one after another and cut every ``LENGTH`` tokens: documents
are cut at ends of sequences only, and only the last sequence can need padding.

Defined cases: a null text is empty and gives its end token alone; a null
source is a queue of its own; repeated rows are packed each; an empty table
gives no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import BROADCAST_BYTES, in_arrow, materialise

LENGTH = 4096
WINDOW = 1  # sequences of a round, in which every source is credited its share
BLOCK = 1024  # rounds whose places one task adds up
END = 2
QUEUES = 1 << 20  # sources are dealt to so many queues by hash, which bounds the totals sent to the driver
CACHE = 300_000  # pieces whose ids a worker remembers per generation
BASE_BYTES = 24  # of a chunk's total in memory


class Ids:
    """Ids of texts as little-endian 16- or 32-bit bytes.

    The tokenizer of word ends never joins characters across white space, nor
    letters with marks, so the ids of a text are those of its pieces, and the
    ids of frequent pieces are remembered.  Plain Latin text is cut by the
    tokenizer's own rule; any other stretch between spaces, and every text for
    another kind of tokenizer, is encoded as it stands.
    """

    LETTERS = "a-zß-öø-ÿ"  # composed letters, whose lower case is one letter
    PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
    SIMPLE = re.compile(f"[{LETTERS} \n.,]*")
    PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")  # fixed values: the tokenizer's rule
    SPACE = re.compile("[ \t\n\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.dtype("<u4") if self.tokenizer.get_vocab_size() > 1 << 16 else np.dtype("<u2")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 8 * self.wide.itemsize if suffix else 0, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.model = self.tokenizer.model
        # two generations: what is used again outlives the younger one's limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.wide).tobytes()

    def _is_plain(self, text: str) -> bool:
        return "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a plain text, and stretches of another as they stand."""
        if self._is_plain(text):
            low = text.lower()
            if self.SIMPLE.fullmatch(low) and not (".." in low or ".," in low or ",." in low or ",," in low):
                return low.replace(".", " . ").replace(",", " , ").split()
            return self.PIECES.findall(low)
        return [p for chunk in self.SPACE.split(text) if chunk
                for p in (self.PIECES.findall(chunk.lower()) if self._is_plain(chunk) else (chunk,))]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new, older = [], self.older
        for p in pieces.difference(self.known):
            ids = older.get(p)
            if ids is not None:
                self.known[p] = ids
            elif p.isascii() and p.isalnum():  # its own bytes are what the model merges
                self.known[p] = array(self.wide.char, [t.id for t in self.model.tokenize(p)]).tobytes()
            elif self._is_plain(p):
                new.append(p)
            else:
                self.known[p] = self._encode(p)
        for i in range(0, len(new), 2000):
            part = new[i:i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.wide)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.wide.itemsize
            if len(stops) == len(part):  # a word end per piece
                raw, begin = ids.tobytes(), 0
                for p, stop in zip(part, stops.tolist()):
                    self.known[p], begin = raw[begin:stop], stop
            else:
                self.known.update((p, self._encode(p)) for p in part)

    def of(self, texts: list[str], end: int = END) -> list[bytes]:
        """The ids of every text, then the end id."""
        tail = np.array([end], self.wide).tobytes()
        if not len(self.ends):
            return [self._encode(t) + tail for t in texts]
        split = [self._pieces(t) for t in texts]
        self._learn(set().union(*split))
        known = self.known
        return [b"".join(map(known.__getitem__, ps)) + tail for ps in split]


_READY: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    """The tokenizer of this worker process, with what it remembers from earlier tasks."""
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


def tokenise(docs: DataFrame, tokenizer: str, source: str = "source") -> DataFrame:
    """(_id, _queue, _n, _chunk, _before, _ids) per document, written once.

    ``_chunk`` numbers the writing task and ``_before`` counts the tokens of the
    same queue that the task wrote earlier, so both are fixed by the files.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), _queue(F.col(source)).alias("_queue"),
                       F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("_n", T.LongType()), T.StructField("_chunk", T.LongType()),
                           T.StructField("_before", T.LongType()), T.StructField("_ids", T.BinaryType())])

    def run(batches):
        ids, chunk, given = _ids(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                got = [x for k in range(0, part.num_rows, 64) for x in ids.of(part.column(2).slice(k, 64).to_pylist())]
                ns, before = [len(x) // ids.wide.itemsize for x in got], []
                for q, n in zip(part.column(1).to_pylist(), ns):
                    before.append(given[q])
                    given[q] += n
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(ns, pa.int64()), pa.array([chunk] * len(ns), pa.int64()),
                                                  pa.array(before, pa.int64()), pa.array(got, pa.binary())], names=schema.names)

    return materialise(in_arrow(rows, run, schema), "token-ids")


class Layout:
    """Rounds of ``window`` sequences, and the credit of every queue by then; ``weights`` are the queues' totals if not given."""

    def __init__(self, totals: dict[int, int], length: int = LENGTH, window: int = WINDOW, weights: dict[int, float] | None = None):
        self.totals = [totals[q] for q in sorted(totals)]
        self.tokens = sum(self.totals)
        self.windows = max(1, -(-self.tokens // (length * window)))
        # (time, tokens given by then, tokens per unit of time from then on): a queue of weight w is credited w per unit
        self.phases = [(0.0, 0.0, float(self.tokens))]
        if weights is not None:
            exact = {q: Fraction(weights[q]) for q in totals}
            self.phases, time, given, rate = [], Fraction(0), Fraction(0), sum(exact.values())
            for dry, q in sorted((totals[q] / w, q) for q, w in exact.items()):
                if dry > time:
                    self.phases.append((float(time), float(given), float(rate)))
                    time, given = dry, given + (dry - time) * rate
                rate -= exact[q]

    def given(self, total: int, w: int) -> int:
        """Credit before round ``w`` of a queue with ``total`` tokens, for the corpus's own shares."""
        return total * w // self.windows

    def round(self, docs: DataFrame, end: Column, weight: Column) -> DataFrame:
        """``docs`` with ``_round``: the round, from 1, whose credit pays for a document that ends at ``end`` of its queue.

        The phases, one more than there are queues at most, are one broadcast row; each document finds its own by binary search.
        """
        time = end.cast("double") / weight
        if len(self.phases) == 1:
            (at, by_then, rate), = self.phases
            given = F.lit(by_then) + (time - F.lit(at)) * F.lit(rate)
        else:
            columns = [list(c) for c in zip(*self.phases)]
            row = docs.sparkSession.createDataFrame([(0, *columns)], "_one int, _ats array<double>, _thens array<double>, _rates array<double>")
            docs = docs.withColumn("_one", F.lit(0)).join(F.broadcast(row), "_one")

            def halve(acc: Column, _: Column) -> Column:  # the last phase that began before the document's time
                middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
                later = F.get("_ats", middle) < time
                return F.struct(F.when(later, middle).otherwise(acc["lo"]).alias("lo"), F.when(later, acc["hi"]).otherwise(F.greatest(middle - 1, acc["lo"])).alias("hi"))

            span = F.struct(F.lit(0).alias("lo"), F.lit(len(self.phases) - 1).alias("hi"))
            docs = docs.withColumn("_phase", F.aggregate(F.sequence(F.lit(1), F.lit(len(self.phases).bit_length())), span, halve, lambda acc: acc["lo"]))
            given = F.get("_thens", "_phase") + (time - F.get("_ats", "_phase")) * F.get("_rates", "_phase")
        # a credit that pays exactly does pay
        return docs.withColumn("_round", F.ceil(given * F.lit(self.windows / max(1, self.tokens)) - F.lit(1e-9)))


def _queue(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(QUEUES))


def _weights(docs: DataFrame, source: str, shares: dict, totals: dict[int, int]) -> dict[int, float]:
    """Target shares by queue; every source of the table needs one above zero."""
    named = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in shares.items()], T.StructType(
        [T.StructField("source", docs.schema[source].dataType), T.StructField("weight", T.DoubleType())]))
    out: dict[int, float] = defaultdict(float)
    for r in named.select(_queue(F.col("source")).alias("q"), "weight").collect():
        if not 0 < r.weight < float("inf"):
            raise ValueError("target shares must be above zero")
        out[r.q] += r.weight
    if totals.keys() - out.keys():
        raise ValueError("every source needs a target share")
    return {q: out[q] for q in totals}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, window: int = WINDOW, source: str = "source",
         broadcast_bytes: int = BROADCAST_BYTES, shares: dict | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``shares`` maps sources to their target shares, in any unit (default: the corpus's own).
    """
    tokens = tokenise(docs, tokenizer, source)
    chunks = tokens.groupBy("_queue", "_chunk").agg(F.sum("_n").alias("_sum"))
    order = "partition by _queue order by _chunk rows between unbounded preceding and 1 preceding"
    base = materialise(chunks.select("_queue", "_chunk", "_sum", F.expr(f"coalesce(sum(_sum) over ({order}), 0)").alias("_base"),
                                     F.expr("cast(sum(_sum) over (partition by _queue) as double)").alias("_weight")), "queue-chunks")
    totals = {r._queue: r._t for r in base.groupBy("_queue").agg(F.sum("_sum").alias("_t")).collect()}  # a row per queue, QUEUES at most
    weights = None if shares is None or not totals else _weights(docs, source, shares, totals)
    plan = Layout(totals, length, window, weights)
    if weights is not None:
        by_queue = docs.sparkSession.createDataFrame(list(weights.items()), "_queue long, _weight double")
        base = base.drop("_weight").join(F.broadcast(by_queue), "_queue")
    base = base.select("_queue", "_chunk", "_base", "_weight")
    if base.count() * BASE_BYTES <= broadcast_bytes:
        base = F.broadcast(base)
    begin = F.col("_base") + F.col("_before")
    rounds = plan.round(tokens.join(base, ["_queue", "_chunk"]), begin + F.col("_n"), F.col("_weight")).select(
        "_id", "_queue", begin.alias("_begin"), "_n", "_round", "_ids")
    # where every (round, queue) starts: within its block of rounds, and the blocks one after another
    cells = materialise(rounds.groupBy("_round", "_queue").agg(F.sum("_n").alias("_sum"), F.min("_begin").alias("_first"))
                        .withColumn("_block", F.floor(F.col("_round") / BLOCK)), "rounds")
    before = "rows between unbounded preceding and 1 preceding"
    blocks = cells.groupBy("_block").agg(F.sum("_sum").alias("_size")).select(
        "_block", F.expr(f"coalesce(sum(_size) over (order by _block {before}), 0)").alias("_at"))
    starts = cells.withColumn("_in", F.expr(f"coalesce(sum(_sum) over (partition by _block order by _round, _queue {before}), 0)")).join(blocks, "_block") \
        .select("_round", "_queue", (F.col("_at") + F.col("_in") - F.col("_first")).alias("_shift"))
    placed = rounds.join(starts.hint("merge"), ["_round", "_queue"]).select("_id", (F.col("_shift") + F.col("_begin")).alias("_at"), "_n", "_ids")
    schema = T.StructType([T.StructField("doc_id", placed.schema["_id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                rows, out = [], []
                for k, (begin, n, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 4)))):
                    ids, done = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), 0
                    while done < n:
                        seq, off = divmod(begin + done, length)
                        size = min(n - done, length - off)
                        rows.append(k)
                        out.append((done, size, ids[done:done + size].tobytes(), n, seq, off))
                        done += size
                new = [pa.array(v, t) for v, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *new], names=schema.names)

    return in_arrow(placed, run, schema)


def pack_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    pieces = pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
