"""Alignment of two tokenizers, with inverted bitmaps of the id pairs they link.

A text is encoded by a byte-level tokenizer A and a piece tokenizer B.  Byte offsets
where tokens of both end cut the tokens into groups, and every A token of a
group is linked with every B token of it.

1. Every task encodes its documents once and inverts them in chunks of at most
   ``CHUNK`` documents and ``LINKS`` distinct links: per pair and chunk, one
   compressed bitmap of documents per binary digit of the pair's number of links in
   them (the multiplicity planes).  Sparse bitmaps are sorted 16-bit places,
   dense ones are bits.  All of it is written.
2. A pair's planes are OR-merged and popcounted for its documents of a chunk, and the
   chunks, which are disjoint, are added up: the pair's count.  The weighted popcounts
   of the planes give its links.  Both are sums that combine map-side; no key
   has more rows than there are chunks.
3. Counts and the best count of every A id (at most as many rows as A has ids) meet
   the postings, and the postings of a chunk return every link's count to its documents.

A very long text is encoded in parts, cut where neither tokens nor groups can cross: a
single space between two printable Latin characters begins a token of A and a piece
of B whatever stands around it.

Defined cases: null and empty texts, and texts whose tokens do not give their bytes
back, have no tokens; repeated rows count as one document each; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import in_arrow, materialise

CHUNK = 8192  # documents of a chunk
LINKS = 3_000_000  # distinct links of a chunk, unless one document has more
IDS_B = 1 << 16  # a pair's key is A's id times this plus B's id
LONG = 1 << 20  # characters from which a text is encoded in parts
BLANK = 10_000  # characters of white space in a row
BATCH = 1 << 20  # characters that are aligned at a time, unless one part has more
WIDE = 1 << 22  # links that are formed at a time


def _byte_alphabet() -> dict[str, int]:
    """The byte of every character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """The two tokenizers of a worker process, with the bytes of their tokens."""

    # between these, a single space parts words for both tokenizers
    SAFE = re.compile("(?<=[!-~À-ÖØ-öø-ÿ]) (?=[!-~À-ÖØ-öø-ÿ])")
    BLANKS = re.compile(rf"\s{{{BLANK}}}")  # overflow the stack of the ranked library's pattern at some length
    BYTE = re.compile("<0x([0-9A-F]{2})>")

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        if max(self.a.get_vocab_size(), self.b.get_piece_size()) > IDS_B:
            raise ValueError("ids above 65,535 do not fit a pair's key")
        by_id = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                        for t in (by_id.get(i, "") for i in range(max(by_id) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := self.BYTE.fullmatch(p)) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.ranked = self._ranked(path_a)
        # words part at spaces only if no piece holds a space after another character
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.bytes_a, self.bytes_b))
        # an id as digest text: before another of its side, before the other side, before the next group
        self.digits = [b"%d%c" % (i, c) for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in b",|;"]

    def _ranked(self, path_a: str):
        """A's vocabulary in the library that merges by rank, several times as fast; None unless its ids are the ranks of its merges."""
        import tiktoken
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], model.get("merges", [])
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if (spec.get("normalizer") or spec.get("post_processor") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
                or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges")
                or any(vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + i for i, m in enumerate(merges))):
            return None
        ranks = {self.bytes_a[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.a.encode(t, add_special_tokens=False).ids if len(t) > BLANK and self.BLANKS.search(t) else self.ranked.encode_ordinary(t) for t in texts]

    def cut(self, text: str) -> list[str]:
        """The text in parts that align by themselves; the space between two parts belongs to the second."""
        parts, begin = [], 0
        while self.parts and len(text) - begin > LONG and (m := self.SAFE.search(text, begin + LONG)):
            parts.append(text[begin:m.start()])
            begin = m.end()
        return [*parts, text[begin:]] if text else []

    def align(self, texts: list[str]) -> list[tuple[list, np.ndarray, np.ndarray]]:
        """Per text: n_a, n_b, n_groups, n_links and the groups' digest; its linked pairs; how often each is linked."""
        found = [_Sum() for _ in texts]
        batch, size = [], 0
        for k, text in enumerate(texts):
            for part in self.cut(text):
                batch.append((k, part))
                size += len(part)
                if size > BATCH:
                    self._align(batch, found)
                    batch, size = [], 0
        if batch:
            self._align(batch, found)
        return [f.result() for f in found]

    def _align(self, batch: list[tuple[int, str]], found: list[_Sum]) -> None:
        ids_a = self._ids_a([" " + s for _, s in batch])
        ids_b = self.b.encode([s for _, s in batch], num_threads=1)
        kept, sizes = [], []
        for k, ((text, part), xs, ys) in enumerate(zip(batch, ids_a, ids_b)):
            raw = b" " + part.encode()
            if b"".join(map(self.bytes_a.__getitem__, xs)) == raw and b"".join(map(self.bytes_b.__getitem__, ys)) == raw:
                kept.append(k)
                sizes.append(len(raw))
            else:
                found[text].lost = True
        if not kept:
            return
        stop_a, stop_b = np.cumsum([len(ids_a[k]) for k in kept]), np.cumsum([len(ids_b[k]) for k in kept])
        a = np.fromiter(chain.from_iterable(ids_a[k] for k in kept), np.int64, stop_a[-1])
        b = np.fromiter(chain.from_iterable(ids_b[k] for k in kept), np.int64, stop_b[-1])
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # of all parts laid one after another
        marks = np.zeros(sum(sizes) + 1, np.int8)
        marks[end_a] = 1
        marks[end_b] += 2
        last_a, last_b = marks[end_a] == 3, marks[end_b] == 3  # tokens that end a group; every part ends with one
        after_a, after_b = np.cumsum(last_a), np.cumsum(last_b)
        group_a, group_b = after_a - last_a, after_b - last_b
        per_a, per_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        # the digest's order: A's ids of a group, then B's
        text = np.empty(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + first_b[group_a]] = 3 * a + last_a
        text[np.arange(len(b)) + (first_a + per_a)[group_b]] = 3 * b + 2 * last_b
        stops = after_a[stop_a - 1]
        links = np.cumsum(per_a * per_b)
        owner = np.repeat(np.array([batch[k][0] for k in kept], np.int64), np.diff(stops, prepend=0))
        keys, times = _pairs(group_a, a, group_b, b, owner, per_a, per_b, first_b)
        edges = np.searchsorted(keys >> np.int64(32), np.arange(len(found) + 1)).tolist()
        begin = (0, 0, 0, 0)
        for k, *end in zip(kept, stop_a.tolist(), stop_b.tolist(), stops.tolist(), links[stops - 1].tolist()):
            ids = text[begin[0] + begin[1]:end[0] + end[1]].tolist()
            found[batch[k][0]].add([y - x for x, y in zip(begin, end)], b"".join(map(self.digits.__getitem__, ids)))
            begin = end
        for t in {batch[k][0] for k in kept}:
            i, j = edges[t], edges[t + 1]
            found[t].link((keys[i:j] & np.int64(0xFFFFFFFF)).astype(np.uint32), times[i:j])


class _Sum:
    """What the parts of a text add up to."""

    def __init__(self):
        self.figures, self.digest, self.pairs, self.times, self.lost, self.parts = [0, 0, 0, 0], hashlib.sha256(), [], [], False, 0

    def add(self, figures: list[int], groups: bytes) -> None:
        self.figures = [x + y for x, y in zip(self.figures, figures)]
        self.digest.update((b";" if self.parts else b"") + groups[:-1])
        self.parts += 1

    def link(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.times.append(times)

    def result(self) -> tuple[list, np.ndarray, np.ndarray]:
        if self.lost or not self.parts:
            return [0, 0, 0, 0, ""], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pairs, times = (self.pairs[0], self.times[0]) if len(self.pairs) == 1 else _summed(np.concatenate(self.pairs), np.concatenate(self.times))
        return [*self.figures, self.digest.hexdigest()], pairs, times


def _pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, owner: np.ndarray,
           per_a: np.ndarray, per_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (owner of the group << 32 | A's id * IDS_B + B's id) of all linked pairs, and how often each is linked.

    Where groups are large, ids repeated in a group are counted first, so that only distinct ids are paired.
    """
    if (per_a * per_b).sum() > 4 * (len(a) + len(b)):
        (group_a, a, count_a), (group_b, b, count_b) = (_distinct(g, x) for g, x in ((group_a, a), (group_b, b)))
        per_b = np.bincount(group_b, minlength=len(per_b))
        first_b = np.cumsum(per_b) - per_b
    else:
        count_a = count_b = None
    keys, times = [], []
    width = per_b[group_a]
    stops = np.cumsum(width)
    begin = 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(stops, (stops[begin - 1] if begin else 0) + WIDE, side="right")))
        w = width[begin:end]
        i = np.repeat(np.arange(begin, end), w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w - first_b[group_a[begin:end]], w)
        key = (owner[group_a[i]] << np.int64(32)) + a[i] * IDS_B + b[j]
        k, c = np.unique(key, return_counts=True) if count_a is None else _summed(key, count_a[i] * count_b[j])
        keys.append(k)
        times.append(c)
        begin = end
    return _summed(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(group * np.int64(IDS_B) + ids, return_counts=True)
    return keys // IDS_B, keys % IDS_B, counts


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(keys) else values


def bitmap(places: np.ndarray, chunk: int) -> bytes:
    """Sorted places below ``chunk``: 16-bit numbers if that is shorter than the bits."""
    if 2 * len(places) < chunk // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(chunk, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places_of(bits: bytes, chunk: int) -> np.ndarray:
    if len(bits) < chunk // 8:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


class Chunk:
    """Postings of the documents of a chunk, inverted when it is full."""

    def __init__(self):
        self.documents, self.keys, self.times, self.links = 0, [], [], 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(pairs.astype(np.int64) << np.int64(16) | self.documents)
        self.times.append(times)
        self.links += len(pairs)
        self.documents += 1

    def postings(self, size: int):
        """Per pair: its key, its documents' popcount, its links, and the bitmap of every plane (empty: none)."""
        if not self.links:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        pairs, places = keys >> np.int64(16), keys & np.int64(0xFFFF)
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        stops = np.append(starts[1:], len(pairs))
        most = np.maximum.reduceat(times, starts)
        raw = places.astype("<u2").tobytes()
        for start, stop, pair, top in zip(starts.tolist(), stops.tolist(), pairs[starts].tolist(), most.tolist()):
            if top == 1 and 2 * (stop - start) < size // 8:
                yield pair, stop - start, stop - start, [raw[2 * start:2 * stop]]  # one plane, sparse
                continue
            at, t = places[start:stop], times[start:stop]
            planes = [at[(t >> k) & 1 == 1] for k in range(int(top).bit_length())]
            held = np.zeros(size, bool)  # the planes OR-merged
            for plane in planes:
                held[plane] = True
            yield pair, int(held.sum()), sum(len(p) << k for k, p in enumerate(planes)), [bitmap(p, size) if len(p) else b"" for p in planes]


_READY: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    """The tokenizers of this worker process, with what they remember from earlier tasks."""
    key = (path_a, path_b)
    if key not in _READY:
        _READY[key] = Pair(path_a, path_b)
    return _READY[key]


INDEX = "chunk long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, documents long, links long, planes array<binary>"


def invert(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, most_links: int = LINKS) -> DataFrame:
    """The index, written once: a row (chunk, place, doc_id, figures) per document and a row (chunk, pair, documents, links, planes) per pair and chunk."""
    if not 8 <= chunk <= 1 << 16 or chunk % 8:
        raise ValueError("a chunk holds 8 to 65,536 documents, a multiple of 8")
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL(INDEX).fields])
    arrow = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]

    def batch(ids: pa.Array, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, arrow)]], names=schema.names)

    def run(batches):
        tokenizers, number, full = _pair(path_a, path_b), TaskContext.get().partitionId() << 32, Chunk()

        def flush(id_type):
            postings = full.postings(chunk)
            while part := [p for _, p in zip(range(4096), postings)]:
                pairs, documents, links, planes = zip(*part)
                n = len(part)
                yield batch(pa.nulls(n, id_type), [[number] * n, *[[None] * n] * 6, pairs, documents, links, planes])

        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                out = []
                for figures, pairs, times in tokenizers.align(part.column(1).to_pylist()):
                    if full.documents == chunk or full.links > most_links:
                        yield from flush(id_type)
                        full, number = Chunk(), number + 1
                    out.append((number, full.documents, *figures))
                    full.add(pairs, times)
                yield batch(part.column(0), [*map(list, zip(*out)), *[[None] * len(out)] * 4])
        yield from flush(id_type)
        pa.default_memory_pool().release_unused()  # worker processes outlive their tasks

    return materialise(in_arrow(rows, run, schema), "pair-bitmaps")


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, documents, links) of the whole corpus."""
    return index.filter("pair is not null").groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def token_pairs(index: DataFrame) -> DataFrame:
    """One row per linked id pair: id_a, id_b, documents, links, and whether no other pair of the same A id has more documents."""
    counts = pair_counts(index).withColumn("id_a", F.floor(F.col("pair") / IDS_B))
    best = counts.groupBy("id_a").agg(F.max("documents").alias("_best"))
    return counts.join(F.broadcast(best), "id_a").select(  # a row per id of A's vocabulary at most
        "id_a", (F.col("pair") % IDS_B).alias("id_b"), "documents", "links", (F.col("documents") == F.col("_best")).alias("best"))


def document_scores(index: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: its figures, n_best and count_sum."""
    scored = materialise(token_pairs(index).select((F.col("id_a") * IDS_B + F.col("id_b")).alias("pair"), F.col("documents").alias("_count"), "best"), "pair-counts")
    figures = index.filter("pair is null").select("*", F.lit(None).cast("long").alias("_count"), F.lit(None).cast("boolean").alias("_best"))
    # a pair has one posting per chunk and chunks hold thousands of pairs: no hot key on either side
    met = index.filter("pair is not null").join(scored.withColumnRenamed("best", "_best"), "pair").select(*figures.columns)
    keep = ["doc_id", "chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "planes", "_count", "_best"]
    dealt = figures.unionAll(met).select(*keep).repartition("chunk").sortWithinPartitions("chunk")
    schema = T.StructType([T.StructField("doc_id", index.schema["doc_id"].dataType), *T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def run(batches):
        now, held, best, total = None, [], None, None

        def done():
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            places = rows.column(1).to_numpy()
            yield from pa.Table.from_arrays([rows.column(0), *[rows.column(c) for c in range(2, 6)], pa.chunked_array([pa.array(best[places])]),
                                             pa.chunked_array([pa.array(total[places])]), rows.column(6)], names=schema.names).to_batches(2000)

        for b in batches:
            chunks = b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(chunks)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                if chunks[lo] != now:
                    yield from done()
                    now, held, best, total = chunks[lo], [], np.zeros(chunk, np.int64), np.zeros(chunk, np.int64)
                part = b.slice(lo, hi - lo)
                is_pair = part.column(9).is_valid()
                rows = part.filter(pc.invert(is_pair))
                if rows.num_rows:
                    held.append(pa.RecordBatch.from_arrays([rows.column(c) for c in (0, 2, 3, 4, 5, 6, 7)], names=list("abcdefg")))
                _give_back(part.filter(is_pair), chunk, best, total)
        yield from done()

    return in_arrow(dealt, run, schema)


def _give_back(postings: pa.RecordBatch, chunk: int, best: np.ndarray, total: np.ndarray) -> None:
    """Adds every posting's count to its documents, as often as its planes say."""
    if not postings.num_rows:
        return
    planes = postings.column(8)
    offsets = planes.offsets.to_numpy()
    flat = planes.values
    starts = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_binary(flat.type) else np.int32)[flat.offset:].astype(np.int64)
    row = np.repeat(np.arange(postings.num_rows), np.diff(offsets))
    level = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    size = np.diff(starts[:len(flat) + 1])[offsets[0]:offsets[-1]]
    count = postings.column(9).to_numpy(zero_copy_only=False)
    is_best = postings.column(10).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin = starts[offsets[0]:offsets[-1]]
    sparse = size < chunk // 8
    # all sparse bitmaps of the batch at once
    width = np.where(sparse, size, 0)
    at = np.repeat(begin, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    places = data[at].view("<u2").astype(np.int64)
    weight = np.repeat(np.int64(1) << level, width // 2)
    of = np.repeat(row, width // 2)
    np.add.at(total, places, weight * count[of])
    np.add.at(best, places, weight * is_best[of])
    for k in np.flatnonzero(~sparse).tolist():
        places = places_of(data[begin[k]:begin[k] + size[k]].tobytes(), chunk)
        total[places] += count[row[k]] << int(level[k])
        best[places] += is_best[row[k]] << int(level[k])


def alignment_report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    index = invert(docs, path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"), chunk)
    return document_scores(index, chunk)
