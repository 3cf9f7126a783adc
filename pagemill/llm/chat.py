"""Chat formatting by event-sourced reconstruction.

A log has one row per event: ``conv_id``, ``seq`` (order of events), ``msg``
(position of the message in its conversation), ``kind``, ``role``, ``text``.

* ``message`` begins a message with a role and a text; a second one at the same
  ``msg`` begins another message after it;
* ``delta`` appends to the latest message of its ``msg``;
* ``edit`` replaces that message's text;
* ``regenerate`` replaces it and voids what followed: later messages whose
  last full text is older than the regeneration are dropped.

The fold runs where the messages are: the log is dealt by conversation and
stretch of ``STRETCH`` messages, sorted by sequence and folded message by
message, so a hot conversation is spread over tasks.  What is left is one row
per stretch.  A voided message was never regenerated after it was voided, so the
cut before a stretch is the latest regeneration of the earlier ones: a window
over narrow rows.  Then every stretch is rendered, and read back, by itself; only the
hashes of a conversation are updated in order, a stretch at a time.

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
feed per turn.  In roles and texts a backslash is doubled and the first
character of every control string (and a line feed in a role) becomes a
backslash and a letter, so the rendering never holds a control string of its
content and reads back exactly.  The loss mask covers the escaped texts of
assistant turns, as code point spans of the rendering.

Defined cases: null text or role is empty; null ``conv_id`` is one conversation;
null ``msg`` or ``seq`` sorts first; equal events are separate messages, ordered
by role and text; a delta, edit or regeneration before any message begins an
assistant message; unknown kinds count as ``message``; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import BROADCAST_BYTES, in_arrow, materialise

STRETCH = 256
CUT_BYTES = 32  # of a stretch's cut in memory
START, END = "<|im_start|>", "<|im_end|>"
# Strings that chat templates reserve.
CONTROL = re.compile(r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\])|\\")
_LETTER = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
_CHAR = {"l": "<", "b": "[", "n": "\n", "\\": "\\"}
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("born", T.LongType()), T.StructField("regenerated", T.LongType())])
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("born", pa.int64()), ("regenerated", pa.int64())]))
FIRST = -(1 << 63)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: _LETTER[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CHAR[m[1]], text, flags=re.S) if "\\" in text else text


def fold(events) -> list[dict]:
    """Messages of one ``msg`` from its (seq, kind, role, text) events in order."""
    out: list[dict] = []
    parts: list[list[str]] = []
    for seq, kind, role, text in events:
        seq, text = FIRST if seq is None else seq, text or ""
        if kind in ("delta", "edit", "regenerate"):
            if not out:
                out.append({"role": role or "assistant", "born": seq, "regenerated": None})
                parts.append([])
            if kind == "delta":
                parts[-1].append(text)
                continue
            out[-1]["born"] = seq
            if kind == "regenerate":
                out[-1]["regenerated"] = seq
            parts[-1] = [text]
        else:
            out.append({"role": role or "", "born": seq, "regenerated": None})
            parts.append([text])
    for m, p in zip(out, parts):
        m["text"] = "".join(p)
    return out


def surviving(turns, cut: int | None = None) -> list[dict]:
    """Turns in order without those voided by the regeneration of an earlier one; ``cut`` is the latest before them."""
    out = []
    for t in turns:
        if cut is not None and t["born"] < cut:
            continue
        out.append(t)
        if t["regenerated"] is not None:
            cut = t["regenerated"] if cut is None else max(cut, t["regenerated"])
    return out


def render(turns) -> tuple[str, list[dict]]:
    """The formatted conversation and the loss spans (code points)."""
    parts, spans, at = [], [], 0
    for t in turns:
        head = START + escape(t["role"]).replace("\n", "\\n") + "\n"
        body = escape(t["text"])
        if t["role"] == "assistant":
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendering."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def stretches(events: DataFrame) -> DataFrame:
    """(_conv, _stretch, _turns): folded messages of every stretch of a conversation, written."""
    e = events.select(F.col("conv_id").alias("_conv"), F.floor(F.col("msg") / STRETCH).cast("long").alias("_stretch"), F.col("msg").cast("long").alias("_msg"),
                      F.col("seq").cast("long").alias("_seq"), F.col("kind").alias("_kind"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    e = e.repartition("_conv", "_stretch").sortWithinPartitions("_conv", "_stretch", "_msg", "_seq", "_role", "_text", "_kind")
    schema = T.StructType([*e.schema.fields[:2], T.StructField("_turns", T.ArrayType(TURN))])
    kinds = [e.schema.fields[0].dataType, T.LongType()]

    def run(batches):
        def emit(rows):
            from pyspark.sql.pandas.types import to_arrow_type
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], to_arrow_type(kinds[0])), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], _TURNS)], names=schema.names)

        key, msg, events_, turns, ready = None, None, [], [], []
        for b in batches:
            for conv, stretch, at, *event in zip(*(c.to_pylist() for c in b.columns[:3]), *(c.to_pylist() for c in b.columns[3:])):
                if (conv, stretch) != key or at != msg:
                    turns += fold(events_)
                    events_ = []
                    if (conv, stretch) != key:
                        if key is not None:
                            ready.append((*key, turns))
                            turns = []
                        if len(ready) >= 200:
                            yield emit(ready)
                            ready = []
                    key, msg = (conv, stretch), at
                events_.append(event)
        if key is not None:
            yield emit([*ready, (*key, turns + fold(events_))])

    return materialise(in_arrow(e, run, schema), "stretches")


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def format_pieces(events: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per stretch of a conversation: conv_id, piece (their order), formatted, loss (spans within the piece)."""
    s = stretches(events)
    before = "partition by _conv order by _stretch rows between unbounded preceding and 1 preceding"
    cuts = materialise(s.select("_conv", "_stretch", F.array_max("_turns.regenerated").alias("_last"))
                       .select("_conv", "_stretch", F.expr(f"max(_last) over ({before})").alias("_cut")).filter("_cut is not null"), "cuts")
    if cuts.count() * CUT_BYTES <= broadcast_bytes:
        cuts = F.broadcast(cuts)
    rows = s.alias("s").join(cuts.alias("c"), F.col("s._conv").eqNullSafe(F.col("c._conv")) & F.col("s._stretch").eqNullSafe(F.col("c._stretch")), "left") \
        .select("s._conv", "s._stretch", "s._turns", "c._cut")
    schema = T.StructType([T.StructField("conv_id", s.schema["_conv"].dataType), T.StructField("piece", T.LongType()),
                           T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                done = [render(surviving(turns, cut)) for turns, cut in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], _SPANS)],
                                                 names=schema.names)

    return in_arrow(rows, run, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """One row per conversation of an event log: conv_id, formatted, loss (spans).

    A conversation is one string here, of 2 GB at most; ``format_pieces`` has no such limit.
    """
    s = format_pieces(events).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = T.StructType([s.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(schema.fields[0].dataType)

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array(["".join(r[1]) for r in rows], pa.string()),
                                               pa.array([r[2] for r in rows], _SPANS)], names=schema.names)

        ready, at, held = [], 0, 0
        for b in batches:
            for conv, text, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not ready or conv != ready[-1][0]:
                    if held > 4_000_000 or len(ready) >= 500:
                        yield emit(ready)
                        ready, held = [], 0
                    ready.append((conv, [], []))
                    at = 0
                ready[-1][1].append(text)
                ready[-1][2].extend({"start": at + x["start"], "stop": at + x["stop"]} for x in loss)
                at, held = at + len(text), held + len(text)
        if ready:
            yield emit(ready)

    return in_arrow(s, run, schema)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log: one ``message`` event per row."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"), F.lit("message").alias("kind"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes read back from the renderings, whole or in pieces."""
    rows = formatted.select("conv_id", F.col("piece") if "piece" in formatted.columns else F.lit(0).cast("long").alias("piece"), "formatted", "loss")
    conv = rows.schema["conv_id"]
    read = T.StructType([conv, T.StructField("piece", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("said", T.BinaryType()),
                         T.StructField("chars", T.LongType()), T.StructField("learned", T.BinaryType()), T.StructField("size", T.LongType())])

    def read_piece(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part, out = b.slice(i, 64), []
                for text, spans in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    back = read_back(text)
                    learned = [unescape(text[s["start"]:s["stop"]]) for s in spans]
                    out.append((len(back), "".join(f"{role}\n{said}\n" for role, said in back).encode(), sum(map(len, learned)), "".join(learned).encode(), len(text)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, pa.binary() if k in (1, 3) else pa.int64()) for k, c in enumerate(cols))],
                                                 names=read.names)

    pieces = in_arrow(rows, read_piece, read).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    fields = T.StructType([conv, *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in fields]

        def emit(done):
            rows = [(c, n, said.hexdigest(), chars, learned.hexdigest(), size) for c, n, said, chars, learned, size in done]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=fields.names)

        done = []
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for conv_id, turns, said, chars, learned, size in zip(*(b.slice(i, 64).column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                    if not done or conv_id != done[-1][0]:
                        if len(done) >= 500:
                            yield emit(done)
                            done = []
                        done.append([conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                    now = done[-1]
                    now[2].update(said)
                    now[4].update(learned)
                    now[1], now[3], now[5] = now[1] + turns, now[3] + chars, now[5] + size
        if done:
            yield emit(done)

    return in_arrow(pieces, run, fields)


PROBE = "</s>[INST] ok [/INST]"  # fixed value: the turns of conversation -1


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digest of all conversations and of the probe conversation -1."""
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest(format_pieces(as_events(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))))


_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<|', '\\l|'), '</s>', '\\l/s>'), '<s>', '\\ls>'), " \
           "'<<SYS>>', '\\l<SYS>>'), '<</SYS>>', '\\l</SYS>>'), '[INST]', '\\bINST]'), '[/INST]', '\\b/INST]')"
QUERY_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('{START}' || role || chr(10) || {_ESCAPED.format("text")} || '{END}' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
