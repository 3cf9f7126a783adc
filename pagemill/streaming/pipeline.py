"""Structured Streaming item pipeline (ST1-ST7, D2).

``readStream`` (bounded per trigger: ST2 back-pressure) -> F1 validation
(stateless) -> de-duplication on ``url`` across micro-batches (ST3) ->
N2-N5 -> ``foreachBatch`` sink.  The executors are the workers.

De-duplication modes:
* ``exact`` (default): stateful ``dropDuplicates(["url"])`` without a
  watermark; the state store (RocksDB, see ``start``) spills to disk and
  survives restarts from the checkpoint.  The earliest micro-batch wins.
* ``bounded`` (D2): ``dropDuplicatesWithinWatermark`` on the time a row
  *arrived*.  State is evicted after the horizon, so a URL may reappear later -
  the time-bounded form of an LRU cap - but no row is ever late, so none is
  lost, however old its own time stamp is.

* by number (D2, ``recency.recency_dedup_sink``): a table of the most recently
  seen URLs, refreshed by every probe.

The sinks write ``batch_id=N`` sub-folders and touch only their own
folder, so a replayed micro-batch is idempotent.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text as T
from ..operators import extract as X
from ..operators.items import DUPLICATE, INVALID, PROCESSED, UNPARSEABLE, dedup_first, normalize_items, url_key, validation_reason
from ..schemas import PAGES, RAW_ITEMS
from ..sinks import writers as S
from .keyindex import KeyIndex
from .recency import batch_folders

log = logging.getLogger(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DrainTimeout(TimeoutError):
    """ST4: the stream did not finish draining in time."""


def item_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                schema=RAW_ITEMS, fmt: str = "parquet") -> DataFrame:
    """A stream of raw-item files; ``max_files_per_trigger`` bounds each
    micro-batch (the buffer/batch size of the reference)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def page_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                spec: X.ExtractSpec = X.CATALOGUE, fmt: str = "parquet") -> DataFrame:
    """S1 + E0 as a stream: pages to raw items, page by page."""
    return X.extracted_raw_items(item_stream(spark, path, max_files_per_trigger, PAGES, fmt), spec)


def prepare_stream(raw: DataFrame, dedup: str = "exact", horizon: str = "1 hour") -> DataFrame:
    """ST1/ST3: F1 before de-dup (an invalid row never claims a URL), then
    N2-N5.  Two observations publish the progress counters (ST7)."""
    ok = validation_reason().isNull()
    valid = url_key(raw.observe("input", F.count_if(ok).alias("valid"), F.count_if(~ok).alias(INVALID)).filter(ok))
    if dedup == "exact":
        uniq = valid.dropDuplicates(["url"])
    elif dedup == "bounded":
        uniq = (valid.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
                .dropDuplicatesWithinWatermark(["url"]))
    else:
        raise ValueError(f"unknown dedup mode {dedup!r}")
    unparseable = T.parse_price(T.normalize_price("price")).isNull()
    return normalize_items(uniq.observe("progress", F.count(F.lit(1)).alias(PROCESSED), F.count_if(unparseable).alias(UNPARSEABLE)))


def items_batch_sink(path: str, fmt: str = "csv") -> Callable[[DataFrame, int], None]:
    """Every micro-batch as CSV, JSON Lines or both, all of it or nothing.

    The batch's formats are written to ``_pending`` folders, which readers do not
    see; then one empty file ``_commits/batch_id=N`` commits them, and
    they are moved to ``batch_id=N``.  A failure before the record leaves
    nothing visible and the replay writes anew; after it, the replay finishes the
    moves and computes the batch without output, as its streaming state is not committed
    before the batch has ended.  ``dual`` computes the batch once and derives both formats from
    that copy.
    """
    fmt = fmt.strip().lower()
    if fmt not in S.FORMATS:
        raise ValueError(f"unsupported output format {fmt!r}; expected one of {S.FORMATS}")
    csv, json = path.rstrip("/"), S.dual_json_path(path.rstrip("/")) if fmt == "dual" else path.rstrip("/")
    outputs = [(root, name) for root, name in ((csv, "csv"), (json, "json")) if fmt in (name, "dual")]
    record = f"{outputs[0][0]}/_commits/batch_id={{}}"

    def stage(df: DataFrame, batch_id: int) -> None:
        spark, copy = df.sparkSession, None
        if fmt == "dual":
            copy = f"{csv}/_pending/rows-{batch_id}"
            df.write.mode("overwrite").parquet(copy)
            df = spark.read.schema(df.schema).parquet(copy)
        for root, name in outputs:
            frame, options = (S.csv_frame(df), S.CSV_OPTIONS) if name == "csv" else (S.json_frame(df), S.JSON_OPTIONS)
            frame.write.mode("overwrite").options(**options).format(name).save(f"{root}/_pending/batch_id={batch_id}")
        if copy:
            S.discard(spark, copy)

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if not S.exists(spark, record.format(batch_id)):
            stage(df, batch_id)
            S.touch(spark, record.format(batch_id))
        else:
            df.write.format("noop").mode("overwrite").save()
        for root, _ in outputs:  # from here on the batch is committed; a replay finishes the moves
            S.move_over(spark, f"{root}/_pending/batch_id={batch_id}", f"{root}/batch_id={batch_id}")
    return write


def parquet_batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent per-batch writer (``batch_id=N`` folder overwrite)."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def deterministic_dedup_sink(path: str) -> Callable[[DataFrame, int], None]:
    """ST3, deterministic-winner option: a ``foreachBatch`` writer for a raw
    item stream (no streaming state).

    Inside the micro-batch the first valid row per URL by the de-dup order
    wins (D1, partial-limit window); URLs published by *earlier* batches are
    removed, then the batch is normalised and written to ``batch_id=N`` with
    overwrite.  A replayed batch therefore produces the same rows.

    What was published is looked up in an index of hash buckets with Bloom
    filters (``keyindex``), of which a batch reads the buckets that may hold
    its URLs.  For that the batch's winners are staged, so that its input is read once.  The index follows the folders: a batch that is written but not
    indexed, as a crash may leave it, is indexed before the next look-up.
    """
    root = path.rstrip("/")

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        index = KeyIndex(spark, f"{root}/_index")
        first = dedup_first(url_key(df.filter(validation_reason().isNull())))
        held = [range(s[0], s[1] + 1) for s in index.segments()]
        earlier = {n: p for n, p in batch_folders(spark, root).items() if n < batch_id}
        for n, p in sorted(earlier.items()):
            if not any(n in r for r in held):
                index.add(spark.read.schema("url string").parquet(p), n, n)
        staged = f"{root}/_staged-{batch_id}"
        if earlier:
            index.merge(batch_id)
            first.write.mode("overwrite").parquet(staged)
            first = spark.read.schema(first.schema).parquet(staged)
            first = first.join(index.published(first.select("url"), batch_id), "url", "left_anti").select(*first.columns)
        normalize_items(first).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
        S.discard(spark, staged)
        index.add(spark.read.schema("url string").parquet(f"{root}/batch_id={batch_id}"), batch_id, batch_id)
    return write


class ProgressCounter(StreamingQueryListener):
    """Counts every micro-batch of the queries it hears, not only the recent ones."""

    def __init__(self, capacity: int = 0):
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.capacity, self.warned, self.run = capacity, False, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.run and str(p.runId) != self.run:  # listeners hear every query of the session
            return
        self.batches[str(p.runId), p.batchId] = batch_counts(p)
        held = sum(op.numRowsTotal for op in p.stateOperators)
        if self.capacity and held > self.capacity and not self.warned:
            self.warned = True
            log.warning("de-duplication holds %d URLs, more than the configured %d", held, self.capacity)


def batch_counts(p) -> dict[str, int]:
    """Counters of one micro-batch's progress (an object or its dict form)."""
    def field(name):
        return p[name] if isinstance(p, dict) else getattr(p, name, None)

    out = {"input_rows": int(field("numInputRows") or 0)}
    for row in (field("observedMetrics") or {}).values():
        out.update({k: int(v or 0) for k, v in (row.asDict() if hasattr(row, "asDict") else row).items()})
    return out


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          available_now: bool = True, name: str | None = None, capacity: int = 0, state_partitions: int | None = None) -> StreamingQuery:
    """Start the stream with RocksDB state (keys on disk, not in executor
    memory) and a progress counter, read by ``progress``.  ``state_partitions`` replaces the
    session's shuffle partitions, of which each micro-batch opens and commits all; rows of state are
    counted, at a look-up a row, where a ``capacity`` is watched."""
    spark = stream.sparkSession
    counter = ProgressCounter(capacity)
    spark.streams.addListener(counter)
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": str(capacity > 0).lower()}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():  # a query copies the session's settings when it starts
            spark.conf.set(key, value)
        query = w.start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    counter.run = str(query.runId)
    COUNTERS[counter.run] = counter
    return query


COUNTERS: dict[str, ProgressCounter] = {}


def forget(query: StreamingQuery) -> None:
    """Remove the listener of an ended query; ``progress`` then knows its recent batches only."""
    counter = COUNTERS.pop(str(query.runId), None)
    if counter:
        SparkSession.active().streams.removeListener(counter)


def drain(query: StreamingQuery, timeout_s: float | None = 30.0) -> None:
    """ST4/ST6: wait until all available input is written.  A sink error
    surfaces here as ``StreamingQueryException``; not finishing in time stops
    the query and raises :class:`DrainTimeout` (``None``: no limit)."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise DrainTimeout(f"stream {query.name or query.id} did not drain within {timeout_s}s")
    if query.exception() is not None:
        raise query.exception()


def cancel(query: StreamingQuery) -> None:
    """ST5: stop; the checkpoint makes a restart resume where it stopped."""
    query.stop()


@dataclass
class Progress:
    batches: int
    input_rows: int
    processed: int
    invalid_record: int
    duplicate_url: int
    unparseable_price: int


def progress(query: StreamingQuery) -> Progress:
    """ST7: counters over all micro-batches of the query's run.

    The listener hears of a batch a moment after it ends, so the query's own
    recent progress is added to what it has."""
    counter = COUNTERS.get(str(query.runId))
    batches = {k[1]: v for k, v in counter.batches.items() if k[0] == str(query.runId)} if counter else {}
    for p in query.recentProgress:
        batches[p["batchId"] if isinstance(p, dict) else p.batchId] = batch_counts(p)
    total = {k: sum(b.get(k, 0) for b in batches.values()) for k in ("input_rows", "valid", PROCESSED, INVALID, UNPARSEABLE)}
    return Progress(len(batches), total["input_rows"], total[PROCESSED], total[INVALID],
                    max(0, total["valid"] - total[PROCESSED]) if total["valid"] else 0, total[UNPARSEABLE])
