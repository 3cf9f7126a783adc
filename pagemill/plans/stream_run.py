"""The streaming job: options -> stream -> drain -> validate -> summary."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..operators import extract as X
from ..options import JobOptions
from ..sinks import writers as S
from ..streaming import pipeline as SP


def run_stream(spark: SparkSession, opts: JobOptions, source: str, checkpoint: str, kind: str = "items",
               spec: X.ExtractSpec = X.CATALOGUE, timeout_s: float | None = None) -> dict:
    """Drain ``source`` (a folder of raw items, or of ``kind="pages"``) into
    ``opts.output_file``; one ``batch_id=N`` folder per micro-batch and format.

    ``pipeline_buffer_size`` over ``batch_size`` is the number of files a
    micro-batch may take, ``parallelism`` the number of state partitions, and
    ``dedupe_max_size`` > 0 bounds the de-duplication by ``dedup_horizon`` and
    is the size beyond which a warning is logged (0: exact, unbounded).
    """
    opts.validate()
    if kind not in ("items", "pages"):
        raise ValueError(f"unknown source kind {kind!r}")
    began = time.time()
    files = max(1, opts.effective_buffer_size // opts.effective_batch_size)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(opts.parallelism))
    try:
        raw = SP.page_stream(spark, source, files, spec) if kind == "pages" else SP.item_stream(spark, source, files)
        stream = SP.prepare_stream(raw, "bounded" if opts.dedupe_max_size else "exact", opts.dedup_horizon)
        query = SP.start(stream, SP.items_batch_sink(opts.output_file, opts.output_format), checkpoint, capacity=opts.dedupe_max_size)
    finally:  # the query has its own copy of the settings
        spark.conf.set("spark.sql.shuffle.partitions", before)
    try:
        SP.drain(query, timeout_s)
        done = SP.progress(query)
    finally:
        SP.forget(query)
    if done.processed == 0 and opts.output_format.lower() in ("json", "dual"):
        raise S.OutputValidationError(f"no records written for {opts.output_file}")  # K5
    elapsed = time.time() - began
    return {**asdict(done), "elapsed_s": round(elapsed, 3), "items_per_second": round(done.processed / elapsed, 3) if elapsed > 0 else 0.0}
