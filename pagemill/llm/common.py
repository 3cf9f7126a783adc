"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.session import scratch_path

# A side is broadcast only if its measured size stays under this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

# Arrow batches between the JVM and Python workers; the defaults hold 64 MB of long texts, several times over.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 * 1024 * 1024}
SLICE = 256  # texts that a Python task holds as strings at a time

# Byte table of the word rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over text whose
# A-Z are lower-cased: digits, a-z and every non-ASCII byte stay, the rest part words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes (null: none)."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def in_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, so that a task's memory does not grow with its texts."""
    conf = df.sparkSession.conf
    for key, most in ARROW_BATCH.items():
        now = conf.get(key)
        if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], fields: str,
                keep: list[str] | None = None) -> DataFrame:
    """``df``'s ``keep`` columns (default: all) as ``_k0``, ``_k1``, ... and the DDL ``fields`` computed from ``text``.

    ``make()`` runs once per task and returns a function from a list of texts
    (null: empty) to one list per field.  A task holds one Arrow batch, of which
    ``SLICE`` texts at a time are Python strings.  Rows are neither moved nor
    dropped; names of ``df`` cannot clash.
    """
    keep = df.columns if keep is None else keep
    new = T.StructType.fromDDL(fields)
    inner = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        fn = make()
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.num_columns - 1)
                parts = [[pa.array(v, type=t) for v, t in zip(fn(texts.slice(i, SLICE).to_pylist()), types)]
                         for i in range(0, batch.num_rows, SLICE)]
                arrays = batch.columns[:-1] + [pa.concat_arrays(p) for p in zip(*parts)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        pa.default_memory_pool().release_unused()  # worker processes outlive their tasks

    return in_arrow(inner, run, schema)


def original_columns(names: list[str]) -> list[Column]:
    """The columns that ``add_columns`` carried along, under their own names."""
    return [F.col(f"_k{i}").alias(c) for i, c in enumerate(names)]
