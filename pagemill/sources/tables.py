"""Scans (S1, S3, S4): declared-schema readers and direct item submission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _read(spark: SparkSession, schema, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages ``(page_id, url, html[, fetched_at])``."""
    return _read(spark, schemas.PAGES, path, fmt)


def read_raw_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, schemas.RAW_ITEMS, path, fmt)


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: one row per fetch attempt."""
    return _read(spark, schemas.FETCH_LOG, path, fmt)


_ITEM_FIELDS = ["title", "price", "rating", "availability", "image_url", "url"]


def submit_items(*frames: DataFrame) -> DataFrame | None:
    """Union any number of raw-item frames by column name.

    No frame -> ``None`` (a no-op).  Records whose item fields are all NULL
    (the "nil record") are dropped without being counted (F5).
    """
    if not frames:
        return None
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    present = [c for c in _ITEM_FIELDS if c in df.columns]
    if present:
        df = df.filter(F.coalesce(*[F.col(c) for c in present]).isNotNull())
    return df
