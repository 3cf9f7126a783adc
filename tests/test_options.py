from __future__ import annotations

import pytest

from pagemill.options import JobOptions


def test_default_is_valid():
    assert JobOptions().validate().allowed_host == "books.toscrape.com"


@pytest.mark.parametrize("kw", [dict(parallelism=-1), dict(max_pages=0), dict(base_url=""),
                                dict(base_url="http://"), dict(output_format="xml"),
                                dict(retry_backoff_ms=3000, retry_backoff_max_ms=2000),
                                dict(max_retries=-1), dict(output_file="")])
def test_invalid(kw):
    with pytest.raises(ValueError):
        JobOptions(**kw).validate()


def test_env_overrides(monkeypatch):
    monkeypatch.setenv("PAGEMILL_MAX_PAGES", "7")
    monkeypatch.setenv("PAGEMILL_RESPECT_ROBOTS_TXT", "false")
    o = JobOptions.from_env(output_format="json")
    assert (o.max_pages, o.respect_robots_txt, o.output_format) == (7, False, "json")
    monkeypatch.setenv("PAGEMILL_PARALLELISM", "many")
    with pytest.raises(ValueError):
        JobOptions.from_env()


def test_shuffle_partition_sizing(spark):
    from pagemill.session import input_bytes, size_shuffle_partitions
    n = input_bytes(spark, ["/root/testdata/sf0.001/lineitem.parquet", "/nonexistent"])
    assert n > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert size_shuffle_partitions(spark, n) == int(before)  # small input: unchanged
    assert size_shuffle_partitions(spark, 10 * 1024 ** 4) == 81920  # 10 TiB / 128 MiB
    spark.conf.set("spark.sql.shuffle.partitions", before)
