"""Physical-plan properties of the driver queries (sf0.001 tables).

Every query stays JVM-side (no Python UDF nodes), never builds a cartesian
product or nested-loop join, and the page queries prune the ``html`` column
when they do not need it.  C1 trims hot URLs before its exchange.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from pagemill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

# round-trip and stream queries run their write jobs while being built
ACTIVE = {"csv_roundtrip", "jsonl_roundtrip", "dual_roundtrip", "stream_dedup", "stream_drain", "stream_deterministic",
          "stream_bounded", "stream_csv", "stream_dual", "stream_pages", "crawl_run",
          "follow_next", "chain_page_count",
          "output_validation", "stream_resume", "stream_failure", "stream_own_sink"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIVE))
def test_no_python_no_cartesian(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["allowed_domains", "robots_filter", "dedup_pages"])
def test_page_queries_prune_html(spark, name):
    df = E.queries()[name](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scans and all("html" not in s.split("ReadSchema:")[-1] for s in scans), scans


def test_prepare_items_partial_limit_before_exchange(spark):
    df = E.queries()["prepare_items"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") == 2  # partial before, final after the exchange
    assert "hashpartitioning(_kh" in p
