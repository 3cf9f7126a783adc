"""K4 for stores without an atomic rename: versioned folders and a commit by name.

An output is a folder of version folders ``v-<id>/<format>`` and of empty files
``_commit-<number>-<id>``.  A run writes and validates all its formats in a new
version and then creates its commit file, whose name says everything: creating an empty
file is atomic on file systems and object stores alike.  Readers take the commit
of the highest number, so they see the previous version until the next
one is there whole, in all its formats, and never none.

A run that dies before its commit leaves a version nobody resolves.  The next
commit removes the versions before the previous one (which readers may
still be reading) and versions without a commit that are older than a day.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import writers as S

_COMMIT = re.compile(r"_commit-(\d{12})-([0-9a-f]{12})")


def _list(spark: SparkSession, root: str):
    fs, p, jvm = S._fs(spark, root)
    return fs, jvm, list(fs.listStatus(p)) if fs.exists(p) else []


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of every commit, oldest first."""
    found = (_COMMIT.fullmatch(st.getPath().getName()) for st in _list(spark, root)[2])
    return sorted((int(m[1]), m[2]) for m in found if m)


def resolve(spark: SparkSession, root: str, fmt: str) -> str:
    """The folder that holds the current version's rows in ``fmt``."""
    done = commits(spark, root)
    if not done:
        raise FileNotFoundError(f"{root} has no committed version")
    return f"{root.rstrip('/')}/v-{done[-1][1]}/{fmt}"


def _commit(spark: SparkSession, root: str, version: str) -> None:
    fs, _, jvm = S._fs(spark, root)
    number = max((n for n, _ in commits(spark, root)), default=0) + 1
    if not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_commit-{number:012d}-{version}")):
        raise OSError(f"cannot commit version {version} of {root}")


def _clean(spark: SparkSession, root: str) -> None:
    """Commits before the previous one with their versions, and stale versions without a commit."""
    done = commits(spark, root)
    kept, fs, jvm, listed = {v for _, v in done[-2:]}, *_list(spark, root)
    old, now = {v for _, v in done[:-2]}, jvm.java.lang.System.currentTimeMillis()
    for st in sorted(listed, key=lambda st: st.getPath().getName(), reverse=True):  # versions ("v-") before their commits
        name = st.getPath().getName()
        m = _COMMIT.fullmatch(name)
        version = m[2] if m else name[2:] if name.startswith("v-") else None
        if version in old or (version and not m and version not in kept and now - st.getModificationTime() > S.STALE_MS):
            fs.delete(st.getPath(), True)


def write_items(items: DataFrame, fmt: str, root: str) -> dict:
    """K1-K3 as a new version of ``root``: CSV, JSON Lines, or both in one commit."""
    fmt = (fmt or "").strip().lower()
    if fmt not in S.FORMATS:
        raise ValueError(f"unsupported output format {fmt!r}; expected one of {S.FORMATS}")
    spark, version = items.sparkSession, uuid.uuid4().hex[:12]
    folder = f"{root.rstrip('/')}/v-{version}"
    counts, rows = {}, items
    try:
        if fmt == "dual":  # the input is computed once, into a copy that both formats are written from
            items.write.parquet(f"{folder}/rows")
            rows = spark.read.schema(items.schema).parquet(f"{folder}/rows")
        for name in ("csv", "json") if fmt == "dual" else (fmt,):
            seen = Observation()
            frame, options = (S.csv_frame(rows), S.CSV_OPTIONS) if name == "csv" else (S.json_frame(rows), S.JSON_OPTIONS)
            frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**options).format(name).save(f"{folder}/{name}")
            counts[name] = int(seen.get.get("rows", 0))
            if name == "json" and not counts[name]:
                raise S.OutputValidationError(f"no records written for {root}")
        if fmt == "dual":
            S.discard(spark, f"{folder}/rows")
        _commit(spark, root, version)
    except BaseException:
        S.discard(spark, folder)
        raise
    _clean(spark, root)
    return counts


def read_csv_items(spark: SparkSession, root: str) -> DataFrame:
    return S.read_csv_items(spark, resolve(spark, root, "csv"))


def read_jsonl_items(spark: SparkSession, root: str) -> DataFrame:
    return S.read_jsonl_items(spark, resolve(spark, root, "json"))
