"""Session helpers: a local session for tests/bench and shared-folder lookup.

On a cluster the session comes from the platform; the library never
creates one there.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from
the session and only falls back to a scratch folder when it is unset (local
tests), so lineage cuts and staged writes land on the shared file system the
cluster names.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (timestamps are formatted as
# RFC 3339 with an offset), AQE for runtime coalescing and skew-join splitting.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pagemill", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("PAGEMILL_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    for k, v in {**CORE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_core_conf(spark: SparkSession) -> None:
    """Pin the session settings the operators' semantics depend on (UTC)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints/staging.

    Uses the cluster's ``spark.checkpoint.dir`` (and registers it with the
    SparkContext if only the conf carries it); only when it is unset (tests,
    local runs) a fresh scratch folder is created and registered.  On any
    other master an unset folder is an error: executors share no local folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pagemill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder.

    Results may read it as long as the session lives, so it is deleted when
    the driver process ends (or by ``release_scratch``, when nothing reads it).
    """
    if not _SCRATCH:
        atexit.register(_at_exit)
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch path handed out so far."""
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop())


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:  # else it was stopped, and with it the means to delete
        release_scratch(spark)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# Target bytes of input per shuffle partition when sizing a job.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """On-disk size of the input paths (file-system metadata, no job)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return total


def size_shuffle_partitions(spark: SparkSession, nbytes: int,
                            target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Raise ``spark.sql.shuffle.partitions`` so that one shuffle partition
    holds about ``target_bytes`` of input (AQE then coalesces small ones).

    Never lowers the configured value (the cluster's choice wins when it is
    larger); returns the value in effect.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    wanted = max(1, -(-int(nbytes) // int(target_bytes)))
    if wanted > current:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
        return wanted
    return current
