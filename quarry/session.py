"""Session construction and shared-storage paths.

Library functions never build a session themselves; they take the caller's
``DataFrame``/``SparkSession``.  ``get_spark`` exists for tests, the bench and
the driver entry points.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Inputs of multi-pass operators up to this estimate are kept in memory.
KEEP_BYTES = 256 * 1024 * 1024


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry") -> SparkSession:
    """Build (or reuse) a session with the settings the library is tuned for.

    On a cluster, ``master`` is left to spark-submit and the shuffle partition
    count should be sized to the data (about 128-256 MB per partition); AQE then
    coalesces small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of frames that are no longer referenced are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # the submitter's choice; local runs hold executors and driver in one JVM
        **({"spark.driver.memory": os.environ["QUARRY_DRIVER_MEMORY"]} if "QUARRY_DRIVER_MEMORY" in os.environ else {}),
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (shared storage).  Where it is
    unset, a local session gets a private temporary folder (tests), any other
    an error: executors would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quarry-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back:
    lineage is cut, and later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of ``df`` (upper end for joins)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def reused(df: DataFrame, enabled: bool | str = True):
    """Keep ``df`` for the several passes of a multi-pass operator.

    ``enabled=True`` is for derived frames (joins, aggregates): the frame is
    written once under ``spark.checkpoint.dir`` (shared storage), so a lost
    executor costs a re-read of files rather than a re-run of the joins.
    ``enabled="auto"`` keeps an input that Catalyst estimates at no more than
    ``KEEP_BYTES``, spread over the cores, in memory; anything larger is left
    alone, since each pass re-reads just its own columns.
    """
    if not enabled:
        yield df
    elif enabled != "auto":
        yield stored(df, "reused")
    elif df.storageLevel.useMemory or plan_bytes(df) > KEEP_BYTES:
        yield df
    else:
        kept = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_ONLY)
        try:
            yield kept
        finally:
            kept.unpersist()
