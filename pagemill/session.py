"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins and splits skewed shuffle partitions at run time.
# Keeping partitionings that cluster on a prefix of the join keys lets everything keyed by
# page reuse one exchange.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Parsing is CPU-bound per byte: let small inputs still spread over all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A Python worker holds a batch, as Arrow and as objects: pages are thousands of times longer than numbers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def build_session(master: str | None = None, app: str = "pagemill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def is_shared(folder: str, master: str) -> bool:
    """Whether all executors see the files of a folder: those of a local session do, else it must not be on a disk."""
    return master.startswith("local") or urlsplit(folder).scheme not in ("", "file")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, shared by all executors.

    It is the one that ``spark.checkpoint.dir`` names or the context already has; where neither is set,
    as in tests, a folder of the warehouse. On a cluster that must be in a shared store, or this is an error: each
    executor would write to its own disk, and nobody would find the files.
    """
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not configured and not is_shared(warehouse, spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or f"{warehouse.rstrip('/')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, next to the checkpoints and so just as shared."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """Write rows that several later steps read, and go on from the written table.

    The page windows then run once, later steps read only the columns they need, and a lost
    executor costs a re-read instead of the whole lineage.
    """
    path = scratch_dir(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that shuffles both sides, whatever Spark takes its size for.

    Spark takes an array for one entry, a text for 20 bytes, repeated rows for as few as were there before, and a written
    table for its compressed files. So what it would broadcast as a few MB can be more than the driver holds.
    """
    return rows.hint("merge")
