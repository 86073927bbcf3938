"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on at scale.  Shuffle partition counts are left to
# AQE: it starts high and coalesces, so the same job fits 8 cores or 8,000.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a page far into a listing falls back to a range-partitioned sort
    # instead of holding every earlier row on the driver
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


_local_root: str | None = None


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder of this machine is used if the
    session is local; on a cluster that is an error, as executors would not share it.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="calllens-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A driver-side list as a table whose size Catalyst knows, so that it decides by
    its own threshold whether a join may broadcast it."""
    values = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.table({c: list(v) for c, v in zip(columns, values)}))


#: Rows of a task in a job that passes over a table many times: at least and at most.
LEAST_ROWS, MOST_ROWS = 5_000, 500_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The table, of so many rows, dealt over the cores.  AQE joins partitions by their bytes,
    so a table of short rows would lie in one, and one task would do the work of every pass."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, rows // LEAST_ROWS), -(-rows // MOST_ROWS))
    return df.repartition(parts) if parts > 1 else df


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the shared scratch folder and read back: later steps
    neither compute them again nor lose them with an executor."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
