"""Files that tasks write into the cluster's shared folder.

A file gets its final name in one rename, and its name and bytes depend on the
partition alone: a task that runs again after a lost executor writes the same file.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.session import scratch_dir


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return scratch_dir(spark, purpose)


def put(folder: str, name: str, data: bytes) -> str:
    """Write one whole file; ``folder`` is a URI or an absolute path."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows stored once in the shared folder and read back: later uses neither
    compute them again nor lose them with an executor."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; else Spark joins it as it can."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """One row ``(path, content)`` per file, through Spark's own reader."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
    )


def remembered(key: Hashable, make: Callable):
    """What ``make`` gives, kept for the later tasks of the same Python worker.

    Functions travel by value and bring fresh globals to each task, so it is kept in a
    module of the worker process.
    """
    held = sys.modules.setdefault("_calllens_worker", types.ModuleType("_calllens_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
