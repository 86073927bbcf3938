"""Transcript and audio arrivals as streams, and the sinks that store results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calllens.config import Profile
from calllens.functions.text import base_name
from calllens.plans.analysis import analyze_calls
from calllens.sources.files import audio_uploads, with_transcript


def ingest_transcripts(
    spark: SparkSession, path: str, profile: Profile, max_files: int = 1000
) -> DataFrame:
    """Each new transcript file once; the checkpoint remembers what was read."""
    files = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(path, wholetext=True, recursiveFileLookup=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            base_name(F.col("_metadata.file_path")).alias("file_name"),
            F.col("_metadata.file_modification_time").alias("uploaded_at"),
            F.col("value").alias("raw"),
        )
    )
    return with_transcript(files, profile)


def ingest_audio(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Each new audio object once, contents unread."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"))
    )
    return audio_uploads(files)


def analyze_stream(arrivals: DataFrame, profile: Profile) -> DataFrame:
    """Analysis of arriving transcripts: the batch plan is narrow, so it streams as is.

    A call without an id is keyed by its path.
    """
    keyed = arrivals if "call_id" in arrivals.columns else arrivals.withColumn("call_id", F.col("path"))
    return analyze_calls(keyed, profile)


def append_to(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append results exactly once; processes what is there and stops."""
    return (
        stream.writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def snapshots_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the whole aggregate of every batch to its own folder ``batch=<id>``.

    Repeating a batch after a failure overwrites the same folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
