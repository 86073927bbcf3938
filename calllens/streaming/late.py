"""Rows that come too late: told apart, counted per batch, and kept.

Spark's stateful operators drop such rows, by the watermark of the batch before the last,
and report how many aggregated ones there were.
Here a stream is admitted first: rows that the watermark has passed go to a table of
their own, the others to the table that the operators read, so these never meet a late
row however their batches are cut.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = "rows bigint, late bigint, newest bigint, watermark bigint"


def _counts(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{COUNTS}, batch bigint").parquet(f"{out}/counts")
    except AnalysisException:  # nothing written yet
        return None


def delay_of(watermark: str) -> int:
    """Microseconds of an interval such as ``10 minutes``."""
    spark = SparkSession.active()
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {watermark}"))).first()[0]


def admit_batch(batch: DataFrame, batch_id: int, out: str, ts: str, delay: int, expires: Column) -> None:
    """Split one micro-batch; doing so twice writes the same folders."""
    spark = batch.sparkSession
    earlier = _counts(spark, out)
    newest = None if earlier is None else earlier.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
    # whole milliseconds, as the engine's own watermark
    watermark = None if newest is None else (newest - delay) // 1000 * 1000
    late = F.lit(False) if watermark is None else F.coalesce(F.unix_micros(expires) <= watermark, F.lit(False))
    rows = batch.withColumn("_late", late).persist()
    try:
        for folder, wanted in (("late", True), ("admitted", False)):
            rows.where(F.col("_late") == wanted).drop("_late").write.mode("overwrite").parquet(f"{out}/{folder}/batch={batch_id}")
        counted = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"),
            F.greatest(F.max(F.unix_micros(ts)), F.lit(newest).cast("bigint")).alias("newest"),
            F.lit(watermark).cast("bigint").alias("watermark"),
        )
        counted.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
    finally:
        rows.unpersist()


def admit(
    stream: DataFrame, out: str, checkpoint: str, ts: str = "ts", watermark: str = "10 minutes", expires: Column | None = None
) -> StreamingQuery:
    """Route a stream's rows to ``out/admitted`` and ``out/late``, with a row of counts per
    batch in ``out/counts``.

    A row is late if the watermark, which lies ``watermark`` behind the newest time of the
    batches before, has reached ``expires``: by default its time, for windows the end of
    the last window that holds it, for sessions its time and the gap.  Rows without a time
    are never late.  ``admitted`` can be streamed from, as it grows by whole files.
    """
    delay = delay_of(watermark)
    until = F.col(ts) if expires is None else expires

    def store(batch: DataFrame, batch_id: int) -> None:
        admit_batch(batch, batch_id, out, ts, delay, until)

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def window_end(ts: str, length: str, slide: str | None = None) -> Column:
    """The end of the last window of a time: when a windowed aggregate may close it."""
    step = delay_of(slide or length)
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / step) * step + delay_of(length)).cast("bigint"))


def late_counts(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, rows, late, watermark)`` of every batch."""
    found = _counts(spark, out)
    if found is None:
        found = spark.createDataFrame([], f"{COUNTS}, batch bigint")
    return found.select("batch", "rows", "late", F.timestamp_micros("watermark").alias("watermark"))


def progress_rows(query: StreamingQuery) -> list[tuple[int, str, str | None, int]]:
    """``(batch, operator, watermark, dropped)`` of a query's last reports: what its
    stateful operators dropped by themselves, in rows as they reach the operator."""
    out = []
    for report in query.recentProgress:
        told = report if isinstance(report, dict) else json.loads(report.json)
        for operator in told.get("stateOperators", []):
            out.append((
                told["batchId"], operator["operatorName"], told.get("eventTime", {}).get("watermark"),
                operator["numRowsDroppedByWatermark"],
            ))
    return out


def progress_to(query: StreamingQuery, out: str) -> None:
    """Store a query's drop counters, a row per batch and operator; batches that were
    stored before are written again as they are."""
    spark = SparkSession.active()
    rows = progress_rows(query)
    if rows:
        schema = "batch bigint, operator string, watermark string, dropped bigint"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(out)
