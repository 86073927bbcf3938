"""Running totals kept live: a row after each job of a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calllens.operators.ordered import running_totals

#: What is kept of each key from one batch to the next.
TOTALS = ("files_processed", "_ok", "_time")


def _totals_before(spark: SparkSession, out: str, batch_id: int, schema) -> DataFrame:
    """The totals of the newest batch older than this one; they lie in two places in turn."""
    found = None
    for place in (0, 1):
        try:
            held = spark.read.schema(schema).parquet(f"{out}/totals-{place}").where(F.col("batch") < batch_id)
        except AnalysisException:  # not written yet
            continue
        found = held if found is None else found.unionByName(held)
    if found is None:
        return spark.createDataFrame([], schema)
    newest = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == F.lit(newest))


def add_batch(batch: DataFrame, batch_id: int, out: str, key: str, order: list[Column], bucket: Column) -> None:
    """Append the rows of one micro-batch; doing so twice writes the same rows."""
    spark = batch.sparkSession
    ok = F.col("status") == "completed"
    inside = running_totals(
        batch, [key], order, bucket,
        {"files_processed": F.lit(1).cast("bigint"), "_ok": ok.cast("bigint"), "_time": F.when(ok, F.col("duration")).otherwise(0.0)},
    )
    schema = f"`{key}` {batch.schema[key].dataType.simpleString()}, files_processed bigint, _ok bigint, _time double, batch bigint"
    before = _totals_before(spark, out, batch_id, schema).drop("batch")
    held = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_before_{c}") for c in TOTALS])
    added = inside.join(held, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        *batch.columns, *[(F.col(c) + F.coalesce(f"_before_{c}", F.lit(0))).alias(c) for c in TOTALS]
    )
    rows = added.select(
        *batch.columns, "files_processed", F.try_divide("_time", "_ok").alias("average_duration"),
        (F.col("_ok") / F.col("files_processed")).alias("success_rate"),
    )
    rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
    own = batch.groupBy(key).agg(
        F.count(F.lit(1)).alias("files_processed"), F.count_if(ok).alias("_ok"),
        F.coalesce(F.sum(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("_time"),
    )
    sums = before.unionByName(own).groupBy(key).agg(*[F.sum(c).alias(c) for c in TOTALS])
    sums.withColumn("batch", F.lit(batch_id).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(
        f"{out}/totals-{batch_id % 2}"
    )


def live_performance(
    jobs: DataFrame, out: str, checkpoint: str, key: str, order: list[str], bucket: Column
) -> StreamingQuery:
    """After each job of a stream: files so far of its key, the running mean duration of
    the successes, and the running success rate; rows in ``out/rows``.

    One accumulator per key goes from batch to batch, under the number of the batch, so a
    repeated batch adds nothing twice.  Within a batch the rows of a key are dealt to many
    tasks by ``bucket``, which must not fall along ``order``.  Cut anywhere, the batches
    give the rows of the whole table, if later batches hold later jobs.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, out, key, [F.col(c) for c in order], bucket)

    return (
        jobs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_live(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows").drop("batch")
