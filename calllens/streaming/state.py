"""The latest state per key as a table that a stream keeps up to date.

The table lies in a fixed number of buckets by hash of the key, each in one of two slots.
A micro-batch is reduced to one row per key, merged with the buckets it touches, and
written to their other slots; a list of the current slots, itself in two places, is
written last.  Repeating a batch after a failure reads the list of the batch before and
writes the same slots again.  So a batch costs what it touches, and the table never holds
more than two copies of a bucket however many batches went into it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SLOTS = "batch bigint, bucket int, slot int"


def reduced(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``(key, last, changes)``: the last row of each key by ``order`` and how many there
    were; tasks reduce theirs before the shuffle, so a hot key costs no more than others."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("changes")
    )


def merged(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Reduced rows of several origins, again one per key."""
    by = F.struct(*[F.col(f"last.{c}") for c in order])
    return parts.groupBy(key).agg(F.max_by("last", by).alias("last"), F.sum("changes").alias("changes"))


def slots(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """``(bucket, slot)`` of the newest list, or of the newest one older than a batch."""
    held = []
    for place in (0, 1):
        try:
            held.append(spark.read.schema(SLOTS).json(f"{out}/slots-{place}"))
        except AnalysisException:  # not written yet
            continue
    if not held:
        return None
    lists = held[0] if len(held) == 1 else held[0].unionByName(held[1])
    if before is not None:
        lists = lists.where(F.col("batch") < before)
    newest = lists.agg(F.max("batch")).first()[0]
    return None if newest is None else lists.where(F.col("batch") == newest).drop("batch")


def rows_in(spark: SparkSession, out: str, current: DataFrame, schema) -> DataFrame:
    """The rows of some buckets; there are at most as many paths as buckets."""
    paths = [f"{out}/data/bucket={r.bucket}/slot={r.slot}" for r in current.collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def merge_batch(batch: DataFrame, batch_id: int, out: str, key: str, order: list[str], buckets: int) -> None:
    """Merge one micro-batch into the table; doing so twice changes nothing."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = reduced(batch, key, order).persist()
    try:
        known = slots(spark, out, batch_id)
        touched = [r.bucket for r in fresh.select(bucket.alias("bucket")).distinct().collect()]
        held = {} if known is None else {r.bucket: r.slot for r in known.collect()}
        if known is not None:
            old = rows_in(spark, out, known.where(F.col("bucket").isin(touched)), fresh.schema)
            rows = merged(fresh.unionByName(old), key, order)
        else:
            rows = fresh
        turned = {b: 1 - held.get(b, 1) for b in touched}
        if touched:
            slot = F.element_at(F.create_map(*[F.lit(x) for pair in turned.items() for x in pair]), F.col("bucket"))
            placed = rows.withColumn("bucket", bucket).withColumn("slot", slot)
            placed.repartition("bucket").write.partitionBy("bucket", "slot").mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).parquet(f"{out}/data")
        listed = [(batch_id, b, s) for b, s in sorted((held | turned).items())]
        spark.createDataFrame(listed, SLOTS).coalesce(1).write.mode("overwrite").json(f"{out}/slots-{batch_id % 2}")
    finally:
        fresh.unpersist()


def keep_latest(
    changes: DataFrame, out: str, checkpoint: str, key: str, order: list[str], buckets: int = 64
) -> StreamingQuery:
    """Keep the table at ``out`` up to date with a stream of rows; ``order`` names the
    columns by which one row of a key is later than another."""

    def store(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, out, key, order, buckets)

    return (
        changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, out: str, key: str, schema) -> DataFrame:
    """The table: the columns of each key's last row (those of ``schema``), and
    ``changes``."""
    fields = {f.name: f"`{f.name}` {{}}{f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema}
    last = ", ".join(text.format(": ") for name, text in fields.items() if name != key)
    stored = f"{fields[key].format('')}, last struct<{last}>, changes bigint"
    current = slots(spark, out)
    if current is None:
        return spark.createDataFrame([], stored).select(key, "last.*", "changes")
    return rows_in(spark, out, current, stored).select(key, "last.*", "changes")
