"""Tables and the domain views built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens import schemas
from calllens.config import V31
from calllens.functions.scoring import lead_class
from calllens.functions.text import clamp


# Tables whose zone-less times are to be read as instants.
DECLARED = {"events": schemas.EVENTS}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table; an absolute ``file:``/object-store root works alike."""
    reader = spark.read.schema(DECLARED[name]) if name in DECLARED else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """A table of an existing database, read in ``parts`` ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high,
                 numPartitions=parts, **options)
        .load()
    )


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """One whole transcript per row: ``(call_id, path, file_name, size_bytes, uploader, lang, text)``."""
    docs = read_table(spark, root, "documents")
    return docs.select(
        F.col("doc_id").alias("call_id"),
        F.concat(F.lit("transcripts/"), "source", F.lit("/call-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit("call-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("n_chars").alias("size_bytes"),
        F.col("source").alias("uploader"),
        "lang",
        "text",
    )


def turns(spark: SparkSession, root: str) -> DataFrame:
    """Diarised calls: ``(call_id, turn, speaker, text)``; system turns are not speech."""
    conv = read_table(spark, root, "conversations")
    conv = conv.where(F.col("role") != "system")
    return conv.select(
        F.col("conv_id").alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "prospect").otherwise("sales_representative").alias("speaker"),
        "text",
    )


def analysis_results(spark: SparkSession, root: str) -> DataFrame:
    """Listed results: score, class, sentiment, duration and status of each call."""
    events = read_table(spark, root, "events")
    staged = events.select(
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("call-"), F.col("event_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.col("ts").alias("uploaded_at"),
        F.col("user_id"),
        F.col("event_type").alias("job_type"),
        F.get_json_object("props", "$.k").cast("double").alias("score"),
        clamp((F.col("value") - 50) / F.lit(50.0), -1.0, 1.0).alias("sentiment"),
        F.col("value").alias("duration"),
        (F.col("value") * 1000).cast("bigint").alias("size_bytes"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
    )
    # never null, so that joins and filters on the class do not parse the JSON again
    named = F.coalesce(lead_class(F.col("score"), V31), F.lit("Unknown"))
    return staged.withColumn("lead_class", named).withColumn("confidence", F.col("score") / 100)


def logs(spark: SparkSession, root: str) -> DataFrame:
    events = read_table(spark, root, "events")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("analysis_id"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("log_level"),
        F.col("event_type").alias("stage"),
        "ts",
    )


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Operational metrics: component = event type, environment by user id."""
    events = read_table(spark, root, "events")
    return events.select(
        F.col("event_id").alias("metric_id"),
        F.lit("processing_value").alias("metric_name"),
        F.col("event_type").alias("component"),
        F.when(F.col("user_id") < 75, "production").otherwise("staging").alias("environment"),
        "value",
        "ts",
        "user_id",
    )
