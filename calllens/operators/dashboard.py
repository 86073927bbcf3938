"""Aggregates behind the dashboard and the operational views.

Every one is a partial aggregate on a low-cardinality key: tasks send one row per
group, so a group with a third of all rows is no heavier than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.operators.ordered import percentiles, rank_by_value, running_totals


def lead_score_distribution(calls: DataFrame, lead_class: str = "lead_class") -> DataFrame:
    return calls.groupBy(lead_class).agg(F.count(F.lit(1)).alias("calls"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def sentiment_trend(calls: DataFrame, bucket: str = "day") -> DataFrame:
    return calls.groupBy(F.date_trunc(bucket, "uploaded_at").alias("bucket")).agg(
        F.avg("sentiment").alias("mean_sentiment"), F.count(F.lit(1)).alias("calls")
    )


def processing_performance(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Calls, mean duration of the successes, success rate."""
    ok = F.col("status") == "completed"
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.avg(F.when(ok, F.col("duration"))).alias("avg_processing_time"),
        F.avg(ok.cast("double")).alias("success_rate"),
    )


def processing_percentiles(
    jobs: DataFrame, by: str, points=(0.5, 0.95)
) -> DataFrame:
    """Exact percentiles of the successes' duration."""
    done = jobs.where(F.col("status") == "completed")
    return percentiles(done, by, "duration", list(points))


def processing_percentiles_approx(jobs: DataFrame, by: str, points=(0.5, 0.95)) -> DataFrame:
    done = jobs.where(F.col("status") == "completed")
    return done.groupBy(by).agg(
        *[F.percentile_approx("duration", p, 10_000).alias(f"p{round(p * 100)}") for p in points]
    )


def model_accuracy(predictions: DataFrame, task: str = "task") -> DataFrame:
    """Agreement of prediction and label per task."""
    return predictions.groupBy(task).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"),
    )


def metric_rollup(metrics: DataFrame, dimensions: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Mean, extremes and latest value at every roll-up level of the dimensions."""
    latest = F.max_by("value", F.struct(ts, tie) if tie else F.col(ts))
    return metrics.rollup(*dimensions).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("samples"),
        F.avg("value").alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        latest.alias("latest_value"),
    )


def log_summary(logs: DataFrame) -> DataFrame:
    return logs.cube("log_level", "stage").agg(
        F.grouping_id().cast("bigint").alias("grouping"), F.count(F.lit(1)).alias("entries")
    )


def errors_per_analysis(logs: DataFrame, key: str) -> DataFrame:
    return logs.groupBy(key).agg(
        F.count_if(F.col("log_level") == "ERROR").alias("errors"),
        F.count(F.lit(1)).alias("entries"),
    )


def running_performance(
    jobs: DataFrame, keys: list[str], order: list[Column], bucket: Column
) -> DataFrame:
    """After each job: files so far, running mean duration of the successes, running
    success rate.  Successes divide by successes, rates by all files."""
    ok = F.col("status") == "completed"
    totals = running_totals(
        jobs,
        keys,
        order,
        bucket,
        {
            "files_processed": F.lit(1).cast("bigint"),
            "_ok": ok.cast("bigint"),
            "_time": F.when(ok, F.col("duration")).otherwise(0.0),
        },
    )
    return totals.select(
        *jobs.columns,
        "files_processed",
        F.try_divide("_time", "_ok").alias("average_duration"),
        (F.col("_ok") / F.col("files_processed")).alias("success_rate"),
    )


def rank_leads(
    calls: DataFrame, key: str = "call_id", lead_class: str = "lead_class", score: str = "score",
    key_bucket: Column | None = None,
) -> DataFrame:
    """Rank, percent rank and quartile of each lead within its class.

    Quartiles are of equal size as ``ntile`` makes them, leads of equal score in the
    order of ``key``.  ``key_bucket``, by default for numbers, must not fall as the key
    rises; it deals leads of one score to many tasks.
    """
    bucket = F.floor(F.col(key) / 4096) if key_bucket is None else key_bucket
    tied = running_totals(
        calls.select(key, lead_class, score), [lead_class, score], [F.col(key)], bucket, {"_tie": F.lit(1).cast("bigint")}
    )
    ranked = rank_by_value(tied, lead_class, score)
    before = F.col("rank") - 1
    # the first n % 4 quartiles hold one lead more
    place, size, more = before + F.col("_tie") - 1, F.floor(F.col("group_size") / 4), F.col("group_size") % 4
    quartile = F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(
        more + F.floor(F.try_divide(place - more * (size + 1), size))
    )
    return ranked.select(
        key,
        lead_class,
        score,
        "rank",
        F.when(F.col("group_size") > 1, before / (F.col("group_size") - 1))
        .otherwise(0.0)
        .alias("percent_rank"),
        (quartile + 1).alias("quartile"),
    )
