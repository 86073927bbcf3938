"""Time-based operators on event tables and streams.

The window operators accept batch and streaming frames alike (a watermark has no
effect on a batch frame).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

WATERMARK = "10 minutes"


def metrics_tumbling(metrics: DataFrame, every: str = "30 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Operational metrics per component and fixed interval."""
    return (
        metrics.withWatermark("ts", watermark)
        .groupBy(F.window("ts", every), "component")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg("value").alias("mean_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
        .select(F.col("window.start").alias("window_start"), "component", "samples",
                "mean_value", "min_value", "max_value")
    )


def rate_limit_breaches(
    events: DataFrame, limit: int = 60, length: str = "1 minute", slide: str = "10 seconds",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Users with more than ``limit`` events in a sliding window."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", length, slide), "user_id")
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select(F.col("window.start").alias("window_start"), "user_id", "requests")
    )


def user_sessions(
    events: DataFrame, gap_seconds: int = 1800, user: str = "user_id", ts: str = "ts"
) -> DataFrame:
    """Activity sessions of a batch: a pause longer than the gap starts a new one.

    Two passes keep a very active user from filling one task: tasks reduce events to
    one piece per (user, time bucket) before the shuffle, then the pieces of a user
    merge.  A bucket is shorter than the gap, so no pause can lie inside one.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros(ts)
    # a quarter of the gap: fine enough to deal a busy user to many tasks
    bucket = F.floor(micros / F.lit(gap // 4))
    pieces = (
        events.select(user, micros.alias("_t"), bucket.alias("_b"))
        .groupBy(user, "_b")
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    along = W.partitionBy(user).orderBy("_lo")
    parted = (F.col("_lo") - F.lag("_hi").over(along) > gap).cast("int")
    sessions = (
        pieces.withColumn("_new", F.coalesce(parted, F.lit(0)))
        .withColumn("_s", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(user, "_s")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("events"))
    )
    return sessions.select(
        user,
        F.timestamp_micros("_lo").alias("session_start"),
        F.timestamp_micros("_hi").alias("last_accessed_at"),
        F.timestamp_micros(F.col("_hi") + gap).alias("expires_at"),
        "events",
    )


def user_sessions_stream(
    events: DataFrame, gap_seconds: int = 1800, watermark: str = WATERMARK
) -> DataFrame:
    """The streaming form, with sessions that merge as late rows arrive."""
    window = F.session_window("ts", f"{gap_seconds} seconds")
    return (
        events.withWatermark("ts", watermark)
        .groupBy("user_id", window)
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_accessed_at"))
        .select(
            "user_id",
            F.col("session_window.start").alias("session_start"),
            "last_accessed_at",
            F.col("session_window.end").alias("expires_at"),
            "events",
        )
    )


def dedupe_requests(requests: DataFrame, ttl_seconds: int = 300, text: str = "text", ts: str = "ts") -> DataFrame:
    """Requests that no cached answer serves, with ``text_md5`` in place of the text.

    An answer is cached when its request is let through and lives ``ttl_seconds``; a
    request of the same text within that time is dropped, the next one is let through
    and cached anew.  State is one time per text, kept for its lifetime.  The result does
    not depend on how rows fall into batches as long as they come in order of time; a
    row older than the last cached answer of its text is dropped.
    """
    ttl = ttl_seconds * 1_000_000
    keyed = requests.withWatermark(ts, f"{ttl_seconds} seconds").select(
        *[c for c in requests.columns if c != text], F.md5(text).alias("text_md5"), F.unix_micros(ts).alias("_t")
    )
    schema = StructType([f for f in keyed.schema if f.name != "_t"])

    def through(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("_t", kind="stable")
        free_at = state.get[0] if state.exists else None
        kept = []
        for t in rows["_t"].tolist():
            kept.append(free_at is None or t >= free_at)
            if kept[-1]:
                free_at = t + ttl
        state.update((free_at,))
        state.setTimeoutTimestamp(max(free_at // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, schema.names]

    return keyed.groupBy("text_md5").applyInPandasWithState(
        through, schema, "free_at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def running_performance_stream(jobs: DataFrame) -> DataFrame:
    """Totals per component kept live (``update`` or ``complete`` mode)."""
    ok = F.col("status") == "completed"
    return jobs.groupBy("component").agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.avg(F.when(ok, F.col("duration"))).alias("average_duration"),
        F.avg(ok.cast("double")).alias("success_rate"),
    )


def _latest(columns: list[str], order: list[Column]) -> Column:
    return F.max_by(F.struct(*columns), F.struct(*order))


def job_states(changes: DataFrame, key: str = "job_id", ts: str = "ts", tie: str = "change_id") -> DataFrame:
    """Latest state of each job with the number of changes; batch or stream."""
    return (
        changes.groupBy(key)
        .agg(
            _latest(["status", "progress", ts], [F.col(ts), F.col(tie)]).alias("_s"),
            F.count(F.lit(1)).alias("changes"),
        )
        .select(key, "_s.status", "_s.progress", F.col(f"_s.{ts}").alias("changed_at"), "changes")
    )
