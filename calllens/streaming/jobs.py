"""Stateful job tracking: jobs that stop reporting before they finish."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id string, status string, changed_at timestamp"
RAW = "job_id string, status string, micros long"  # an instant whatever the session's zone
STATE = "status string, micros long, tie long"
OPEN = ("pending", "processing", "reprocessing")


def _last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last change of each job among the rows a task holds at once."""
    for rows in batches:
        yield rows.sort_values(["micros", "tie"], kind="stable").drop_duplicates("job_id", keep="last")


def stuck_jobs(
    changes: DataFrame, after_seconds: int, watermark: str = "10 minutes", tie: str | None = None
) -> DataFrame:
    """Jobs whose last change is open and older than ``after_seconds`` of event time.

    Built-in aggregation has no timers, so the state is a grouped Pandas function:
    one small row per job, dropped when the job ends or is reported.  Tasks pass on the
    last change they hold of each job, so a job of very many changes sends a few.  Of
    changes at one instant the one with the largest ``tie`` is the last; without it, the
    one that comes last.  Changes that the watermark has passed are not looked at.
    """

    def track(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, micros, _ = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "micros": [micros]})
            return
        passed = state.getCurrentWatermarkMs()
        status, micros, last = state.get if state.exists else (None, -1, -1)
        seen = False
        for rows in batches:
            for s, t, order in zip(rows["status"], rows["micros"].tolist(), rows["tie"].tolist()):
                if t // 1000 > passed or passed <= 0:
                    seen = True
                    if (t, order) >= (micros, last):
                        status, micros, last = s, t, order
        if not seen:
            return
        if status not in OPEN:
            if state.exists:
                state.remove()
            return
        state.update((status, micros, last))
        due = micros // 1000 + after_seconds * 1000
        # a timer must lie after the watermark; one already due fires next batch
        state.setTimeoutTimestamp(max(due, passed + 1))

    keyed = changes.select(
        F.col("job_id").cast("string").alias("job_id"), "status", F.unix_micros("ts").alias("micros"),
        (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("tie"),
    )
    # the newest change of a batch is among those kept, so the watermark is that of all rows
    last = keyed.mapInPandas(_last_of_each, "job_id string, status string, micros bigint, tie bigint")
    reduced = last.withColumn("ts", F.timestamp_micros("micros")).withWatermark("ts", watermark)
    found = reduced.groupBy("job_id").applyInPandasWithState(
        track, RAW, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("job_id", "status", F.timestamp_micros("micros").alias("changed_at"))
