"""The table of latest states, late rows, and totals kept live: replays, cuts and edges."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from calllens.operators import dashboard
from calllens.session import scratch_dir
from calllens.streaming import events as ev
from calllens.streaming import ingest, jobs, late, running, state

START = dt.datetime(2024, 1, 1)
CHANGES = "job_id string, change_id bigint, ts timestamp, status string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def rows_of(spark, out):
    return sorted(tuple(r) for r in state.read_latest(spark, out, "job_id", CHANGES).collect())


def merge(spark, out, batch_id, rows, buckets=4):
    state.merge_batch(spark.createDataFrame(rows, CHANGES), batch_id, out, "job_id", ["ts", "change_id"], buckets)


def test_latest_state_over_batches(spark):
    out = scratch_dir(spark, "latest")
    assert rows_of(spark, out) == []
    merge(spark, out, 0, [("a", 1, at(0), "pending"), ("a", 2, at(0), "processing"), ("b", 3, at(5), "pending")])
    assert rows_of(spark, out) == [("a", 2, at(0), "processing", 2), ("b", 3, at(5), "pending", 1)]
    second = [("a", 4, at(9), "completed"), ("a", 5, at(-3), "late"), ("c", 6, None, "odd"), (None, 7, at(1), "nobody")]
    merge(spark, out, 1, second)
    once = state.read_latest(spark, out, "job_id", CHANGES)
    want = {("a", 4, at(9), "completed", 4), ("b", 3, at(5), "pending", 1), ("c", 6, None, "odd", 1), (None, 7, at(1), "nobody", 1)}
    assert {tuple(r) for r in once.collect()} == want
    merge(spark, out, 1, second)  # the batch again, as after a failure
    assert {tuple(r) for r in state.read_latest(spark, out, "job_id", CHANGES).collect()} == want
    merge(spark, out, 2, [("b", 2, at(5), "older by id")])
    assert ("b", 3, at(5), "pending", 2) in {tuple(r) for r in state.read_latest(spark, out, "job_id", CHANGES).collect()}


def test_random_changes_in_any_cut(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abcdefgh"), i, at(draw.randrange(20)), f"s{i}") for i in range(120)]
    want = {}
    for job, i, ts, status in rows:
        n = want.get(job, (None, None, None, 0))[3] + 1
        best = max([want[job][:3]] if job in want else [], default=None)
        newest = (ts, i, status) if best is None or (ts, i) > best[:2] else best
        want[job] = (*newest, n)
    for cuts in ([120], [1, 60, 59], [40, 40, 40]):
        out, start = scratch_dir(spark, "latest"), 0
        for batch_id, n in enumerate(cuts):
            merge(spark, out, batch_id, rows[start : start + n])
            start += n
        got = {r.job_id: (r.ts, r.change_id, r.status, r.changes) for r in state.read_latest(spark, out, "job_id", CHANGES).collect()}
        assert got == want


def test_the_table_does_not_grow_with_the_batches(spark):
    out = scratch_dir(spark, "latest")
    sizes = []
    for batch_id in range(6):
        merge(spark, out, batch_id, [(j, batch_id, at(batch_id), "processing") for j in "abcd"])
        sizes.append(len(list(Path(out).rglob("part-*.parquet"))))
    assert sizes[1] == sizes[-1] and rows_of(spark, out)[0] == ("a", 5, at(5), "processing", 6)


def test_a_stream_keeps_the_table(spark):
    root, out = scratch_dir(spark, "changes"), scratch_dir(spark, "latest")

    def step(rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(root)
        query = state.keep_latest(spark.readStream.schema(CHANGES).parquet(root), out, f"{out}-state", "job_id", ["ts", "change_id"])
        query.awaitTermination()
        assert query.exception() is None
        return {r.job_id: (r.status, r.changes) for r in state.read_latest(spark, out, "job_id", CHANGES).collect()}

    assert step([("a", 1, at(0), "pending")]) == {"a": ("pending", 1)}
    assert step([("a", 2, at(1), "completed"), ("b", 3, at(1), "pending")]) == {"a": ("completed", 2), "b": ("pending", 1)}
    # nothing new: the table stays
    assert step([]) == {"a": ("completed", 2), "b": ("pending", 1)}


def test_stuck_jobs_break_ties_by_change(spark):
    root, out = scratch_dir(spark, "job-changes"), scratch_dir(spark, "stuck")

    def step(rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(root)
        query = ingest.append_to(jobs.stuck_jobs(spark.readStream.schema(CHANGES).parquet(root), 600, tie="change_id"), out, f"{out}-state")
        query.awaitTermination()
        assert query.exception() is None

    step([("done", 2, at(0), "completed"), ("done", 1, at(0), "pending"), ("open", 1, at(0), "completed"), ("open", 2, at(0), "pending")])
    step([("open", 0, at(0), "completed"), ("late", 5, at(4000), "pending")])
    step([("other", 9, at(9000), "completed")])
    got = sorted((r.job_id, r.status) for r in spark.read.schema(jobs.OUT).parquet(out).collect())
    assert got == [("late", "pending"), ("open", "pending")]


EVENTS = "user_id bigint, ts timestamp"


def admit(spark, root, out, rows, **options):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(root)
    query = late.admit(spark.readStream.schema(EVENTS).parquet(root), out, f"{out}-state", **options)
    query.awaitTermination()
    assert query.exception() is None
    return [tuple(r)[:3] for r in late.late_counts(spark, out).orderBy("batch").collect()]


def test_late_rows_are_counted_and_kept(spark):
    root, out = scratch_dir(spark, "events"), scratch_dir(spark, "admitted")
    assert late.late_counts(spark, out).collect() == []
    assert admit(spark, root, out, [(1, at(0)), (2, at(3600)), (3, None)]) == [(0, 3, 0)]
    # the watermark stands at 3000 s: the row of that second is late, the next is not
    assert admit(spark, root, out, [(4, at(3000)), (5, at(3001)), (6, at(10)), (7, None)]) == [(0, 3, 0), (1, 4, 2)]
    # an old batch does not move the watermark back
    assert admit(spark, root, out, [(8, at(2999))])[-1] == (2, 1, 1)
    assert sorted(r.user_id for r in spark.read.parquet(f"{out}/late").collect()) == [4, 6, 8]
    assert sorted(r.user_id for r in spark.read.parquet(f"{out}/admitted").collect()) == [1, 2, 3, 5, 7]


def test_a_repeated_batch_splits_alike(spark):
    out = scratch_dir(spark, "admitted")
    first, second = (spark.createDataFrame(r, EVENTS) for r in ([(1, at(3600))], [(2, at(0)), (3, at(3700))]))
    for _ in range(2):
        late.admit_batch(first, 0, out, "ts", 600 * 10**6, F.col("ts"))
        late.admit_batch(second, 1, out, "ts", 600 * 10**6, F.col("ts"))
        assert [tuple(r)[:3] for r in late.late_counts(spark, out).orderBy("batch").collect()] == [(0, 1, 0), (1, 2, 1)]


def test_windows_take_rows_until_they_close(spark):
    """A row is late for a window that is closed; Spark's own aggregate, whose watermark is
    a batch behind, drops the same rows when they come another batch later."""
    root, out = scratch_dir(spark, "events"), scratch_dir(spark, "admitted")
    ends = late.window_end("ts", "1 hour")
    admit(spark, root, out, [(1, at(0)), (1, at(7200))], expires=ends)
    admit(spark, root, out, [(1, at(7200))], expires=ends)
    # watermark 6600 s: the window from 3600 to 7200 is open, the one before is closed
    assert admit(spark, root, out, [(2, at(3600)), (3, at(3599)), (4, at(10))], expires=ends)[-1] == (2, 3, 2)

    # the engine by itself, on the same files
    frame = ev.metrics_tumbling(
        spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(root).select("ts", F.col("user_id").cast("string").alias("component"), F.lit(1.0).alias("value")),
        "1 hour",
    )
    query = ingest.append_to(frame, f"{out}-plain", f"{out}-plain-state")
    query.awaitTermination()
    assert sum(dropped for _, _, _, dropped in late.progress_rows(query)) == 2
    late.progress_to(query, f"{out}-progress")
    assert spark.read.parquet(f"{out}-progress").agg(F.sum("dropped")).first()[0] == 2


JOBS = "id bigint, component string, ts timestamp, duration double, status string"


@pytest.mark.parametrize("cuts", [[90], [1, 89], [30, 30, 30], [89, 1]])
def test_live_totals_equal_the_batch_for_any_cut(spark, cuts):
    draw = random.Random(2)
    rows = [
        (i, draw.choice(["a", "a", None]), at(i // 2), draw.choice([None, 1.5, 2.25, 8.0]), draw.choice(["completed", "failed", None]))
        for i in range(90)
    ]
    out, start = scratch_dir(spark, "live"), 0
    for batch_id, n in enumerate(cuts):
        part = spark.createDataFrame(rows[start : start + n], JOBS)
        for _ in range(2):  # every batch is repeated
            running.add_batch(part, batch_id, out, "component", [F.col("ts"), F.col("id")], F.date_trunc("minute", "ts"))
        start += n
    whole = dashboard.running_performance(spark.createDataFrame(rows, JOBS), ["component"], [F.col("ts"), F.col("id")], F.date_trunc("minute", "ts"))

    def told(df):
        return {r.id: (r.component, r.files_processed, pytest.approx(r.average_duration), pytest.approx(r.success_rate)) for r in df.collect()}

    got = told(running.read_live(spark, out))
    assert len(got) == 90 and got == told(whole)
