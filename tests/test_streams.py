"""Streaming results against their batch form, and state over several batches."""

import datetime as dt
import hashlib
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from calllens import V31, schemas
from calllens.session import scratch_dir
from calllens.sources import tables
from calllens.streaming import events as ev
from calllens.streaming import ingest, jobs
from catalog.registry import QUERIES
from catalog.streams import changes

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def split_events(spark, small):
    """The event table as four files in time order."""
    root = scratch_dir(spark, "split-events")
    events = tables.read_table(spark, small, "events").where("event_id < 400")
    for part in range(4):
        events.where(f"event_id between {part * 100} and {part * 100 + 99}").coalesce(1).write.mode("append").parquet(root)
    return root, events


def stream_of(spark, root):
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(root)


def final_rows(spark, frame):
    """Rows of an aggregate once all input is read."""
    out = scratch_dir(spark, "final")
    query = ingest.snapshots_to(frame, out, f"{out}-state")
    query.awaitTermination()
    stored = spark.read.parquet(out)
    return stored.where(F.col("batch") == stored.agg(F.max("batch")).first()[0]).drop("batch")


@pytest.mark.parametrize("form", [
    lambda e: ev.metrics_tumbling(e.withColumnRenamed("event_type", "component"), "1 hour"),
    lambda e: ev.rate_limit_breaches(e, 2, "6 hours", "1 hour"),
    lambda e: ev.job_states(changes(e)),
    lambda e: ev.user_sessions_stream(e, 7200),
], ids=["tumbling", "breaches", "jobs", "sessions"])
def test_stream_equals_batch(spark, split_events, form):
    root, events = split_events
    streamed, batch = final_rows(spark, form(stream_of(spark, root))), form(events)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch.select(*streamed.columns)).isEmpty()


def write_batch(spark, root, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)


def run(frame, out):
    query = ingest.append_to(frame, out, f"{out}-state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_repeats_within_the_lifetime_are_dropped(spark):
    root, out = scratch_dir(spark, "requests"), scratch_dir(spark, "kept")
    schema = "text string, ts timestamp"

    def step(rows):
        write_batch(spark, root, rows, schema)
        run(ev.dedupe_requests(spark.readStream.schema(schema).parquet(root)), out)
        names = {hashlib.md5(t.encode()).hexdigest(): t for t in "abc"}
        return sorted((names[r.text_md5], (r.ts - START).seconds) for r in spark.read.parquet(out).collect())

    assert step([("a", at(0)), ("b", at(0))]) == [("a", 0), ("b", 0)]
    # 299 s later: still known
    assert step([("a", at(299))]) == [("a", 0), ("b", 0)]
    # far beyond the lifetime: the state is gone once the watermark has passed
    step([("c", at(2000))])
    assert ("b", 2400) in step([("b", at(2400))])


def test_lifetimes_do_not_depend_on_batches(spark):
    schema = "text string, ts timestamp"
    times = [0, 10, 299, 300, 301, 599, 600, 1000, 1100, 1299, 1300, 9000]
    for cuts in ([12], [1, 5, 6]):
        root, out = scratch_dir(spark, "requests"), scratch_dir(spark, "kept")
        at_row = 0
        for n in cuts:
            write_batch(spark, root, [("a", at(t)) for t in times[at_row : at_row + n]][::-1], schema)
            at_row += n
            run(ev.dedupe_requests(spark.readStream.schema(schema).parquet(root)), out)
        # an answer cached at 0 lives until 300, the one cached then until 600, and so on
        kept = sorted(int((r.ts - START).total_seconds()) for r in spark.read.parquet(out).collect())
        assert kept == [0, 300, 600, 1000, 1300, 9000]


def test_late_rows_are_dropped(spark):
    root = scratch_dir(spark, "late")
    schema = "user_id bigint, ts timestamp"
    out = scratch_dir(spark, "late-out")

    def step(rows):
        write_batch(spark, root, rows, schema)
        frame = ev.rate_limit_breaches(spark.readStream.schema(schema).parquet(root), 1, "1 minute", "1 minute")
        run(frame, out)

    step([(1, at(10)), (1, at(20)), (2, at(3600))])
    step([(3, at(5)), (3, at(6)), (2, at(7200))])  # user 3 is an hour late
    step([(2, at(10000))])
    assert [r.user_id for r in spark.read.parquet(out).collect()] == [1]


def test_breach_needs_more_than_the_limit(spark):
    rows = [(1, at(i * 0.9)) for i in range(61)] + [(2, at(i * 0.9)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp")
    got = ev.rate_limit_breaches(df).collect()
    assert {r.user_id for r in got} == {1} and max(r.requests for r in got) == 61


def test_gap_edges(spark):
    rows = [(1, at(0)), (1, at(1800)), (1, at(3601))]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp")
    for form in (ev.user_sessions, ev.user_sessions_stream):
        assert sorted(r.events for r in form(df, 1800).collect()) == [1, 2]


def test_stuck_jobs(spark):
    root, out = scratch_dir(spark, "job-changes"), scratch_dir(spark, "stuck")
    schema = "job_id string, status string, ts timestamp"

    def step(rows):
        write_batch(spark, root, rows, schema)
        run(jobs.stuck_jobs(spark.readStream.schema(schema).parquet(root), 600), out)

    step([("done", "pending", at(0)), ("stuck", "pending", at(0)), ("slow", "pending", at(0))])
    step([("done", "completed", at(60)), ("stuck", "processing", at(30)), ("slow", "processing", at(5000))])
    step([("other", "completed", at(6000))])
    got = [(r.job_id, r.status) for r in spark.read.schema(jobs.OUT).parquet(out).collect()]
    assert got == [("stuck", "processing")]


def test_files_are_ingested_once(spark, tmp_path):
    source, out = tmp_path / "in", scratch_dir(spark, "ingested")
    source.mkdir()
    (source / "a.txt").write_text("Wow.\nYes?")

    def step():
        arrivals = ingest.ingest_transcripts(spark, str(source), V31)
        run(ingest.analyze_stream(arrivals, V31), out)
        return sorted(r.file_name for r in spark.read.parquet(out).collect())

    assert step() == ["a.txt"]
    (source / "b.json").write_text('{"transcript":"pricing"}')
    assert step() == ["a.txt", "b.json"]


def test_audio_stream(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    out = scratch_dir(spark, "audio")
    run(ingest.ingest_audio(spark, str(tmp_path)), out)
    assert [r.media_format for r in spark.read.parquet(out).collect()] == ["mp3"]


def test_a_table_is_a_file_or_a_folder_of_files(spark):
    root = scratch_dir(spark, "table-kinds")
    documents = spark.createDataFrame([(i, f"call {i} that", "web") for i in range(6)], "doc_id bigint, text string, source string")
    documents.repartition(3).write.parquet(f"{root}/documents.parquet")
    got = QUERIES["analyze_stream"](spark, root).collect()
    assert sorted((r.call_id, r.word_count) for r in got) == [(i, 3) for i in range(6)]
    documents.coalesce(1).write.parquet(f"{root}-parts")
    part = next(Path(f"{root}-parts").glob("part-*.parquet"))
    Path(f"{root}-single").mkdir()
    shutil.copy(part, f"{root}-single/documents.parquet")
    got = QUERIES["analyze_stream"](spark, f"{root}-single").collect()
    assert sorted(r.call_id for r in got) == list(range(6))
