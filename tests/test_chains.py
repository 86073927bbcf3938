"""Chains of cached answers against a walk along each text, and against the stream."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from calllens.session import scratch_dir
from calllens.streaming import chains, ingest
from calllens.streaming import events as ev

START = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, text string, ts timestamp"


def walked(rows, ttl):
    """The walk, one text after the other; ``rows`` of (id, text, seconds)."""
    by_text = defaultdict(list)
    for i, text, s in rows:
        if s is not None:
            by_text[text].append((s, i))
    kept = set()
    for times in by_text.values():
        free = None
        for s, i in sorted(times):
            if free is None or s >= free:
                kept.add(i)
                free = s + ttl
    return kept


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if s is None else START + dt.timedelta(seconds=s)) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("seed, ttl", [(0, 1), (1, 7), (2, 7), (3, 300)])
def test_equal_to_the_walk(spark, seed, ttl):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "a", "a", "b", None, f"t{i % 9}"]), draw.randrange(1500)) for i in range(250)]
    got = Counter(r.id for r in chains.dedupe_requests_batch(table(spark, rows), ttl, tie="id").collect())
    assert set(got) == walked(rows, ttl) and set(got.values()) == {1}


def test_edges(spark):
    rows = [(1, "a", 0), (2, "a", 0), (3, "a", 299), (4, "a", 300), (5, "a", 600), (6, "a", 10**7), (7, "b", None), (8, "", 5), (9, None, 5)]
    got = chains.dedupe_requests_batch(table(spark, rows), 300, tie="id").collect()
    assert {r.id for r in got} == {1, 4, 5, 6, 8, 9}
    assert got[0].__fields__ == ["id", "ts", "text_md5"]
    assert {r.text_md5 is None for r in got if r.id == 9} == {True}
    assert chains.dedupe_requests_batch(table(spark, []), 300).collect() == []
    # without a tie one row of an instant goes through all the same
    assert chains.dedupe_requests_batch(table(spark, rows), 300).count() == 6


def test_equal_to_the_stream(spark):
    draw = random.Random(8)
    rows = sorted(((i, draw.choice("abc"), draw.randrange(3000)) for i in range(120)), key=lambda r: r[2])
    rows = [(n, t, s) for n, (_, t, s) in enumerate(rows)]
    root, out = scratch_dir(spark, "requests"), scratch_dir(spark, "kept")
    table(spark, rows).coalesce(1).write.parquet(root)
    query = ingest.append_to(ev.dedupe_requests(spark.readStream.schema(SCHEMA).parquet(root)), out, f"{out}-state")
    query.awaitTermination()
    streamed = Counter((r.text_md5, r.ts) for r in spark.read.parquet(out).collect())
    batch = Counter((r.text_md5, r.ts) for r in chains.dedupe_requests_batch(table(spark, rows)).collect())
    assert batch == streamed


def test_a_hot_text_is_spread(spark):
    """A third of the rows are one text; no bucket of it holds many, and a long chain takes few joins."""
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"),
    )
    times = rows.where("text = 'hot'").select(F.lit("k").alias("key"), F.unix_micros("ts").alias("t"))
    plan = plan_of(chains.successors(times, 300 * 10**6))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = chains.dedupe_requests_batch(rows, 3).where("id % 3 = 0")
    assert got.count() == 10_000  # every one is expired when the next comes
