"""Jump consistent hashing against the published algorithm, and the numbering of slots."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from calllens.llm import sharding
from calllens.llm.queries import QUERIES
from pyspark.sql import functions as F


def jump_by_hand(key: int, shards: int) -> int:
    """The published algorithm on a 64-bit key."""
    key, at, to = key % (1 << 64), -1, 0
    while to < shards:
        at = to
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        to = math.floor((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


KEYS = [0, 1, -1, 42, 256, 0xDEAD10CC, 2**63 - 1, -(2**63), 2**32, 2**32 - 1]


def test_published_values():
    assert [jump_by_hand(k, n) for k, n in [(1, 1), (42, 57), (0xDEAD10CC, 666), (256, 1024)]] == [0, 43, 361, 520]


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 1000])
def test_walk_is_the_published_one(spark, shards):
    keys = KEYS + [random.Random(3).getrandbits(64) - 2**63 for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "key bigint").select("key", sharding.walk(F.col("key"), shards).alias("w"))
    for key, w in got.collect():
        assert w["shard"] == jump_by_hand(key, shards)
        assert (jump_by_hand(key, shards + 1) == shards) == (w["next"] == shards)


def test_long_walks_are_followed_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 2)
    got = spark.range(500).select("id", sharding.walk(F.col("id"), 300)["shard"].alias("s")).collect()
    assert all(r.s == jump_by_hand(r.id, 300) for r in got)


def test_odd_rows(odd, none):
    """Nulls, empty texts, repeated rows and clashing columns."""
    got = sharding.assign(odd, 24).collect()
    rows = odd.select("doc_id", "text").collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in rows
    )
    assert all(r.shard == jump_by_hand(r.id or 0, 24) for r in got)
    assert all(r.grown_shard == jump_by_hand(r.id or 0, 25) for r in got)
    gapless(got)
    assert sharding.assign(none, 24).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_of(odd, 0)


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("rows_per_bucket", [3, 500_000])
def test_slots_without_gaps_under_a_hot_row(spark, rows_per_bucket):
    """A third of the rows are one document repeated; another third has one id."""
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit(5)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 1000, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
    )
    got = sharding.assign(docs, 4, rows_per_bucket=rows_per_bucket).collect()
    assert len(got) == 3000
    gapless(got)


def test_pieces_of_many_copies(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("b", 10, 1), ("c", 11, 7)], "name string, start bigint, n bigint")
    got = sharding.exploded(rows, "start", "n", "slot", piece=4).orderBy("slot").collect()
    assert [(r.name, r.slot) for r in got] == [("a", i) for i in range(10)] + [("b", 10)] + [("c", i) for i in range(11, 18)]


def test_an_appended_shard_takes_only_into_itself(spark):
    got = spark.range(20_000).select(
        sharding.walk(F.col("id"), 24)["shard"].alias("a"), sharding.walk(F.col("id"), 25)["shard"].alias("b")
    ).collect()
    moved = [r for r in got if r.a != r.b]
    assert all(r.b == 24 for r in moved)
    assert abs(len(moved) / 20_000 - 1 / 25) < 0.01
    assert max(Counter(r.a for r in got).values()) < 1.2 * 20_000 / 24


def test_other_key_types(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    got = {r.id: r.shard for r in sharding.assign(docs, 1000).collect()}
    assert got[None] == jump_by_hand(0, 1000) and len(set(got.values())) == 3


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("id"), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count()
    assert all(r.shard == jump_by_hand(r.doc_id or 0, 5) for r in back.collect())


def test_no_python_worker_in_the_plan(spark, small):
    plan = QUERIES["op12_sharding"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
