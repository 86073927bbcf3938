"""The stored search index against a scan of the corpus."""

import random

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from calllens.operators import index, topics
from calllens.session import scratch_dir
from calllens.sources import tables

WORDS = ["price", "pricing", "trial", "start", "the", "budget", "call", "follow", "up", "now"]


def corpus(n, seed=1):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS, weights=[1, 2, 3, 4, 30, 3, 9, 5, 5, 8], k=draw.randint(0, 60)))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "call_id bigint, text string")


@pytest.fixture(scope="module")
def held(spark):
    """Calls and their index in three arrivals."""
    folder = scratch_dir(spark, "index")
    rows = corpus(400) + [(1000, None), (1001, ""), (1002, "The PRICE, the price!")]
    calls = table(spark, rows)
    index.add_segment(calls.where("call_id < 100"), folder, 0, block_calls=16)
    index.add_segment(calls.where("call_id < 300"), folder, 1, block_calls=16)
    index.add_segment(calls.where("call_id >= 300"), folder, 2, block_calls=16)
    return folder, calls, rows


@pytest.mark.parametrize("query, k, first_blocks", [
    ("price", 5, 1), ("Price trial", 10, 1), ("Price trial", 10, 64), ("follow-up budget", 3, 1), ("the call", 1000, 64),
    ("nothing", 5, 1), ("price price", 4, 64),
])
def test_equal_to_the_scan(spark, held, query, k, first_blocks):
    folder, calls, _ = held
    got = index.search(spark, folder, query, k, ("a",), first_blocks=first_blocks).collect()
    want = topics.fulltext_search(calls, query, k, ("a",)).collect()
    assert [r.call_id for r in got] == [r.call_id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want])


def test_a_query_needs_a_term(spark, held):
    with pytest.raises(ValueError):
        index.search(spark, held[0], " the ", 5, ("the",))


def test_the_corpus_is_not_scanned_and_partitions_are_pruned(spark, held):
    plan = plan_of(index.search(spark, held[0], "price trial", 5, ()))
    assert "postings" in plan and "Scan ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert "PartitionFilters: [" in plan and "bucket" in plan and "PushedFilters: [" in plan and "In(term" in plan


def test_blocks_are_skipped(spark, monkeypatch):
    """One block holds the calls with the most places: the others are not scored."""
    folder = scratch_dir(spark, "index")
    rows = [(i, "price " * (50 if i == 7 else 1)) for i in range(300)]
    index.add_segment(table(spark, rows), folder, 0, block_calls=16)
    asked = []
    real = index._in_blocks
    monkeypatch.setattr(index, "_in_blocks", lambda p, chosen: asked.append(chosen.count()) or real(p, chosen))
    got = index.search(spark, folder, "price", 1, (), first_blocks=1).collect()
    assert [r.call_id for r in got] == [7] and asked == [1, 1]


def test_many_blocks_are_joined(spark, held, monkeypatch):
    monkeypatch.setattr(index, "NAMED", 2)
    folder, calls, _ = held
    got = index.search(spark, folder, "price trial", 10, ()).collect()
    assert [r.call_id for r in got] == [r.call_id for r in topics.fulltext_search(calls, "price trial", 10, ()).collect()]


def test_a_segment_again_changes_nothing(spark, held):
    folder, calls, rows = held
    before = index.search(spark, folder, "price", 50, ()).collect()
    index.add_segment(calls.where("call_id < 300"), folder, 1, block_calls=16)
    assert index.search(spark, folder, "price", 50, ()).collect() == before
    assert spark.read.parquet(f"{folder}/docs").count() == len(rows)


@pytest.mark.parametrize("phrase", ["follow up", "the the call", "price", "up now the", "now nothing"])
def test_phrases(spark, held, phrase):
    folder, _, rows = held
    words = phrase.split()
    want = {}
    for key, text in rows:
        toks = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        places = [i for i in range(len(toks)) if toks[i : i + len(words)] == words]
        if places:
            want[key] = places
    assert {r.call_id: r.places for r in index.phrase_search(spark, folder, phrase).collect()} == want


def test_a_stream_is_indexed(spark):
    root, folder = scratch_dir(spark, "arrivals"), scratch_dir(spark, "index")
    schema = "call_id bigint, text string"
    for rows in ([(1, "price now"), (2, "trial")], [(1, "price now"), (3, "price price")]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(root)
        query = index.index_stream(spark.readStream.schema(schema).parquet(root), folder, f"{folder}-state")
        query.awaitTermination()
        assert query.exception() is None
    assert [r.call_id for r in index.search(spark, folder, "price", 5, ()).collect()] == [3, 1]


def test_places_of_terms(spark):
    row = spark.sql("SELECT 'b a, B c' AS t").select(index.term_places(F.col("t")).alias("x")).first()
    assert [(x.term, x.places) for x in row.x] == [("a", [1]), ("b", [0, 2]), ("c", [3])]


def test_places_are_sorted_without_a_lambda(spark):
    plan = plan_of(table(spark, [(1, "a b a")]).select(index.term_places(F.col("text"))))
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_postings_are_not_shuffled(spark, monkeypatch):
    """Only keys and texts pass a shuffle, the texts once; repeated and known calls are indexed once."""
    written = []
    kind = type(table(spark, []))
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *c, real=kind.sortWithinPartitions: written.append(plan_of(out := real(self, *c))) or out)
    folder = scratch_dir(spark, "index")
    rows = [(i % 20, "price now") for i in range(60)] + [(None, "price")]
    index.add_segment(table(spark, rows[:10]), folder, 0, block_calls=4)
    index.add_segment(table(spark, rows), folder, 1, block_calls=4)
    assert len(written) == 2 and all(p.count("Exchange") == 1 and "hashpartitioning(block" in p for p in written)
    held = spark.read.parquet(f"{folder}/postings").where("term = 'price'").select(F.inline("calls"))
    assert sorted(r.key for r in held.collect()) == list(range(20))
    assert [r.call_id for r in index.search(spark, folder, "price now", 50, ()).collect()] == list(range(20))
