"""Similarity joins against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from calllens.operators import similarity as sim


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def names(seed, n, words=("blue", "bluish", "bold", "bolt", "bolts", "ring", "rings", "ringed", "red", "old")):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(words, k=draw.randint(1, 5)))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "key bigint, text string")


def first_keys(rows):
    out = {}
    for key, text in rows:
        if text is not None:
            out[text] = min(key, out.get(text, key))
    return out


@pytest.mark.parametrize("threshold, block", [(0.2, 2), (0.5, sim.BLOCK), (0.5, 2), (2 / 3, 2), (0.8, sim.BLOCK), (1.0, 2)])
def test_equal_to_all_pairs(spark, threshold, block):
    rows = names(1, 150)
    got = {(r.a, r.b): r.similarity for r in sim.similar_pairs(table(spark, rows), "key", "text", threshold, block).collect()}
    want = {}
    for (s, a), (t, b) in combinations(first_keys(rows).items(), 2):
        if (j := jaccard(s, t)) >= threshold:
            want[min(a, b), max(a, b)] = j
    assert got == pytest.approx(want)


def test_two_tables(spark):
    left, right = names(2, 60), [(i + 1000, t) for i, t in names(3, 60)]
    got = sim.similarity_join(table(spark, left), table(spark, right), "key", "text", "key", "text", 0.5, block=3)
    want = {
        (a, b): jaccard(s, t) for s, a in first_keys(left).items() for t, b in first_keys(right).items() if jaccard(s, t) >= 0.5
    }
    assert {(r.a, r.b): r.similarity for r in got.collect()} == pytest.approx(want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " - "), (4, "Ring"), (5, "ring!"), (6, "ring"), (6, "ring"), (7, "rings"), (8, "x" * 50_000)]
    got = {(r.a, r.b): r.similarity for r in sim.similar_pairs(table(spark, rows), "key", "text", 0.5).collect()}
    assert got == {(4, 5): 1.0, (4, 6): 1.0, (5, 6): 1.0, (4, 7): 4 / 7, (5, 7): 4 / 7, (6, 7): 4 / 7}
    assert sim.similar_pairs(table(spark, []), "key", "text").collect() == []
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            sim.similar_pairs(table(spark, rows), "key", "text", bad)


def test_copies_are_not_expanded(spark):
    """A text in a third of the rows stands for its copies; no pair repeats."""
    rows = [(i, "blue bolt") for i in range(300)] + [(i + 300, "blue bolts") for i in range(300)] + [(i + 600, f"ring {i}") for i in range(300)]
    got = sim.similar_pairs(table(spark, rows), "key", "text", 0.7).where("a < 600").collect()
    assert [(r.a, r.b) for r in got] == [(0, 300)]
    found = {r.key: (r.text_key, r.links) for r in sim.with_similar(table(spark, rows), "key", "text", 0.7).collect()}
    assert len(found) == 900 and found[299] == (0, 1) and found[599] == (300, 1)


def test_hot_trigram_is_dealt_to_parts(spark):
    """All sets begin with the same trigram; no part holds more than a few of its rows."""
    rows = [(i, f"zz{i:04d}") for i in range(500)]
    sets = sim.ordered_sets(table(spark, rows).withColumn("side", F.lit(0)))
    front = sim.prefixes(sets, 0.2)
    pairs = sim.candidates(front, front, 0.2, True, 50)
    assert "CartesianProduct" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)
    assert pairs.count() > 0


def test_no_cross_join(spark):
    plan = plan_of(sim.similar_pairs(table(spark, names(1, 20)), "key", "text", 0.8))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("threshold", [0.4, 0.9])
def test_long_texts_in_blocks(spark, threshold):
    """More trigrams than are counted at first, in several scripts; a key of two texts."""
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz\u00e4\u00f6\u03bb\u0436\u4e2d"
    words = ["".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(400)]
    base = [" ".join(draw.choices(words, k=draw.randint(60, 200))) for _ in range(10)]
    rows = [(i // 2, " ".join(w for w in draw.choice(base).split() if draw.random() < keep)) for i, keep in enumerate([0.97, 0.7, 0.95, 0.5] * 10)]
    assert len(set().union(*[grams(t) for _, t in rows])) > sim.FRONT
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in sim.similar_pairs(table(spark, rows), "key", "text", threshold, block=7).collect())
    want = [(min(a, b), max(a, b), round(jaccard(s, t), 9)) for (s, a), (t, b) in combinations(first_keys(rows).items(), 2) if a != b and jaccard(s, t) >= threshold]
    assert got == sorted(want) and want


def test_pairs_of_one_table_are_not_joined(spark):
    assert "Join" not in plan_of(sim.similar_pairs(table(spark, names(1, 20)), "key", "text", 0.4))


def test_exploded_rows_are_not_broadcast(spark):
    front = sim.prefixes(sim.stored(sim.ordered_sets(table(spark, names(1, 20)).withColumn("side", F.lit(0))), "sets"), 0.5)
    assert "SortMergeJoin" in plan_of(sim.candidates(front, front, 0.5, True, 50))


def block_of(sets):
    """Sets of numbers as a block of the join."""
    sets = sorted(sets, key=len)
    kinds = sorted(set().union(*sets))
    at = {g: i for i, g in enumerate(kinds)}
    n = np.array([len(s) for s in sets])
    places = np.array([at[g] for s in sets for g in sorted(s)], np.int32)
    return sets, sim.Block(pa.array(range(len(sets))), n, np.zeros((len(sets), 0)), places, np.array(kinds, np.int64))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("kinds, most", [(60, 55), (3000, 1500), (12_000, 400)])
def test_pairs_of_two_blocks(threshold, kinds, most):
    """Sets that hold nearly everything, much, and little of what there is; copies with changes."""
    draw = random.Random(kinds)
    sets = [set(draw.sample(range(kinds), draw.randint(most // 2, most))) for _ in range(60)]
    sets += [{g for g in s if draw.random() < keep} for s in sets[:30] for keep in (0.98, 0.8, 0.5)]
    draw.shuffle(sets)
    (left, x), (right, y), some = block_of(sets[:75]), block_of(sets[75:]), 0
    for same, (a, one), (b, other) in ((False, (left, x), (right, y)), (True, (left, x), (left, x))):
        got = {(int(u), int(v)): s for u, v, s in ((u, v, s) for us, vs, ss in sim.met(one, other, threshold, same) for u, v, s in zip(us, vs, ss))}
        want = {(i, j): len(s & t) / len(s | t) for i, s in enumerate(a) for j, t in enumerate(b) if not same or i < j}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})
        some += len(got)
    assert some


def test_sets_are_the_trigrams(spark, monkeypatch):
    texts = ["", "a", " - ", "Ring rings ring", "Äß \U0001d4d0\U0001d4d1x İx", "l'été_2½ 中文", "x" * 500, "áb"]
    df = table(spark, list(enumerate(texts)))
    rows = df.select("key", sim.spaced(F.col("text")).alias("words"), sim.trigrams(F.col("text")).alias("grams")).orderBy("key").collect()
    want = [sorted(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in r.grams) for r in rows]
    for most in (sim.TABLE_BYTES, 40, 1):
        monkeypatch.setattr(sim, "TABLE_BYTES", most)
        got = []
        for sizes, grams in sim.gram_sets(pa.array([r.words for r in rows])):
            got += [g.tolist() for g in np.split(grams, np.cumsum(sizes)[:-1])]
        assert got == want


def test_blocks_far_apart_are_not_compared(spark):
    """Texts of two alphabets: no block meets one of the other, and nothing is lost."""
    latin = [(i, t) for i, t in names(4, 80)]
    greek = [(i + 100, t) for i, t in names(5, 80, ("αβγ", "δεζ", "ηθι", "κλμ"))]
    folder, pairs = sim._blocks(table(spark, latin + greek), "key", "text", 0.8, 10)
    held = spark.read.parquet(folder).select("block", (F.col("key") >= 100).alias("greek")).distinct().groupBy("block").count()
    assert held.where("count > 1").count() == 0
    of = {r.block: r.greek for r in spark.read.parquet(folder).groupBy("block").agg(F.max(F.col("key") >= 100).alias("greek")).collect()}
    met = [(r.x, y) for r in pairs.collect() for y in r.ys]
    assert set(of.values()) == {True, False} and all(of[x] == of[y] for x, y in met)


def test_no_text_is_shuffled_or_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sim, "stored", lambda df, purpose, real=sim.stored: kept.append(df.columns) or real(df, purpose))
    found = sim.with_similar(table(spark, names(6, 50)), "key", "text", 0.8)
    assert kept and not any("text" in c for c in kept)
    assert not [line for line in plan_of(found).splitlines() if "Exchange" in line and "text" in line]


def test_copies_in_several_files(spark):
    """Copies lie in different tasks, the smallest key in the last; keys of another type, and none."""
    rows = [(f"k{9 - i}", t) for i, t in enumerate(["blue bolt", "blue bolts", "blue bolt", "ring", "blue bolt"])] + [(None, "blue bolts ring")]
    df = spark.createDataFrame(rows, "key string, text string").repartition(5)
    assert [(r.a, r.b) for r in sim.similar_pairs(df, "key", "text", 0.7).collect()] == [("k5", "k8")]
    found = sorted((r.key or "", r.text_key, r.links) for r in sim.with_similar(df, "key", "text", 0.7).collect())
    assert found == [("", None, 0), ("k5", "k5", 1), ("k6", "k6", 0), ("k7", "k5", 1), ("k8", "k8", 1), ("k9", "k5", 1)]
