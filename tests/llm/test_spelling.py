"""Spelling variants against plain versions: every pair compared, every chain walked."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from calllens.llm import spelling
from calllens.llm.queries import table
from pyspark.sql import functions as F


def words_by_hand(docs, shortest=7, fewest=2, every=31):
    out = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= fewest}


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs, times=10, **options):
    words = words_by_hand(docs, **options)
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def misspelt(draw, n, alphabet="abcdé"):
    base = ["".join(draw.choices(alphabet, k=draw.randint(7, 10))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = draw.choice(base[: 1 + draw.randrange(12)])
        if draw.random() < 0.3:
            at = draw.randrange(len(w))
            w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice(alphabet) + w[at:], w[:at] + draw.choice(alphabet) + w[at + 1 :]])
        out.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
    return out


@pytest.mark.parametrize("seed, block", [(0, spelling.BLOCK), (1, spelling.BLOCK), (1, 3), (2, 3)])
def test_against_all_pairs(spark, seed, block):
    """Small alphabets put many words into one block; small blocks are split."""
    draw = random.Random(seed)
    docs = [(i, " ".join(misspelt(draw, 40))) for i in range(60)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string"), times=3, block=block)
    assert rows_of(got) == variants_by_hand(docs, times=3)


def test_small_pieces_of_work(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ROWS", 7)
    monkeypatch.setattr(spelling, "CELLS", 4)
    monkeypatch.setattr(spelling, "HELD", 5)
    draw = random.Random(9)
    docs = [(i, " ".join(misspelt(draw, 30))) for i in range(30)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string"), times=3)
    assert rows_of(got) == variants_by_hand(docs, times=3)


def test_chains_are_followed(spark):
    words = ["chained"] * 1000 + ["chainet"] * 100 + ["chainxt"] * 10 + ["chyinxt"]
    docs = [(i, w) for i, w in enumerate(words * 2)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id bigint, text string"), every=10**10)
    assert {r.word: r.root for r in got.collect()} == dict.fromkeys(["chained", "chainet", "chainxt", "chyinxt"], "chained")


def test_small_table(spark, small):
    docs = table(spark, small, "documents").where("length(text) < 3000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()][:60]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))) == variants_by_hand(rows)


def test_odd_rows(spark, odd, none):
    """Nulls, empty texts, repeated rows, letters beyond U+00FF, very long words."""
    long = "ab" * 3000
    more = [
        (20, "Ünïcodes ünïcodes ÜNÏCODES Łódźword łódźword"), (21, "xxxx÷yyyy×zzzz xxxx÷yyyy×zzzz"), (22, "�sevenly sevenly"),
        (23, f"{long} {long} {long}x {long}x {long[:-1]}c {long[:-1]}c a{long} a{long}"), (23, "éé straßen straßen strasßen strasßen"),
    ]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.variants(docs)) == variants_by_hand(rows)
    assert spelling.variants(none).collect() == []


def test_verified_letter_by_letter():
    draw = random.Random(2)
    words = ["".join(draw.choices("ab", k=draw.randint(1, 7))) for _ in range(120)] + ["a" * 80, "a" * 81, "a" * 79 + "b", "b" + "a" * 80]
    packed = pa.array([w.encode() for w in words], pa.binary())
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) - len(a) in (0, 1)]
    a, b = (np.array(x) for x in zip(*pairs))
    got = spelling.one_edit(packed, a, b)
    assert got.tolist() == [distance_is_one(words[i], words[j]) for i, j in pairs]


def test_hot_block_is_split_without_loss(spark):
    """Anagrams share every block; no unit holds more than two parts of one."""
    draw = random.Random(4)
    words = {"".join(draw.sample("abcdefgh", 8)) for _ in range(400)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:50]}
    df = spark.createDataFrame([(w.encode(), 2) for w in sorted(words)], "word binary, n bigint")
    units = spelling.split_blocks(spelling.entries(df), 50)
    assert units.groupBy("key", "x", "y").count().agg(F.max("count")).first()[0] < 200
    got = {(bytes(r.word).decode(), bytes(r.other).decode()) for r in spelling.near_pairs(units).collect()}
    assert got == {(a, b) for a in words for b in words if distance_is_one(a, b)}
