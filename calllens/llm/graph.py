"""Connected components of a large graph by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each pair with the smallest neighbour of its first node; tasks reduce a node's
    pairs before the shuffle, and the join back is one that AQE may split."""
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("low")), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        _smallest(both)
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _smallest(down)
    return (
        near.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(near.select("a", F.col("low").alias("b")))
        .where("a <> b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge and is not itself the smallest of
    its component; ``edges`` holds pairs ``(a, b)`` of bigints in any direction.

    Every round is stored in the shared folder.  The rounds, about the logarithm of the
    longest path, end when one changes nothing.
    """
    now = written(edges.where("a <> b").distinct(), "edges")
    sums, before = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))), None
    while True:
        state = now.select(sums.alias("s")).first().s
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = written(_small_star(_large_star(now)), "edges")
