"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, so that neighbours
share most bits, and cut into ranges.  Every range, and within it every group of 16
and of 16 groups and so on, keeps the bits that all its fingerprints share.  A search
goes down from the top and adds up the differences to the shared bits, each bit
counted where it first becomes shared; a group is left as soon as they exceed the
limit.  Fingerprints at most 3 bits apart differ in one half by at most 1 bit, so the
index is searched in two rotations with that tighter limit on the leading half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.llm.graph import components
from calllens.llm.store import written
from calllens.llm.words import batch, blank_words, id_and_text

SEED = 42
BITS = 64
LEADING = np.uint64(0xFFFFFFFF << 32)
FAN = 16
#: Pairs of a query and a group that a search holds at once.
FRONTIER = 1 << 20

FINGERPRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
ROUTED = pa.schema([("rotation", pa.int32()), ("range", pa.int32()), ("fp", pa.int64()), ("own", pa.bool_())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(data: bytes, width: int = 3) -> int:
    """A bit is set if it is set in over half the hashes of the word shingles.

    Repeated shingles count; fewer than ``width`` words are one shingle; no words: 0.
    """
    words = blank_words(data)
    if not words:
        return 0
    width = min(width, len(words))
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` of every whole text, the 64 bits as a signed number; null is empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            found = np.array([fingerprint(d.as_py(), width) for d in table.column("data")], np.uint64)
            yield pa.RecordBatch.from_arrays([table.column("id"), pa.array(found.view(np.int64))], schema=FINGERPRINTS)

    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return rows.mapInArrow(compute, "id bigint, fp bigint")


def rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def gray_rank(fp: Column) -> Column:
    """Rank in the Gray code, moved so that signed order is the order of ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    ranks = fps.view(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return (ranks ^ np.uint64(1 << 63)).view(np.int64)


class GrayTree:
    """Groups of ``FAN`` over items in Gray order; an item is a fingerprint, or a range
    known by the AND and the OR of its fingerprints."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        levels = [(low, high)]
        while len(levels[-1][0]) > FAN:
            at = np.arange(0, len(levels[-1][0]), FAN)
            levels.append(tuple(f.reduceat(v, at) for f, v in zip((np.bitwise_and, np.bitwise_or), levels[-1])))
        self.levels = []  # from the top: the shared bits' values, and which are shared here and not above
        above = None
        for low, high in reversed(levels):
            shared = ~(low ^ high)
            self.levels.append((low, shared if above is None else shared & ~np.repeat(above, FAN)[: len(shared)]))
            above = shared

    def search(self, queries: np.ndarray, limit: int, leading: int, joined=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, item) within the limits, piece by piece.

        ``joined(level, query, group)`` tells the pairs that need no search, as the
        query is known to belong to the group's only component.
        """
        for i in range(0, len(queries), FRONTIER // (4 * FAN)):
            q = np.arange(i, min(len(queries), i + FRONTIER // (4 * FAN)))
            top = len(self.levels[0][0])
            todo = [(0, np.repeat(q, top), np.tile(np.arange(top), len(q)), None, None)]
            while todo:
                level, q, node, total, lead = todo.pop()
                if joined is not None and len(q):
                    open_ = ~joined(level, q, node)
                    q, node = q[open_], node[open_]
                    total, lead = (None, None) if total is None else (total[open_], lead[open_])
                low, own = self.levels[level]
                apart = (queries[q] ^ low[node]) & own[node]
                total = np.bitwise_count(apart) + (0 if total is None else total)
                lead = np.bitwise_count(apart & LEADING) + (0 if lead is None else lead)
                near = np.flatnonzero((total <= limit) & (lead <= leading))
                q, node, total, lead = q[near], node[near], total[near], lead[near]
                if level + 1 == len(self.levels):
                    if len(q):
                        yield q, node
                    continue
                below = len(self.levels[level + 1][0])
                for j in range(0, len(q), FRONTIER // FAN):
                    part = slice(j, j + FRONTIER // FAN)
                    child = (node[part, None] * FAN + np.arange(FAN)).ravel()
                    real = child < below
                    todo.append(
                        (level + 1, np.repeat(q[part], FAN)[real], child[real], np.repeat(total[part], FAN)[real],
                         np.repeat(lead[part], FAN)[real])
                    )


class Labels:
    """Components among the fingerprints of one range, each named by its smallest place."""

    def __init__(self, size: int, items: int, depth: int):
        self.of, self.items, self.depth = np.arange(size), items, depth
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        self.regroup()

    def regroup(self) -> None:
        low = high = self.of[: self.items]
        levels = [(low, high)]
        for _ in range(self.depth - 1):
            at = np.arange(0, len(levels[-1][0]), FAN)
            levels.append((np.minimum.reduceat(levels[-1][0], at), np.maximum.reduceat(levels[-1][1], at)))
        self.groups = levels[::-1]

    def same(self, level: int, nodes: np.ndarray, group: np.ndarray) -> np.ndarray:
        low, high = self.groups[level]
        own = self.of[nodes]
        return (low[group] == own) & (high[group] == own)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of[a], self.of[b]
        if not (a != b).any():
            return
        of = self.of
        while True:
            a, b = of[a], of[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(of, jumped := of[of]):
                of[:] = jumped
        self.regroup()


def linked(own: np.ndarray, foreign: np.ndarray, limit: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what one range and its visitors hold of each component: each
    fingerprint that is not the first of its component, and that first one."""
    own = own[np.argsort(gray_ranks(own.view(np.int64)))]
    nodes = np.concatenate((own, foreign))
    tree = GrayTree(own, own)
    labels = Labels(len(nodes), len(own), len(tree.levels))
    for q, item in tree.search(nodes, limit, leading, lambda level, q, group: labels.same(level, q, group)):
        labels.union(q, item)
    rest = np.flatnonzero(labels.of != np.arange(len(nodes)))
    return nodes[rest], nodes[labels.of[rest]]


def turn(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if not by else fps << np.uint64(by) | fps >> np.uint64(BITS - by)


def near_links(distinct: DataFrame, limit: int = 3, range_size: int = 1 << 17, most_ranges: int = 1 << 16) -> DataFrame:
    """Edges ``(a, b)`` that connect every two fingerprints at most ``limit`` bits apart,
    directly or through others; ``distinct`` holds each fingerprint ``fp`` once.

    The ranges are cut at quantiles of the Gray rank, about ``range_size`` fingerprints
    each and no more than ``most_ranges``, so what the driver holds is bounded.  Every
    fingerprint visits its own range and those after it whose shared bits it can match.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    ranges = min(most_ranges, max(1, -(-n // range_size)))
    turns, leading = (0, BITS // 2), limit // 2
    ranked = [distinct.select("fp", rotated(F.col("fp"), by).alias("v")).withColumn("rank", gray_rank(F.col("v"))) for by in turns]
    cuts = [
        sorted(set(map(int, r.withColumn("x", F.col("rank").cast("double")).approxQuantile(
            "x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))) if ranges > 1 else []
        for r in ranked
    ]

    def place(cut: list[int], fps: np.ndarray) -> np.ndarray:
        # the cuts are doubles: a rank is compared as the double it rounds to
        return np.searchsorted(np.array(cut, float), gray_ranks(fps).astype(float), side="right")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            fps = table.column("fp").to_numpy().view(np.uint64)
            for k, by in enumerate(turns):
                v = turn(fps, by)
                yield batch(ROUTED, np.full(len(v), k), place(cuts[k], v), v.view(np.int64), np.ones(len(v), bool))

    schema = "rotation int, range int, fp bigint, own boolean"
    shared = (
        distinct.mapInArrow(placed, schema)
        .groupBy("rotation", "range")
        .agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
        .orderBy("rotation", "range")
        .collect()
    )
    tops = []
    for k in range(len(turns)):
        own = [r for r in shared if r.rotation == k]
        tops.append(
            ([r.range for r in own], *(np.array([r[c] for r in own], np.int64).view(np.uint64) for c in ("low", "high")))
        )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [(np.array(names), GrayTree(low, high)) for names, low, high in tops]
        for table in batches:
            fps = table.column("fp").to_numpy().view(np.uint64)
            for k, by in enumerate(turns):
                v = turn(fps, by)
                home, (names, tree) = place(cuts[k], v), trees[k]
                for q, item in tree.search(v, limit, leading):
                    there = names[item]
                    later = there >= home[q]
                    q, there = q[later], there[later]
                    yield batch(ROUTED, np.full(len(q), k), there, v[q].view(np.int64), there == home[q])

    def link(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        own = group.column("own").to_numpy(zero_copy_only=False)
        a, b = linked(fps[own], fps[~own], limit, leading)
        back = (BITS - turns[group.column("rotation")[0].as_py()]) % BITS
        return pa.Table.from_batches([batch(EDGES, turn(a, back).view(np.int64), turn(b, back).view(np.int64))])

    routed = distinct.mapInArrow(route, schema)
    return routed.groupBy("rotation", "range").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3
) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``.

    Documents whose fingerprints differ in at most ``limit`` bits are linked;
    ``component_id`` is the smallest id that links reach.  Texts without words have the
    fingerprint 0 and are linked like any other.  Equal fingerprints are searched once.
    Null ids count as larger than any id; a component of null ids alone has a null.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), limit))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(
        "id", "fp", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns.

    Of rows repeated with that id every one stays.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].cast("bigint").eqNullSafe(kept["_keep"]), "left_semi")
