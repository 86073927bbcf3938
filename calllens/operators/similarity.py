"""Similarity joins over trigram sets.

Within one table, texts are compared in pairs of blocks of about the same sizes, as far as
their distances from a few texts of the table admit.

Between two tables, every text is a set of trigrams, ordered from the rarest to the most
frequent in the corpus.  Two sets whose similarity reaches the threshold share one of the
first few, so texts meet under those alone, and only with texts of a length that the
threshold admits; what meets is verified by the exact overlap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calllens.functions.text import trigrams
from calllens.session import scratch_dir, stored

#: Postings of one trigram and length band that meet in one task.
BLOCK = 10_000
#: Texts of a block that is compared with others as a whole, and trigrams of all its texts, about.
TEXTS, BLOCK_GRAMS = 5_000, 6_000_000
#: Trigrams counted for all pairs of two blocks at least and at most, rows of one product, bytes of a batch of pairs.
LEAST_FRONT, FRONT, STRIP, BATCH_BYTES = 64, 1024, 500, 8_000_000
#: Words of 64 trigrams that are counted first for the pairs that are left.
HEAD = 16
#: The other words of all texts are laid out once more than one in so many of them is in a batch of pairs.
FEW = 50
#: Texts that distances are taken from, and those they are picked of.
PIVOTS, DRAWN = 8, 64
#: Bytes of a table of texts by trigrams, and of the texts that are cut up at a time, about.
TABLE_BYTES, PIECE_BYTES = 16_000_000, 4_000_000
#: Tasks that the pairs of blocks are dealt to, and those of a core before a task reads a block for several pairs.
MOST_TASKS, CORE_TASKS = 10_000, 8
#: Pairs that a block is read for once, at most.
MOST_PAIRS = 16


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, copies)``: each text once, under its smallest key; tasks reduce their
    copies before the shuffle."""
    return (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .where("text IS NOT NULL")
        .groupBy("text")
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
        .select("key", "text", "copies")
    )


def ordered_sets(texts: DataFrame) -> DataFrame:
    """``(side, key, grams)`` with each text's distinct trigrams from the rarest on; a text
    without any has no row."""
    rows = texts.select("side", "key", F.explode(trigrams(F.col("text"))).alias("gram"))
    often = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(often, "gram").groupBy("side", "key").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return ranked.select("side", "key", F.transform("g", lambda g: g["gram"]).alias("grams"))


def _at_least(size: Column, threshold: float) -> Column:
    # a rounding error may only admit more
    return F.ceil(size * threshold - 1e-9)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """A row ``(side, key, n, band, pos, gram)`` per trigram that a similar set may be met
    under: all but the last ``ceil(threshold * n) - 1``.

    Bands are powers of 1 / threshold, so sizes that may be similar lie in the same band
    or in neighbours.
    """
    n = F.size("grams")
    front = F.slice("grams", F.lit(1), n - _at_least(n, threshold) + 1)
    band = F.floor(F.log(n) / math.log(1 / threshold)) if threshold < 1 else n
    return sets.select("side", "key", n.alias("n"), band.cast("int").alias("band"), F.posexplode(front).alias("pos", "gram"))


def candidates(index: DataFrame, probe: DataFrame, threshold: float, same: bool, block: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of keys that share a trigram of their prefixes and may
    reach the threshold by their sizes and places.

    A trigram that many sets of a band begin with is dealt into parts of about ``block``
    index rows; the probing rows go to every part.
    """
    postings = index.select("gram", "band", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    hot = postings.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    hot = stored(hot.select("gram", "band", F.ceil(F.col("c") / block).cast("int").alias("parts")), "hot-trigrams")
    parts = F.coalesce("parts", F.lit(1))
    near = [-1, 0, 1] if threshold < 1 else [0]
    probes = probe.select(
        "gram", F.explode(F.transform(F.array(*map(F.lit, near)), lambda d: F.col("band") + d)).alias("band"),
        F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"),
    )
    postings = postings.join(hot, ["gram", "band"], "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
    probes = probes.join(hot, ["gram", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # Catalyst takes the exploded rows for as small as the sets, and would broadcast them
    meeting = postings.drop("parts").join(probes.drop("parts").hint("merge"), ["gram", "band", "part"])
    if same:
        meeting = meeting.where("a < b")
    # the overlap needed, and what the places leave of it
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    left = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    earlier = F.least("pos_a", "pos_b")
    admitted = (
        (F.least("n_a", "n_b") >= _at_least(F.greatest("n_a", "n_b"), threshold)) & (left + earlier >= needed)
    )
    return meeting.where(admitted).select("a", "b").distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    held = pairs.join(left.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(
        right.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b"
    )
    both = F.size(F.array_intersect("x", "y"))
    return (
        held.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), both.alias("both"))
        .select("a", "b", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")


def spaced(text: Column) -> Column:
    """The words that :func:`trigrams` cuts up, with blanks between them."""
    # plain letters first: the tests of a class run in order
    return F.regexp_replace(F.lower(text), r"[^[a-z0-9][\p{L}\p{N}]]+", " ")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of pieces, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def gram_sets(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(sizes, trigrams)`` of some texts at a time (:func:`spaced`, none null): the distinct
    trigrams of each as sorted numbers, the code points of the three characters side by side.

    Each word of the batch is cut up once; the texts are rows of a table of what they hold.
    """
    lists = pc.split_pattern(words, " ")
    ends = np.asarray(lists.offsets, np.int64)
    coded = lists.values.dictionary_encode()
    chars = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
    points = np.frombuffer("".join([f"  {w} " for w in coded.dictionary.to_pylist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(chars + 3) - chars - 3
    # those that reach into the next word are of no word
    codes = pa.array(points[:-2] << 42 | points[1:-1] << 21 | points[2:]).dictionary_encode()
    kinds = codes.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    kinds, kind = kinds[order], rank[codes.indices.to_numpy()]
    lengths = np.where(chars > 0, chars + 1, 0)
    word = coded.indices.to_numpy()
    step = max(1, TABLE_BYTES // max(1, len(kinds)))
    for first in range(0, len(words), step):
        bounds = ends[first : first + step + 1]
        some = word[bounds[0] : bounds[-1]]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = kind[_spans(starts[some], lengths[some])]
        row = np.repeat(row, lengths[some])
        if len(kinds) * (len(bounds) - 1) <= TABLE_BYTES:
            held = np.zeros((len(bounds) - 1, len(kinds)), bool)
            held[row, at] = True
            row, at = np.nonzero(held)
        else:  # a text with more kinds than the table may have
            at = np.unique(at)
            row = np.zeros(len(at), np.int64)
        yield np.bincount(row, minlength=len(bounds) - 1), kinds[at]


def _once(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, under its smallest key, in pieces."""
    order = pc.sort_indices(pa.table([rows["digest"], rows["key"]], ["digest", "key"]), [("digest", "ascending"), ("key", "ascending")])
    digest = rows["digest"].take(order)
    new = np.ones(len(digest), bool)
    new[1:] = pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
    first = order.filter(pa.array(new))
    size = pc.binary_length(rows["words"]).take(first).to_numpy()
    ends = np.nonzero(np.diff(np.cumsum(size, dtype=np.int64) // PIECE_BYTES))[0] + 1
    for start, end in zip([0, *ends], [*ends, len(first)]):
        if start < end:
            yield rows.take(first[start:end])


def pivots(texts: DataFrame) -> list[np.ndarray]:
    """The trigrams of a few texts that many others are like, out of some drawn by hash."""
    drawn = [r[0] for r in texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(DRAWN).collect()]
    few = texts.select("text").where(F.xxhash64("text").isin(drawn)).distinct().select(spaced(F.col("text")).alias("words"))
    words = pa.array(sorted(r[0] for r in few.collect()), pa.string())
    sets = []
    for sizes, grams in gram_sets(words):
        sets += [g for g in np.split(grams, np.cumsum(sizes)[:-1]) if len(g)]
    alike = np.array([[(o := len(np.intersect1d(a, b, assume_unique=True))) / (len(a) + len(b) - o) for b in sets] for a in sets])
    chosen, best = [], np.zeros(len(sets))
    for _ in range(min(PIVOTS, len(sets))):
        chosen.append(int(np.maximum(alike, best).sum(1).argmax()))
        best = np.maximum(best, alike[chosen[-1]])
    return [sets[i] for i in chosen]


def coded_sets(texts: DataFrame, near: list[np.ndarray]) -> DataFrame:
    """``(digest, key, n, side, grams, d0, d1, ...)`` of each text that has trigrams: its
    SHA-256, its smallest key in the batch, the number of its trigrams, the pivot that it is
    nearest to, the trigrams and the distances from the pivots."""
    names = [f"d{i}" for i in range(len(near))]
    kind = texts.schema["key"].dataType
    schema = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("key", kind), T.StructField("n", T.IntegerType()),
        T.StructField("side", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType())),
        *[T.StructField(d, T.DoubleType()) for d in names],
    ])
    places = np.unique(np.concatenate([*near, np.zeros(0, np.int64)]))
    holds = np.stack([np.isin(places, p) for p in near], axis=1).astype(np.float64) if near else np.zeros((0, 0))
    of_pivot = np.array([len(p) for p in near], np.float64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for rows in batches for p in _once(rows)):
            done = 0
            for sizes, grams in gram_sets(piece["words"]):
                some = piece.slice(done, len(sizes))
                done += len(sizes)
                at = np.minimum(np.searchsorted(places, grams), max(0, len(places) - 1))
                there = places[at] == grams if len(places) else np.zeros(len(grams), bool)
                text = np.repeat(np.arange(len(sizes)), sizes)[there]
                both = np.stack([np.bincount(text, holds[at[there], i], len(sizes)) for i in range(len(near))], axis=1) if near else np.zeros((len(sizes), 0))
                away = 1 - both / (sizes[:, None] + of_pivot - both)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out = pa.RecordBatch.from_arrays(
                    [some["digest"], some["key"], pa.array(sizes, pa.int32()),
                     pa.array(away.argmin(1) if near else np.zeros(len(sizes)), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams)), *[pa.array(away[:, i]) for i in range(len(near))]],
                    ["digest", "key", "n", "side", "grams", *names],
                )
                yield out.filter(pa.array(sizes > 0))

    rows = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "key", spaced(F.col("text")).alias("words"))
    return rows.mapInArrow(cut, schema)


def size_blocks(sets: DataFrame, threshold: float, block: int) -> tuple[str, DataFrame]:
    """The sets in files by ``block``, about so many of them near one pivot in the order of
    their sizes, each text once, and ``(x, ys)``: the blocks ``ys`` that ``x`` is compared with,
    whose sizes and distances admit the threshold."""
    spark = sets.sparkSession
    away = [c for c in sets.columns if c.startswith("d") and c != "digest"]
    # a row per size, so one task holds a few thousand
    sizes = sets.groupBy("side", "n").agg(F.count(F.lit(1)).alias("c"))
    # long texts fill a block sooner
    share = F.greatest(F.lit(1.0 / block), F.col("n") / BLOCK_GRAMS)
    before = F.sum(F.col("c") * share).over(W.partitionBy("side").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("side", "n", (F.col("c") * share).alias("held"), F.coalesce(before, F.lit(0.0)).alias("before"))
    # copies have one place
    place = F.col("before") + F.col("held") * (F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) / (1 << 20))
    placed = sets.join(F.broadcast(sizes), ["side", "n"]).withColumn("block", (F.floor(place) * PIVOTS + F.col("side")).cast("int"))
    each = placed.repartition("block").groupBy("block", "digest").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "grams", *away)])
    folder = scratch_dir(spark, "trigram-blocks")
    each.where("key IS NOT NULL").drop("digest").sortWithinPartitions("block", "n").write.partitionBy("block").parquet(folder)
    fields = ["n int", *[f"{c} double" for c in away], "block int"]
    held = spark.read.schema(", ".join(fields)).parquet(folder)
    ends = [f(c) for c in ("n", *away) for f in (F.min, F.max)]
    bounds = np.array([tuple(r) for r in held.groupBy("block").agg(*ends).orderBy("block").collect()], np.float64)
    meeting = []
    for i, (number, low, high, *_) in enumerate(bounds):
        rest = bounds[i:]
        good = (rest[:, 1] * threshold <= high + 1e-9) & (rest[:, 2] >= low * threshold - 1e-9)
        for c in range(3, bounds.shape[1], 2):
            # the distance is a metric
            good &= (rest[:, c] <= bounds[i, c + 1] + 1 - threshold + 1e-6) & (rest[:, c + 1] >= bounds[i, c] - (1 - threshold) - 1e-6)
        meeting.append((int(number), [int(y) for y in rest[good, 0]]))
    # a block is read once for some pairs, where there are enough for all cores
    each = max(1, min(MOST_PAIRS, sum(len(ys) for _, ys in meeting) // (CORE_TASKS * spark.sparkContext.defaultParallelism)))
    dealt = [(x, ys[i : i + each]) for x, ys in meeting for i in range(0, len(ys), each)]
    return folder, spark.createDataFrame(dealt, "x int, ys array<int>").repartition(max(1, min(len(dealt), MOST_TASKS)))


class Block:
    """Texts in the order of their sizes: ``keys``, sizes ``n``, distances ``away``, and ``at``, the
    places in ``kinds`` of their trigrams, one text after the other."""

    def __init__(self, keys: pa.Array, n: np.ndarray, away: np.ndarray, at: np.ndarray, kinds: np.ndarray):
        self.keys, self.n, self.away, self.at, self.kinds = keys, n, away, at, kinds

    @staticmethod
    def read(folder: str, number: int) -> Block:
        system, path = FileSystem.from_uri(folder)
        table = pa.concat_tables([
            pq.ParquetFile(system.open_input_file(f.path)).read()
            for f in system.get_file_info(FileSelector(f"{path}/block={number}")) if f.is_file and f.size and f.base_name.endswith(".parquet")
        ]).combine_chunks()
        if (np.diff(table["n"].to_numpy()) < 0).any():  # of several files
            table = table.sort_by("n").combine_chunks()
        coded = table["grams"].combine_chunks().flatten().dictionary_encode()
        away = [table[c].to_numpy() for c in table.column_names if c.startswith("d")]
        n = table["n"].to_numpy().astype(np.int64)
        return Block(table["key"].combine_chunks(), n, np.stack(away, axis=1) if away else np.zeros((len(n), 0)), coded.indices.to_numpy(), coded.dictionary.to_numpy())

    def near(self, other: Block, reach: float) -> Block:
        """The texts that are no further from the pivots than those of the other block, by ``reach``."""
        if not len(self.n) or not len(other.n):
            return self
        good = ((self.away >= other.away.min(0) - reach) & (self.away <= other.away.max(0) + reach)).all(1)
        if good.all():
            return self
        return Block(self.keys.filter(pa.array(good)), self.n[good], self.away[good], self.at[np.repeat(good, self.n)], self.kinds)

    def rows(self, places: np.ndarray) -> Block:
        starts = np.cumsum(self.n) - self.n
        n = self.n[places]
        return Block(self.keys.take(pa.array(places)), n, self.away[places], self.at[_spans(starts[places], n)], self.kinds)


def _bits(block: Block, to: np.ndarray, first: int, last: int) -> np.ndarray:
    """A bit for each of the shared trigrams in these words that a set has."""
    at = to[block.at]
    there = np.nonzero((at >= first * 64) & (at < last * 64))[0]
    rows = np.repeat(np.arange(len(block.n), dtype=np.int32), block.n)[there]
    bits = np.zeros((len(block.n), (last - first) * 64), np.uint8)
    bits[rows, at[there] - first * 64] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _alone(block: Block, to: np.ndarray) -> np.ndarray:
    """The number of each set's trigrams that are not shared."""
    return np.add.reduceat((to[block.at] < 0).astype(np.int32), np.cumsum(block.n) - block.n)


def _ones(bits: np.ndarray, most: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=1, count=most).astype(np.float32)


def met(x: Block, y: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(places in x, places in y, similarity)`` of the sets that reach the threshold.

    The trigrams that tell most sets apart are counted first, by a matrix product: as many as
    leave few pairs, since each that one set has and the other has not counts against them.
    Pairs that are left are counted bit by bit.  Where so many would be left that this takes
    longer, all trigrams are counted by products.
    """
    n, m = x.n, y.n
    shared, in_x, in_y = np.intersect1d(x.kinds, y.kinds, assume_unique=True, return_indices=True)
    often_x = np.bincount(x.at, minlength=len(x.kinds))[in_x] / max(1, len(n))
    often_y = np.bincount(y.at, minlength=len(y.kinds))[in_y] / max(1, len(m))
    used = (often_x > 0) & (often_y > 0)
    in_x, in_y, often_x, often_y = in_x[used], in_y[used], often_x[used], often_y[used]
    if not len(in_x):
        return
    apart = often_x * (1 - often_y) + often_y * (1 - often_x)
    order = np.argsort(-apart, kind="stable")
    words = -(-len(order) // 64)
    to_x, to_y = np.full(len(x.kinds), -1, np.int32), np.full(len(y.kinds), -1, np.int32)
    to_x[in_x[order]] = to_y[in_y[order]] = np.arange(len(order))
    alone_x, alone_y = _alone(x, to_x), _alone(y, to_y)
    # sets may differ by this share of their sizes
    share = (1 - threshold) / (1 + threshold)
    may = share * (n.mean() + m.mean()) - alone_x.mean() - alone_y.mean()
    told = np.cumsum(apart[order])
    goal = 1.3 * may + 5 * math.sqrt(max(may, 1))
    front = len(order) if told[-1] < goal or goal <= 0 else int(np.searchsorted(told, goal)) + 1
    front = min(len(order), max(front, LEAST_FRONT))
    whole = front > FRONT and told[min(FRONT, len(told)) - 1] < may
    front = len(order) if whole else min(front, FRONT)
    cut = -(-front // 64)
    head = words if whole else min(words, max(cut, HEAD))
    bits_x, bits_y = _bits(x, to_x, 0, head), _bits(y, to_y, 0, head)
    left_x = n - alone_x - np.bitwise_count(bits_x).sum(1, dtype=np.int64)
    left_y = m - alone_y - np.bitwise_count(bits_y).sum(1, dtype=np.int64)
    batch, tails = max(1, BATCH_BYTES // (8 * words)), None
    wide = range(0, words, FRONT // 64)
    if not whole:
        ones_x, ones_y = _ones(bits_x[:, :cut].copy(), front), _ones(bits_y[:, :cut].copy(), front)
        # two columns more: what the product must exceed
        need_x = (alone_x + ones_x.sum(1) - share * n) / 2
        need_y = (alone_y + ones_y.sum(1) - share * m) / 2
        ones_x = np.column_stack([ones_x, -need_x, np.ones(len(n))]).astype(np.float32)
        ones_y = np.column_stack([ones_y, np.ones(len(m)), -need_y]).astype(np.float32)
    for start in range(0, len(n), STRIP):
        end = min(start + STRIP, len(n))
        # by size, so the partners lie in a row
        lo = np.searchsorted(m, n[start] * threshold - 1e-6)
        hi = np.searchsorted(m, n[end - 1] / threshold + 1e-6, "right")
        if same:
            lo = max(lo, start)
        if lo >= hi:
            continue
        if whole:
            count = np.zeros((end - start, hi - lo), np.float32)
            for w in wide:
                count += _ones(bits_x[start:end, w : w + FRONT // 64].copy(), FRONT) @ _ones(bits_y[lo:hi, w : w + FRONT // 64].copy(), FRONT).T
            # a rounding error may only admit more
            least = (threshold / (1 + threshold)) * (n[start:end, None] + m[lo:hi]) - 1e-2
            i, j = np.nonzero(count >= least)
            exact = count[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(ones_x[start:end] @ ones_y[lo:hi].T >= -1e-2)
        i, j = i + start, j + lo
        if same:
            ahead = i < j
            i, j = i[ahead], j[ahead]
        for k in range(0, len(i), batch):
            u, v = i[k : k + batch], j[k : k + batch]
            if whole:
                both = (exact[ahead] if same else exact)[k : k + batch]
            else:
                both = np.bitwise_count(bits_x[u] & bits_y[v]).sum(1, dtype=np.int64)
                most = both + np.minimum(left_x[u], left_y[v])
                good = most >= (threshold / (1 + threshold)) * (n[u] + m[v]) - 1e-2
                u, v, both = u[good], v[good], both[good]
                if head < words and len(u):
                    i_x, i_y = u, v
                    if tails is None and len(u) * FEW < len(n) + len(m):
                        (some_x, i_x), (some_y, i_y) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
                        tail_x, tail_y = _bits(x.rows(some_x), to_x, head, words), _bits(y.rows(some_y), to_y, head, words)
                    else:
                        tails = tails or (_bits(x, to_x, head, words), _bits(y, to_y, head, words))
                        tail_x, tail_y = tails
                    both += np.bitwise_count(tail_x[i_x] & tail_y[i_y]).sum(1, dtype=np.int64)
            similarity = both / (n[u] + m[v] - both)
            good = similarity >= threshold
            if good.any():
                yield u[good], v[good], similarity[good]


def _compared(folder: str, first: int, others: list[int], threshold: float) -> Iterator[tuple[Block, Block, Iterator]]:
    """``(x, y, found)`` of a block and others, as far as they may meet; ``found`` has what :func:`met` has
    without pairs of one key."""

    def found(x: Block, y: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for u, v, similarity in met(x, y, threshold, same):
            apart = pc.not_equal(x.keys.take(pa.array(u)), y.keys.take(pa.array(v))).to_numpy(zero_copy_only=False)
            yield u[apart], v[apart], similarity[apart]

    one = Block.read(folder, first)
    reach = 1 - threshold + 1e-6
    for second in others:
        x, y = one, one
        if second != first:
            y = Block.read(folder, second).near(one, reach)
            x = one.near(y, reach)
            y = y.near(x, reach)
        if len(x.n) and len(y.n):
            yield x, y, found(x, y, first == second)


def _blocks(df: DataFrame, key: str, text: str, threshold: float, block: int) -> tuple[str, DataFrame]:
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    return size_blocks(stored(coded_sets(texts, pivots(texts)), "trigram-sets"), threshold, block)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.6, block: int = TEXTS) -> DataFrame:
    """``(a, b, similarity)`` of all pairs of different texts that are at least so similar.

    A text stands under its smallest key and ``a < b``; :func:`distinct_texts` has the
    copies.  Null texts, and texts without letters and digits, are similar to none.
    Different texts with the same trigrams are pairs of similarity 1.

    Whole texts share their rarest trigrams with very many others, so they are compared in
    pairs of blocks of ``block`` texts, as far as sizes and distances admit: no pair is
    shuffled, no text is, and a task reads two blocks at a time.
    """
    _checked(threshold)
    kind = df.schema[key].dataType
    folder, pairs = _blocks(df, key, text, threshold, block)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first, others in zip(rows["x"].to_pylist(), rows["ys"].to_pylist()):
                for x, y, found in _compared(folder, first, others, threshold):
                    for u, v, similarity in found:
                        a, b = x.keys.take(pa.array(u)), y.keys.take(pa.array(v))
                        swap = pc.greater(a, b)
                        yield pa.RecordBatch.from_arrays(
                            [pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(similarity)], ["a", "b", "similarity"]
                        )

    return pairs.mapInArrow(compare, schema)


def similar_counts(df: DataFrame, key: str, text: str, threshold: float = 0.6, block: int = TEXTS) -> DataFrame:
    """``(key, links)``: in how many of the pairs of :func:`similar_pairs` a key stands, if any;
    tasks count their pairs, so none becomes a row."""
    _checked(threshold)
    kind = df.schema[key].dataType
    folder, pairs = _blocks(df, key, text, threshold, block)
    schema = T.StructType([T.StructField("key", kind), T.StructField("links", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first, others in zip(rows["x"].to_pylist(), rows["ys"].to_pylist()):
                for x, y, found in _compared(folder, first, others, threshold):
                    links = [np.zeros(len(b.n), np.int64) for b in (x, y)]
                    for u, v, _ in found:
                        for held, at in zip(links, (u, v)):
                            held += np.bincount(at, minlength=len(held))
                    for b, held in zip((x, y), links):
                        yield pa.RecordBatch.from_arrays([b.keys, pa.array(held)], ["key", "links"]).filter(pa.array(held > 0))

    return pairs.mapInArrow(compare, schema).groupBy("key").agg(F.sum("links").alias("links"))


def similarity_join(
    left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str,
    threshold: float = 0.6, block: int = BLOCK,
) -> DataFrame:
    """``(a, b, similarity)`` of all pairs of a text of the left and one of the right table
    that are at least so similar, equal texts included; each text stands under its
    smallest key in its table.  The keys must be of one type."""
    _checked(threshold)
    texts = distinct_texts(left, left_key, left_text).withColumn("side", F.lit(0)).unionByName(
        distinct_texts(right, right_key, right_text).withColumn("side", F.lit(1))
    )
    sets = stored(ordered_sets(texts), "trigram-sets")
    front = prefixes(sets, threshold)
    pairs = candidates(front.where("side = 0"), front.where("side = 1"), threshold, False, block)
    return _verified(pairs, sets.where("side = 0"), sets.where("side = 1"), threshold)


def with_similar(df: DataFrame, key: str, text: str, threshold: float = 0.6) -> DataFrame:
    """Each row's key with the key its text stands under, and the number of different
    texts similar to it: ``(key, text_key, links)``; null texts have neither.

    Texts meet by their SHA-256, so no text is shuffled or stored."""
    links = similar_counts(df, key, text, threshold)
    rows = df.select(F.col(key).alias("key"), F.unhex(F.sha2(F.col(text), 256)).alias("digest"))
    texts = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key"))
    known = texts.join(links, "key", "left").select("digest", F.col("key").alias("text_key"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(known, "digest", "left").select("key", "text_key", "links")
