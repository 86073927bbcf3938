"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Two words one edit apart differ in the counts of one letter (one of them is longer by a
letter) or of two (a letter was replaced): their count vectors have a squared distance of
1 or 2.  The letters are dealt into groups, of which such words disagree in two at most,
so they meet in a block of words with equal counts in the other groups and with lengths
that are equal or adjacent.  In a block the matrix product of the counts gives all squared
distances; pairs that are near enough are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import written

#: Words are kept as Latin-1, a byte for each code point, in the order of code points.
CODEC = "ISO-8859-1"
#: Distinct words a task holds before it passes its counts on.
HELD = 500_000
#: Words of a block before it is split, and rows and squared distances worked on at once.
BLOCK, ROWS, CELLS = 20_000, 1 << 16, 1 << 22
#: Letters are dealt to so many groups, the most frequent ones first, back and forth.
GROUPS = 4
COMMON = b"etaoinshrdlcumwfgypbvkjxqz"
TYPES = list(combinations(range(GROUPS), 2))
#: Words longer than this are verified one pair at a time.
WIDE = 64


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Group and 64-bit weight of each Latin-1 byte."""
    rest = [c for c in range(256) if c not in COMMON]
    group, weight = np.zeros(256, np.int64), np.zeros(256, np.uint64)
    for i, c in enumerate([*COMMON, *rest]):
        group[c] = min(i % (2 * GROUPS), 2 * GROUPS - 1 - i % (2 * GROUPS))
        weight[c] = zlib.crc32(b"%d" % c) << 32 | zlib.crc32(b"-%d" % c) | 1
    return group, weight


GROUP, WEIGHT = _letter_tables()
#: By the groups in which two words differ, as bits: the one type of block that reports them.
REPORTS = np.full(1 << GROUPS, -1)
for _t, (_i, _j) in enumerate(TYPES):
    REPORTS[1 << _i | 1 << _j] = _t
for _i in range(GROUPS):
    REPORTS[1 << _i] = TYPES.index(tuple(sorted((_i, (_i + 1) % GROUPS))))


def varied(run: bytes, utf8: bytes, seed: int, every: int) -> bytes:
    """The run without the letter its checksum names, if ``every`` divides that; ``seed``
    is the checksum of what precedes the run."""
    h = zlib.crc32(utf8, seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, shortest: int, every: int) -> DataFrame:
    """``(word, n)`` of the words of all texts; tasks add up theirs before the shuffle."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest)  # results are no longer than their runs
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for table in batches:
            for name, text in zip(table.column("id").to_pylist(), table.column("text")):
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                # other characters become a sign that ends a run; lower() changes A-Z only
                for run, n in Counter(runs.findall(text.as_py().encode("latin-1", "replace").lower())).items():
                    word = varied(run, run if run.isascii() else run.decode("latin-1").encode(), seed, every)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)

    return rows.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def flat(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and where each word begins and the last one ends."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), starts.astype(np.int64)


def per_word(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each word's values."""
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    at = starts - starts[0]
    return sums[at[1:]] - sums[at[:-1]]


def group_sums(words: pa.BinaryArray, values: np.ndarray) -> np.ndarray:
    """For each word and group the sum of the values of the group's letters."""
    letters, starts = flat(words)
    own = letters[starts[0] : starts[-1]]
    return np.stack([per_word(np.where(GROUP[own] == g, values[own], values.dtype.type(0)), starts) for g in range(GROUPS)], 1)


def entries(words: DataFrame) -> DataFrame:
    """``(key, longer, word, n)``: each word in the blocks of its own length and, as the
    longer side, of the length below, for each pair of groups left out."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            word, n = table.column("word"), table.column("n")
            sums = group_sums(word, WEIGHT)
            lengths = np.diff(flat(word)[1]).astype(np.uint64)
            for longer in (False, True):
                for t, (i, j) in enumerate(TYPES):
                    kept = sums.sum(1, dtype=np.uint64) - sums[:, i] - sums[:, j]
                    tag = (lengths - np.uint64(longer)) * np.uint64(len(TYPES)) + np.uint64(t)
                    key = (kept ^ kept >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + tag * np.uint64(0x9E3779B97F4A7C15)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(key), t, np.int8)), pa.array([longer] * len(key)), word, n],
                        ["key", "type", "longer", "word", "n"],
                    )

    return words.mapInArrow(scatter, "key bigint, type tinyint, longer boolean, word binary, n bigint")


def split_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The entries with the unit ``(x, y)`` of their block that they are worked on in, and
    their part ``part`` of the block.

    A block of more than ``block`` words is dealt into parts by hash; every two parts, and
    each part by itself, are a unit, so no task holds more than two parts at once.
    """
    hot = rows.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > block)
    hot = written(hot.select("key", F.ceil(F.col("all") / block).cast("int").alias("parts")), "hot-blocks")
    zero = F.lit(0)
    if hot.isEmpty():
        return rows.withColumns({"x": zero, "y": zero, "part": zero})
    dealt = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
    return dealt.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("parts", "other")


def one_edit(words: pa.BinaryArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of word numbers are exactly one edit apart; ``b`` is as long as ``a``
    or longer by one."""
    letters, starts = flat(words)
    lengths = np.diff(starts)
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(lengths[b] > WIDE):
        x, y = (letters[starts[w] : starts[w + 1]] for w in (a[i], b[i]))
        differ = np.flatnonzero(x != y[: len(x)])
        if len(x) == len(y):
            out[i] = len(differ) == 1
        else:
            at = differ[0] if len(differ) else len(x)
            out[i] = np.array_equal(x[at:], y[at + 1 :])
    narrow = np.flatnonzero(lengths[b] <= WIDE)
    for at in range(0, len(narrow), 1 << 17):
        some = narrow[at : at + (1 << 17)]
        width = int(lengths[b[some]].max()) + 1
        place = np.arange(width)

        def padded(who: np.ndarray) -> np.ndarray:
            inside = place < lengths[who][:, None]
            return np.where(inside, letters[np.where(inside, starts[who][:, None] + place, 0)], 0)

        x, y = padded(a[some]), padded(b[some])
        differ = x != y
        same = lengths[a[some]] == lengths[b[some]]
        # of words of adjacent length: no letter differs behind the one put in
        shifted = x[:, :-1] != y[:, 1:]
        last = np.where(shifted.any(1), width - 2 - shifted[:, ::-1].argmax(1), -1)
        out[some] = np.where(same, differ.sum(1) == 1, last < differ.argmax(1))
    return out


def close_counts(words: pa.BinaryArray, blocks: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word numbers, the first a shorter-side word, whose counts are at a squared
    distance of 2 (equal lengths) or 1 within a block.

    ``blocks`` holds where each block begins and the last one ends; a block's longer-side
    words come last.  Blocks of like size are multiplied together, padded to powers of two.
    """
    letters, starts = flat(words)
    own = letters[starts[0] : starts[-1]]
    used = np.flatnonzero(np.bincount(own, minlength=256))
    column = np.zeros(256, np.int64)
    column[used] = np.arange(len(used))
    n, lengths = len(words), np.diff(starts)
    # exact in floating point: squares stay below 2 ** 24, or 2 ** 53 for very long words
    kind = np.float32 if lengths.max(initial=0) < 4096 else np.float64
    place = np.repeat(np.arange(n), lengths) * len(used) + column[own]
    counts = np.bincount(place, minlength=n * len(used)).reshape(n, len(used)).astype(kind)
    counts = np.concatenate((counts, np.zeros((1, len(used)), kind)))  # row n pads
    squares = np.einsum("ij,ij->i", counts, counts)
    wanted = np.where(np.append(longer, False), 1, 2).astype(kind)
    squares_left = squares.copy()
    squares_left[n], wanted[n] = 1e12, -1
    size = np.diff(blocks)
    short = size - np.add.reduceat(longer, blocks[:-1]) if len(size) else size
    some = np.flatnonzero((short > 0) & (size > 1))
    power = lambda x: 1 << np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)
    shapes = np.stack((power(short[some]), power(size[some])), 1)
    for left, right in np.unique(shapes, axis=0):
        alike = some[(shapes == (left, right)).all(1)]
        at_once = max(1, CELLS // (left * right))
        tile = max(1, min(left, CELLS // right))
        for at in range(0, len(alike), at_once):
            first = blocks[alike[at : at + at_once]][:, None]
            cols = np.arange(right)
            cols = np.where(cols < size[alike[at : at + at_once]][:, None], first + cols, n)
            flipped = counts[cols].transpose(0, 2, 1)
            for low in range(0, left, tile):
                rows = np.arange(low, min(low + tile, left))
                rows = np.where(rows < short[alike[at : at + at_once]][:, None], first + rows, n)
                distance = squares_left[rows][:, :, None] + squares[cols][:, None, :] - 2 * (counts[rows] @ flipped)
                g, i, j = np.nonzero(distance == wanted[cols][:, None, :])
                a, b = rows[g, i], cols[g, j]
                new = longer[b] | (a < b)  # each pair of equal length once
                if new.any():
                    yield a[new], b[new]


def near_pairs(blocks: DataFrame) -> DataFrame:
    """``(word, other, other_n)``, both ways round, of all words exactly one edit apart.

    A task reads its blocks in order and works on a bounded number of rows at once.  Of
    the blocks in which two words meet, only the one of the groups they differ in reports
    them.
    """
    schema = pa.schema([("word", pa.binary()), ("other", pa.binary()), ("other_n", pa.int64())])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        names = ("key", "x", "y", "part", "type", "longer", "n")
        key, x, y, part, kind, longer, n = (table.column(c).to_numpy() for c in names)
        words = table.column("word").chunk(0)
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        codes = group_sums(words, np.arange(1, 257))
        for a, b in close_counts(words, np.concatenate(([0], new, [len(key)])), longer.astype(bool)):
            differ = (codes[a] != codes[b]) @ (1 << np.arange(GROUPS))
            fit = (REPORTS[differ] == kind[a]) & ((x[a] == y[a]) | (part[a] != part[b]))
            a, b = a[fit], b[fit]
            fit = one_edit(words, a, b)
            a, b = a[fit], b[fit]
            if len(a):
                ends = np.concatenate((a, b)), np.concatenate((b, a))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(e)) for e in ends] + [pa.array(n[ends[1]])], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for table in batches:
            held.append(table)
            rows += table.num_rows
            if rows >= ROWS:
                whole = pa.Table.from_batches(held)
                ends = [whole.column(c).to_numpy() for c in ("key", "x", "y")]
                # all but the last block, which may go on
                done = int(np.flatnonzero(np.logical_or.reduce([e != e[-1] for e in ends]))[-1:].sum() + 1)
                if any(e[0] != e[-1] for e in ends):
                    yield from work(whole.slice(0, done))
                    held = [b for b in whole.slice(done).combine_chunks().to_batches()]
                    rows = sum(b.num_rows for b in held)
        if rows:
            yield from work(pa.Table.from_batches(held))

    order = ["key", "x", "y", "longer"]
    dealt = blocks.repartition("key", "x", "y").sortWithinPartitions(*order)
    return dealt.mapInArrow(stream, "word binary, other binary, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of the chain that each word's form begins.

    Chains double with every round; each step multiplies the occurrences, so they are
    short and have no cycle.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.toDF("root", "next")
        step = now.join(ahead, "root", "left")
        if step.where("next IS NOT NULL").isEmpty():
            return now
        now = written(step.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = 7,
    fewest: int = 2,
    times: int = 10,
    every: int = 31,
    block: int = BLOCK,
) -> DataFrame:
    """One row per word: ``(word, form, root, n, n_near, form_n)``.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered, of which
    those whose checksum with the id ``every`` divides lose a letter; they have at least
    ``shortest`` letters and occur ``fewest`` times.  ``n_near`` counts the words exactly
    one edit away.  The most frequent of them (ties: the first in code-point order) is the
    form, if it occurs ``times`` as often.  ``root`` follows forms to the last one.

    A null text has no words, a null id is written as nothing before the colon, rows
    repeated in the table count each time, and an empty table gives no rows.
    """
    counts = word_counts(docs, id_col, text_col, shortest, every).where(F.col("n") >= fewest)
    words = written(counts, "spelling-words")
    near = near_pairs(split_blocks(entries(words), block)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best")
    )
    found = words.join(near, "word", "left")
    fits = -F.col("best.n") >= times * F.col("n")
    found = written(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    text = lambda c: F.decode(c, CODEC)
    return found.join(ends, "word", "left").select(
        text(F.col("word")).alias("word"), text(F.col("form")).alias("form"),
        text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n",
    )
