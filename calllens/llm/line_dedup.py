"""Line deduplication that forgives a few edits.

A line of which at most ``k`` characters were edited keeps one of its ``k`` + 1
segments unchanged, near its old place.  Every distinct line is indexed by its segments
and probed with the substrings of other lines that may equal one, by length.  Lines that
meet under a segment are first compared by character counts, which edits can change only
so much, and then by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.llm.graph import components
from calllens.llm.store import written
from calllens.llm.words import batch, id_and_text

BLANKS = b" \t\n\r\x0b\x0c"
ENTRY = np.dtype([("key", "<u8"), ("line", "<u8"), ("sketch", "<u8")])
#: Pairs compared at once.
CHUNK = 1 << 20
WORD = (1 << 64) - 1


def lines_of(data: bytes) -> list[bytes]:
    """The lines between line feeds, without ASCII blanks at their ends; empty ones too."""
    return [line.strip(BLANKS) for line in data.split(b"\n")]


def edits_allowed(length: int, most: int, per_edit: int) -> int:
    return min(most, length // per_edit)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """``k`` + 1 segments ``(start, size)``, the later ones longer by one at most."""
    size, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        own = size + (i >= k + 1 - more)
        out.append((at, own))
        at += own
    return out


def probes(length: int, most: int, per_edit: int) -> list[tuple[int, int, int, int]]:
    """``(indexed length, segment, start, size)`` of the substrings of a line that may
    equal a segment of a line as long or shorter.

    Of the places a segment can have moved to, those suffice in which the edits on its
    left leave enough of them for its right.
    """
    out = []
    for other in range(max(0, length - most), length + 1):
        k, delta = edits_allowed(other, most, per_edit), length - other
        if delta > k:
            continue
        for i, (at, size) in enumerate(segments(other, k)):
            low = max(0, at - i, at + delta - (k - i))
            high = min(length - size, at + i, at + delta + (k - i))
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def sketch(line: str) -> int:
    """Counts of the characters by code modulo 16, each modulo 16, in 16 half-bytes."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4") & 15
    counts = np.bincount(codes, minlength=16).astype(np.uint64) & np.uint64(15)
    return int((counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum())


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most twice the edit distance: an edit moves two counts by one, or one."""
    out = np.zeros(len(a), np.int64)
    for i in range(16):
        shift = np.uint64(4 * i)
        d = ((a >> shift) - (b >> shift)) & np.uint64(15)
        out += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return out


def edit_distance_within(a: str, b: str, k: int) -> int | None:
    """The edit distance if it is at most ``k``, else None.

    What both begin and end with is left out first.  The columns of the table are kept
    as differences in one machine word that slides along the diagonal, so ``k`` may be
    at most 31.
    """
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return None
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    end = 0
    while end < len(a) - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    if len(a) <= k:  # the band would be wider than the table
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        return row[-1] if row[-1] <= k else None
    # bit 63 - k + d of the word stands for row (column + d), d from -k to k
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    plus, minus, distance = (WORD << (63 - k)) & WORD, 0, k
    spare = len(b) - len(a)
    edge, last = 1 << 62, len(a) - k
    for j, c in enumerate(b):
        shift = 63 - k - j
        match = places.get(c, 0)
        match = (match << shift if shift >= 0 else match >> -shift) & WORD
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & WORD
        up = (minus | ~(diagonal | plus)) & WORD
        down = diagonal & plus
        if j < last:
            distance += not diagonal >> 63
        else:
            distance += bool(up & edge)
            distance -= bool(down & edge)
            edge >>= 1
        if distance > 2 * k + spare:
            return None
        half = diagonal >> 1
        plus = (down | ~(half | up)) & WORD
        minus = half & up
    return distance if distance <= k else None


def line_key(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def add_entries(line: bytes, key: int, most: int, per_edit: int, index: array, probe: array) -> None:
    """Append what a line is indexed by and what it is probed with: hashes of (length,
    segment number, characters), each with the line's key and character counts."""
    text = line.decode("utf-8", "replace")
    n, digest, own = len(text), xxhash.xxh3_64_intdigest, sketch(text)
    plain = len(line) == n
    cut = (lambda a, size: line[a : a + size]) if plain else (lambda a, size: text[a : a + size].encode("utf-8", "replace"))
    k = edits_allowed(n, most, per_edit)
    for i, (at, size) in enumerate(segments(n, k) if k else ()):
        index.extend((digest(cut(at, size), n << 6 | i), key, own))
    for other, i, at, size in probes_of(n, most, per_edit):
        probe.extend((digest(cut(at, size), other << 6 | i), key, own))


def probes_of(length: int, most: int, per_edit: int, known: dict = {}) -> list:  # noqa: B006
    """``probes`` for lengths whose lines allow edits at all, remembered."""
    got = known.get((length, most, per_edit))
    if got is None:
        got = [p for p in probes(length, most, per_edit) if edits_allowed(p[0], most, per_edit)]
        known[length, most, per_edit] = got
    return got


ENTRIES = pa.schema([("part", pa.int32()), ("probe", pa.bool_()), ("data", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def meetings(index: np.ndarray, probe: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different lines under a common key whose character counts allow at most
    ``most`` edits, at most ``CHUNK`` compared at once."""
    low = np.searchsorted(index["key"], probe["key"], side="left")
    high = np.searchsorted(index["key"], probe["key"], side="right")
    n = high - low
    probe, low, n = probe[n > 0], low[n > 0], n[n > 0]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, CHUNK):
        place = np.arange(at, min(at + CHUNK, total))
        who = np.searchsorted(ends, place, side="right")
        left, right = index[low[who] + place - (ends - n)[who]], probe[who]
        fit = (left["line"] != right["line"]) & (sketch_distance(left["sketch"], right["sketch"]) <= 2 * most)
        a, b = left["line"][fit], right["line"][fit]
        if len(a):
            yield np.minimum(a, b), np.maximum(a, b)


def candidates(docs: DataFrame, id_col: str, text_col: str, most: int, per_edit: int, docs_per_part: int) -> DataFrame:
    """Distinct pairs of line keys ``(a, b)`` that share a segment.

    Each task sends every line it holds once, in packed blocks by hash of the segment.
    """
    parts = max(8, docs.count() // docs_per_part)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            seen: set[bytes] = set()
            index, probes = array("Q"), array("Q")
            for data in table.column("data"):
                for line in lines_of(data.as_py()):
                    if line and line not in seen:
                        seen.add(line)
                        add_entries(line, line_key(line), most, per_edit, index, probes)
            for probe, rows in enumerate((index, probes)):
                packed = np.frombuffer(rows, ENTRY)
                part = (packed["key"] % np.uint64(parts)).astype(np.int64)
                packed = packed[np.argsort(part, kind="stable")]
                edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
                some = np.flatnonzero(np.diff(edges))
                blocks = [packed[edges[p] : edges[p + 1]].tobytes() for p in some]
                yield batch(ENTRIES, some.astype(np.int32), [bool(probe)] * len(some), blocks)

    def gather(rows: pa.Table) -> pa.Table:
        sides: tuple[list, list] = [], []
        for probe, data in zip(rows.column("probe").to_pylist(), rows.column("data")):
            sides[probe].append(np.frombuffer(data.as_buffer(), ENTRY))
        index, probe = (np.unique(np.concatenate(s)) if s else np.zeros(0, ENTRY) for s in sides)
        found = [np.unique(np.stack(p, 1), axis=0) for p in meetings(index, probe, most)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
        return pa.Table.from_batches([batch(PAIRS, pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64))])

    blocks = id_and_text(docs, id_col, text_col).mapInArrow(scatter, "part int, probe boolean, data binary")
    return blocks.groupBy("part").applyInArrow(gather, "a bigint, b bigint").distinct()


def membership_bits(keys: DataFrame, words: int = 1 << 18) -> np.ndarray:
    """A filter of fixed size: no key is missed, others may pass."""
    place = F.pmod("key", F.lit(64 * words))
    bits = keys.select((place / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(key, 64) AS int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


LINES = pa.schema([("key", pa.int64()), ("line", pa.string())])


def near_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, per_edit: int = 10, docs_per_part: int = 2000
) -> DataFrame:
    """Pairs of different lines ``(a, b, edits)`` within the edits that the shorter one
    allows: one for every ``per_edit`` characters, ``most`` at most.

    Pairs are found by 64-bit keys; lines that share a key are told apart by their text.
    """
    pairs = written(candidates(docs, id_col, text_col, most, per_edit, docs_per_part), "line-pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(membership_bits(keys))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for table in batches:
            found = {}
            for data in table.column("data"):
                for line in lines_of(data.as_py()):
                    if line:
                        key = np.array([line_key(line)], "<u8").view("<i8")[0]
                        place = int(key) % (64 * len(held))
                        if int(held[place >> 6]) >> (place & 63) & 1:
                            found[line] = int(key)
            yield batch(LINES, list(found.values()), [line.decode("utf-8", "replace") for line in found])

    lines = id_and_text(docs, id_col, text_col).mapInArrow(fetch, "key bigint, line string")
    lines = written(lines.join(keys, "key", "left_semi").distinct(), "candidate-lines")
    left, right = lines.toDF("a", "left"), lines.toDF("b", "right")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("edits", pa.int32())])
        for table in batches:
            rows = []
            for a, b in zip(table.column("left").to_pylist(), table.column("right").to_pylist()):
                edits = edit_distance_within(a, b, edits_allowed(min(len(a), len(b)), most, per_edit))
                if edits:
                    rows.append((min(a, b), max(a, b), edits))
            yield batch(schema, *(zip(*rows) if rows else [[]] * 3))

    met = pairs.join(left, "a").join(right, "b").select("left", "right")
    return met.mapInArrow(verify, "a string, b string, edits int").distinct()


def hashed(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line_no, hash)`` of every line, numbered from 0; an empty line has no hash."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "line")
    )
    line = F.btrim("line", F.lit(" \t\n\r\x0b\x0c"))
    return lines.select("id", "line_no", F.when(line != "", hashed(line)).alias("hash"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, line_no, hash, class_id, class_line, links, kept)`` of every line.

    Lines that are equal, or linked through pairs of ``near_lines``, form a class, named
    by its first place: the smallest id (nulls first), then line number.  The line there
    is kept.  ``links`` counts the different lines linked to this one.  Empty lines are
    kept and have no class.  Rows repeated in the table keep the same lines.
    """
    pairs = written(
        near_lines(docs, id_col, text_col, **options).select(hashed(F.col("a")).alias("a"), hashed(F.col("b")).alias("b")),
        "near-lines",
    )
    links = pairs.select(F.explode(F.array("a", "b")).alias("hash")).groupBy("hash").agg(F.count("*").alias("links"))
    numbered = written(links.withColumn("number", F.monotonically_increasing_id()), "linked-lines")
    ends = pairs.join(numbered.select(F.col("hash").alias("a"), F.col("number").alias("x")), "a").join(
        numbered.select(F.col("hash").alias("b"), F.col("number").alias("y")), "b"
    )
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = numbered.join(roots, numbered.number == roots.node, "left").select(
        "hash", "links", F.coalesce("root", "number").alias("root")
    )
    places = written(occurrences(docs, id_col, text_col), "line-places")
    # one row per distinct line; tasks reduce a common line to one row before the shuffle
    firsts = places.where("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("id", "line_no")).alias("first"))
    firsts = firsts.join(known, "hash", "left")
    roots_first = firsts.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("class_first"))
    named = firsts.join(roots_first, "root", "left").select(
        "hash", F.coalesce("class_first", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links")
    )
    out = places.join(named, "hash", "left")
    here = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
    return out.select(
        "id", "line_no", "hash", F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line"),
        F.when(F.col("hash").isNotNull(), F.coalesce("links", F.lit(0))).alias("links"), here.alias("kept"),
    )


def per_document(lines: DataFrame) -> DataFrame:
    """``(id, n_lines, n_kept, n_links)``: lines that are not empty, those kept, and the
    links of all of them."""
    full = F.col("hash").isNotNull()
    return lines.groupBy("id").agg(
        F.count(F.when(full, 1)).alias("n_lines"),
        F.count(F.when(full & F.col("kept"), 1)).alias("n_kept"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the lines that are kept, in their order and joined by line
    feeds, and all other columns; a null text stays null.

    A document's own list of dropped line numbers is joined to it, no longer than the
    document.
    """
    dropped = (
        line_classes(docs, id_col, text_col, **options)
        .where("NOT kept")
        .groupBy("id")
        .agg(F.collect_set("line_no").alias("_dropped"))
        .withColumnRenamed("id", "_line_id")
    )
    out = docs.join(dropped, docs[id_col].eqNullSafe(dropped["_line_id"]), "left")
    lines = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))),
        lambda s: ~F.coalesce(F.array_contains("_dropped", s["i"]), F.lit(False)),
    )
    return out.withColumn(text_col, F.array_join(F.transform(lines, lambda s: s["line"]), "\n")).select(*docs.columns)
