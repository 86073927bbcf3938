"""Benchmark decontamination with a distributed positional inverted index.

Tasks cut their documents into segments of a bounded number of words and write each
segment's postings: one row per term with the term's places in the segment, so a list
tells document and position at once.  The windows of the benchmark are rows too: each is
joined to the segments that hold its rarest term.  There the places of its rarest term,
less the term's offset, are intersected with those of its next rarest terms until none is
left or all terms agree.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import few, written
from calllens.llm.words import alnum_words, batch, id_and_text

POSTINGS = pa.schema(
    [
        ("segment", pa.int64()),
        ("term", pa.binary()),  # null: the segment's documents
        ("documents", pa.int32()),
        ("places", pa.int64()),
        ("data", pa.binary()),
    ]
)


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low first; also where each value's bytes end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        low = (values[here] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[here] - size[here] + k] = low | np.where(size[here] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        here = np.flatnonzero(last - first >= k)
        out[here] |= (raw[first[here] + k].astype(np.int64) & 127) << (7 * k)
    return out


def pack_documents(ids: list, sizes: list[int]) -> bytes:
    lost = np.array([d is None for d in ids], "u1")
    known = np.array([d or 0 for d in ids], "<i8")
    return struct.pack("<I", len(ids)) + known.tobytes() + np.array(sizes, "<i8").tobytes() + lost.tobytes()


def unpack_documents(data: bytes) -> tuple[list, np.ndarray]:
    (m,) = struct.unpack_from("<I", data)
    ids, sizes = np.frombuffer(data, "<i8", m, 4), np.frombuffer(data, "<i8", m, 4 + 8 * m)
    lost = np.frombuffer(data, "u1", m, 4 + 16 * m)
    return [None if x else int(d) for d, x in zip(ids, lost)], sizes


def segment_rows(segment: int, vocabulary: dict, parts: list[np.ndarray], ids: list) -> pa.RecordBatch:
    sizes = [len(p) for p in parts]
    terms = sorted(vocabulary)
    rank = np.empty(len(terms), np.int64)
    rank[[vocabulary[t] for t in terms]] = np.arange(len(terms))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    # one sort of (term, place) pairs held in single integers
    keys = np.sort(rank[words] << 32 | np.arange(len(words), dtype=np.int64))
    term, place = keys >> 32, keys & 0xFFFFFFFF
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(place, prepend=0)
    gaps[starts] = place[starts]
    data, ends = varint(gaps)
    doc = np.searchsorted(np.cumsum(sizes), place, side="right")
    new = np.diff(doc, prepend=-1) != 0
    new[starts] = True
    docs = np.add.reduceat(new.astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    places = np.diff(np.append(starts, len(words)))
    edges = np.append(np.where(starts > 0, ends[starts - 1], 0), len(data)).astype(np.int32)
    table = pack_documents(ids, sizes)
    column = pa.BinaryArray.from_buffers(
        pa.binary(), len(terms), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(terms) + 1, segment)),
            pa.array([None, *terms], pa.binary()),
            pa.array(np.concatenate(([len(ids)], docs)).astype(np.int32)),
            pa.array(np.concatenate(([len(words)], places)).astype(np.int64)),
            pa.concat_arrays([pa.array([table], pa.binary()), column]),
        ],
        schema=POSTINGS,
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 1 << 21) -> DataFrame:
    """Postings of every word of every document, stored in the shared folder.

    ``(segment, term, documents, places, data)``; the row of a segment without a term
    lists its documents.  A segment is closed at the document with which it reaches
    ``segment_words``.  A null text has no words but is listed; an empty table gives
    an empty index.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        numbers, parts, ids, size = defaultdict(count().__next__), [], [], 0
        for table in batches:
            for name, data in zip(table.column("id").to_pylist(), table.column("data")):
                words = alnum_words(data.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(name)
                size += len(words)
                if size >= segment_words:
                    yield segment_rows(part << 32 | seq, numbers, parts, ids)
                    seq += 1
                    numbers, parts, ids, size = defaultdict(count().__next__), [], [], 0
        if ids:
            yield segment_rows(part << 32 | seq, numbers, parts, ids)

    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return written(
        rows.mapInArrow(index, "segment bigint, term binary, documents int, places bigint, data binary"), "postings"
    )


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words)``: each distinct window of each item; an item of fewer words is one
    window, one without words none."""
    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for item, data in zip(table.column("id").to_pylist(), table.column("data")):
                words = alnum_words(data.as_py())
                width = min(window, len(words))
                for at in range(0, len(words) - width + 1 if words else 0, 1 << 14):
                    found = [words[i : i + width] for i in range(at, min(at + (1 << 14), len(words) - width + 1))]
                    yield batch(schema, [item] * len(found), found)

    rows = id_and_text(benchmark, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return rows.mapInArrow(cut, "item string, words array<binary>").distinct()


def exact_starts(phrase: tuple, lists: dict, rarity: dict) -> np.ndarray:
    """Places where the phrase begins: offset-adjusted lists, the rarest term first."""
    starts = None
    for offset in sorted(range(len(phrase)), key=lambda i: (rarity[phrase[i]], phrase[i], i)):
        have = lists.get(phrase[offset])
        if have is None:
            return np.zeros(0, np.int64)
        if starts is None:
            starts = have - offset
        else:
            at = np.searchsorted(have, starts + offset)
            starts = starts[(at < len(have)) & (have[np.minimum(at, len(have) - 1)] == starts + offset)]
        if not len(starts):
            break
    return starts[starts >= 0] if starts is not None else np.zeros(0, np.int64)


def near_spans(phrase: tuple, lists: dict, rarity: dict, slop: int) -> list[tuple[int, int]]:
    """Spans of at most ``len(phrase) + slop`` words that hold every term of the phrase
    as often as the phrase does, in any order; the shortest from each first word."""
    width, need = len(phrase) + slop, defaultdict(int)
    for word in phrase:
        need[word] += 1
    order = sorted(need, key=lambda w: (rarity[w], w))
    if any(w not in lists for w in order):
        return []
    around = lists[order[0]]
    for word in order[1:]:
        have = lists[word]
        low = np.searchsorted(have, around - width, side="right")
        around = around[np.searchsorted(have, around + width) > low]
        if not len(around):
            return []
    spans = set()
    for p in around.tolist():
        hits = sorted(
            (q, w) for w in order for q in lists[w][slice(*np.searchsorted(lists[w], [p - width + 1, p + width]))].tolist()
        )
        for i, (first, _) in enumerate(hits):
            left = dict(need)
            missing = len(phrase)
            for q, w in hits[i:]:
                if q - first >= width:
                    break
                if left[w] > 0:
                    left[w] -= 1
                    missing -= 1
                if not missing:
                    spans.add((first, q + 1))
                    break
    return sorted(spans)


MATCHES = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int64()),
        ("doc_id", pa.int64()),
        ("item_id", pa.string()),
        ("kind", pa.string()),
        ("first_word", pa.int64()),
        ("end_word", pa.int64()),
    ]
)
MATCH_SCHEMA = (
    "segment bigint, ordinal bigint, doc_id bigint, item_id string, kind string, first_word bigint, end_word bigint"
)


def candidates(index: DataFrame, windows: DataFrame, most_sent: int) -> tuple[DataFrame, DataFrame]:
    """Where windows may occur: ``(segment, words, item)`` of each window and each segment
    that holds its rarest term, and the terms ``(term)`` of all of them.

    A window with a term that no document holds is left out.  Every join is by term or
    window, so the benchmark may be as large as the corpus; sides that are few are sent.
    """
    distinct = windows.select("words").distinct()
    terms = few(written(distinct.select(F.explode("words").alias("term")).distinct(), "benchmark-terms"), most_sent)
    held = written(index.select("segment", "term", "places").join(terms, "term", "left_semi"), "benchmark-postings")
    counts = few(written(held.groupBy("term").agg(F.sum("places").alias("n")), "term-counts"), most_sent)
    each = distinct.select("words", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term", "left")
    rated = each.groupBy("words").agg(F.min(F.struct("n", "term")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("lost"))
    live = written(rated.where("lost = 0").select("words", F.col("rarest.term").alias("term")), "live-windows")
    seeds = held.select("segment", "term").join(few(live, most_sent), "term").join(few(windows, most_sent), "words")
    return seeds.select("segment", "words", "item"), live.select(F.explode("words").alias("term")).distinct()


def search(index: DataFrame, windows: DataFrame, slop: int | None, most_sent: int) -> DataFrame:
    """Matches of the windows, segment by segment."""
    seeds, terms = candidates(index, windows, most_sent)
    lists = index.where("term IS NULL").unionByName(index.join(few(written(terms, "live-terms"), most_sent), "term", "left_semi"))

    def look(wanted: pa.Table, segment_rows: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.Table.from_batches([batch(MATCHES, *[[]] * len(MATCHES))])
        names, sizes, lists = [], np.zeros(0, np.int64), {}
        segment = segment_rows.column("segment")[0].as_py()
        for term, data in zip(segment_rows.column("term"), segment_rows.column("data")):
            if term.as_py() is None:
                names, sizes = unpack_documents(data.as_py())
            else:
                lists[term.as_py()] = np.cumsum(unvarint(data.as_py()))
        items: dict[tuple, set] = defaultdict(set)
        for words, item in zip(wanted.column("words").to_pylist(), wanted.column("item").to_pylist()):
            items[tuple(words)].add(item)
        rarity = {word: len(places) for word, places in lists.items()}
        ends = np.cumsum(sizes)
        spans: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for phrase, owners in items.items():
            if any(w not in rarity for w in phrase):
                continue
            starts = exact_starts(phrase, lists, rarity)
            pairs = [("exact", a, a + len(phrase)) for a in starts.tolist()]
            if slop is not None:
                told = {(a, b) for _, a, b in pairs}
                pairs += [("near", a, b) for a, b in near_spans(phrase, lists, rarity, slop) if (a, b) not in told]
            for kind, a, b in pairs:
                doc = int(np.searchsorted(ends, a, side="right"))
                if b <= ends[doc]:  # not across two documents
                    for owner in owners:
                        spans[doc, owner, kind].append((a - int(ends[doc] - sizes[doc]), b - int(ends[doc] - sizes[doc])))
        rows = []
        for (doc, owner, kind), held_spans in spans.items():
            for a, b in joined(held_spans):
                rows.append((segment, doc, names[doc], owner, kind, a, b))
        return pa.Table.from_batches([batch(MATCHES, *(zip(*rows) if rows else [[]] * len(MATCHES)))])

    return seeds.groupBy("segment").cogroup(lists.groupBy("segment")).applyInArrow(look, MATCH_SCHEMA)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(
    index: DataFrame,
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = 10,
    slop: int | None = 3,
    most_sent: int = 100_000,
) -> DataFrame:
    """Where benchmark windows occur: ``(segment, ordinal, doc_id, item_id, kind,
    first_word, end_word)``, windows of one item that touch as one span.

    ``kind`` is ``exact`` for consecutive words, or ``near`` for a span of at most
    ``slop`` more words with the window's words in any order (``slop=None``: exact
    only).  A window has ``window`` words; an item of fewer is one window, one without
    words none.  Items of equal id count as one item.  A segment is sent the windows
    whose rarest term it holds, so the index is passed over a fixed number of times
    however large the benchmark is.  Terms and windows are sent to the tasks while there
    are at most ``most_sent`` of them, and joined by shuffles beyond.
    """
    windows = written(benchmark_windows(benchmark, id_col, text_col, window), "benchmark-windows")
    return written(search(index, windows, slop, most_sent), "phrase-matches")


CONTAMINATION = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items", pa.list_(pa.string())),
    ]
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    **options,
) -> DataFrame:
    """One row per document: ``(id, n_words, n_hit, n_items, items)``.

    ``n_hit`` counts the words inside occurrences of benchmark windows, ``items`` the
    items they belong to, sorted as strings.  An item without an id hits words but is
    not listed.  Rows repeated in the table are repeated in the result, and a null
    text has no words.
    """
    index = build_index(docs, id_col, text_col)
    hits = matches(index, benchmark, item_col, item_text_col, window, slop=None, **options)

    def tell(key, documents: pa.Table, hits: pa.Table) -> pa.Table:
        spans, items = defaultdict(list), defaultdict(set)
        for doc, item, a, b in zip(*(hits.column(c).to_pylist() for c in ("ordinal", "item_id", "first_word", "end_word"))):
            spans[doc].append((a, b))
            items[doc].add(item)
        rows = []
        for data in documents.column("data").to_pylist():
            for doc, (name, size) in enumerate(zip(*unpack_documents(data))):
                own = sorted(items[doc] - {None}) if doc in items else []
                rows.append((name, int(size), sum(b - a for a, b in joined(spans.get(doc, []))), len(own), own))
        return pa.Table.from_batches([batch(CONTAMINATION, *(zip(*rows) if rows else [[]] * 5))])

    documents = index.where("term IS NULL").select("segment", "data")
    return documents.groupBy("segment").cogroup(hits.where("kind = 'exact'").groupBy("segment")).applyInArrow(
        tell, "id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    Of rows that share an id, all go if any is hit.
    """
    hit = contamination(docs, benchmark, id_col, **options).where("n_hit > 0").select(F.col("id").alias("_hit")).distinct()
    return docs.join(hit, docs[id_col].cast("bigint").eqNullSafe(hit["_hit"]), "left_anti")


