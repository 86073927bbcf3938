"""Short license notices, found with a bounded number of edits.

A notice cut into one piece more than the edits allowed keeps at least one piece
unchanged.  All pieces of all notices are found in one Aho-Corasick pass; around each,
the regex library checks the whole notice with its limit on errors and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens.llm.words import alnum_words, batch, id_and_text

# The exact phrases, and the notices that are searched with edits.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)


def edits_allowed(notice: str, rate: float, most: int) -> int:
    """Edits per character up to ``most``, so that the pieces of long notices stay long
    enough to be rare."""
    return min(most, int(len(notice) * rate))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def phrase_places(text: str, phrase: str) -> list[int]:
    """Where the phrase's words stand, by character of the blank-padded text."""
    out, at = [], text.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = text.find(f" {phrase} ", at + 1)
    return out


class NoticeFinder:
    """Searches one text for all phrases and notices; built once per task."""

    def __init__(self, phrases, notices, rate: float = 0.12, most: int = 4):
        import ahocorasick
        import regex

        self.phrases, self.notices, self.seeds = phrases, notices, ahocorasick.Automaton()
        self.edits = [edits_allowed(n, rate, most) for n, _ in notices]
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for (n, _), k in zip(notices, self.edits)
        ]
        places: dict[str, list] = {}
        for number, (notice, _) in enumerate(notices):
            for offset, piece in pieces(notice, self.edits[number]):
                places.setdefault(piece, []).append((number, offset))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        if places:
            self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """Stretches of the text that may hold a notice: one around each unchanged piece,
        no longer than the notice and its edits."""
        out: dict[int, set[tuple[int, int]]] = {}
        if not len(self.seeds):
            return out
        for end, (size, where) in self.seeds.iter(text):
            for number, offset in where:
                k, length = self.edits[number], len(self.notices[number][0])
                begin = end - size + 1 - offset
                out.setdefault(number, set()).add((max(0, begin - k), min(len(text), begin + length + k)))
        return out

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(start, end, notice, edits)``: again and again the find with the fewest edits
        for its length, of equal ones the longer, then the earlier notice, that overlaps
        none before it.

        Every find keeps a piece unchanged, so it lies in the stretch around that piece.  A
        pattern gives the best place of a stretch; what is left of the stretch beside that
        place, or beside a better find that overlaps it, is searched again.  Stretches are
        short, so the work grows with their number, however many finds a text has.
        """
        todo: list[tuple] = []
        looked: set[tuple[int, int, int]] = set()

        def look(number: int, a: int, b: int) -> None:
            if b - a < len(self.notices[number][0]) - self.edits[number] or (number, a, b) in looked:
                return
            looked.add((number, a, b))
            if match := self.patterns[number].search(text, a, b):
                start, end, edits = match.start(), match.end(), sum(match.fuzzy_counts)
                heappush(todo, (edits / len(self.notices[number][0]), start - end, number, start, end, edits, a, b))

        for number, spans in self.windows(text).items():
            for a, b in sorted(spans):
                look(number, a, b)
        kept: list[tuple[int, int, int, int]] = []  # by place, none overlaps another
        while todo:
            _, _, number, start, end, edits, a, b = heappop(todo)
            at = bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, number, edits))
            at = max(0, bisect_left(kept, (a,)) - 1)
            while at < len(kept) and kept[at][0] < b:
                look(number, a, min(b, kept[at][0]))
                a = max(a, kept[at][1])
                at += 1
            look(number, a, b)
        return kept

    def search(self, data: bytes) -> tuple[int, list[tuple[str, str, int, int, int]]]:
        """Number of words, and ``(kind, label, first word, last word, edits)`` of each
        exact phrase and fuzzy notice."""
        words = alnum_words(data)
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "
        exact = [(at, phrase.count(" "), label) for phrase, label in self.phrases for at in phrase_places(text, phrase)]
        fuzzy = self.fuzzy(text)
        if not exact and not fuzzy:
            return len(words), []
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4") == 32)
        before = lambda place: int(np.searchsorted(blanks, place))  # noqa: E731  blanks in front of a place
        spans = []
        for at, size, label in exact:
            spans.append(("exact", label, before(at), before(at) + size, 0))
        for a, b, number, edits in fuzzy:
            # whole words: from the word that holds the first letter to that of the last
            first = before(a + (text[a] == " ") + 1) - 1
            last = before(b - (text[b - 1] == " ")) - 1
            spans.append(("fuzzy", self.notices[number][1], first, last, edits))
        return len(words), spans

    def similarity(self, label: str, edits: int) -> float:
        sizes = [len(n) for n, own in self.notices if own == label]
        return 1 - edits / max(sizes) if sizes else 1.0


SPANS = "array<struct<kind: string, label: string, first_word: bigint, last_word: bigint, edits: int>>"
FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()),
                                      ("last_word", pa.int64()), ("edits", pa.int32())]))),
        ("score", pa.float64()),
    ]
)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases=BASE_PHRASES,
    notices=NOTICES,
    rate: float = 0.12,
    most: int = 4,
) -> DataFrame:
    """One row per document: ``(id, n_words, spans, score)``.

    ``spans`` holds every place of an exact phrase and every notice found with at most
    ``rate`` edits per character and ``most`` edits, by words counted from 0.  ``score`` is 1 for an exact
    phrase, else the share of the best notice that is unchanged, and 0 without any.  A
    null text has no words.  Of finds that overlap, the one with fewer edits for its length
    stays, then the longer, then the earlier notice.  Ids are whole numbers or null; rows
    repeated in the table are repeated in the result, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(phrases, notices, rate, most)
        for table in batches:
            counts, spans, scores = [], [], []
            for data in table.column("data"):
                n, found = finder.search(data.as_py())
                counts.append(n)
                spans.append([dict(zip(("kind", "label", "first_word", "last_word", "edits"), s)) for s in found])
                scores.append(max((finder.similarity(label, e) for _, label, _, _, e in found), default=0.0))
            yield batch(FOUND, table.column("id"), counts, spans, scores)

    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return rows.mapInArrow(run, f"id bigint, n_words bigint, spans {SPANS}, score double")


def digest(found: DataFrame) -> DataFrame:
    """The counts and labels of each document's spans."""
    base = F.filter("spans", lambda s: s["kind"] == "exact")
    firsts = F.transform(base, lambda s: s["first_word"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )
