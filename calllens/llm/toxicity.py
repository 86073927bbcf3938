"""Toxicity by a weighted lexicon that is learned from labelled documents.

Texts are folded first: case, look-alike letters of other scripts, and digits or signs
that stand for letters inside a word.  Lexicon entries are whole words or beginnings of
words.  One Aho-Corasick pass finds all of them together with the exception phrases in
which an entry means no harm; what is left is weighed and normalised by the length.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import written

# Letters of other scripts that look like Latin ones, full-width forms,
# and characters that show nothing.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i",
    "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ſ": "s",
}
HIDDEN = "­͏​‌‍⁠﻿"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Phrases in which a word of abuse means a thing.
HARMLESS = ("trash can", "trash bin", "clown fish", "idiot proof")

FOLD = str.maketrans(
    LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
    | dict.fromkeys(HIDDEN, "")
)
#: Digits and signs inside words; i and l share their signs, so both become i.
UNMASK = str.maketrans(SUBSTITUTES | {"l": "i"})
EDGES = "!\"#%&'()*+,-./:;<=>?[\\]^_`{}~|…“”‘’«»¡¿"
PREFIXES = range(3, 9)


def folded_word(word: str) -> str:
    if word.isalpha():
        return word.replace("l", "i")
    core = word.strip(EDGES)
    if not any(map(str.isalpha, core)):
        return ""
    return "".join(c if c.isalpha() else " " for c in core.translate(UNMASK))


def folded(text: str) -> list[str]:
    """The words of the folded text; numbers and signs alone give none."""
    return " ".join(map(folded_word, text.lower().translate(FOLD).split())).split()


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: the id's crc32 is divisible by 5, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Lexicon:
    """Entries by pattern: `` word `` or the beginning `` wor``, each with its weight."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton, words: list[str]) -> dict[int, float]:
    """The greatest weight at each word that an entry matches outside exceptions, by the
    place of the blank before the word."""
    out: dict[int, float] = {}
    if not len(automaton) or not words:
        return out
    spared = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > out.get(start, 0.0):
            out[start] = weight
    if not spared:
        return out
    # stretches of exceptions that overlap become one, so one search tells each place
    starts, ends = [], []
    for a, b in sorted(spared):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return {s: w for s, w in out.items() if (i := bisect_right(starts, s)) == 0 or s >= ends[i - 1]}


def features(found: dict[int, float], n_words: int) -> tuple[float, float, float]:
    """Weight per word, weight by the root of the length, and weight alone."""
    total = sum(found.values())
    return total / (n_words + 10), total / math.sqrt(n_words + 10), math.log1p(total)


def entries_of(words: list[str]) -> set[str]:
    out = set()
    for word in set(words):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in PREFIXES if k < len(word))
    return out


def weigh(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Lower bound of the log odds ratio of an entry among toxic and clean documents."""
    odds = math.log((pos + 0.5) / (all_pos + 1) * (all_neg + 1) / (neg + 0.5))
    return odds - 1.64 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) - 1 / (all_pos + 1) - 1 / (all_neg + 1))


def select(counts: list[tuple[str, int, int]], all_pos: int, all_neg: int, most: int) -> dict[str, float]:
    """The entries of greatest weight; one that a beginning covers as well is left out."""
    weights = {t: w for t, p, n in counts if p >= max(3, 0.003 * all_pos) and (w := weigh(p, n, all_pos, all_neg)) > 1}
    best = sorted(weights, key=lambda t: (-weights[t], t))[:most]
    kept = set(best)

    def covered(entry: str) -> bool:
        return any(weights[entry[: k + 1]] >= weights[entry] for k in PREFIXES if entry[: k + 1] in kept and k + 1 < len(entry))

    return {t: weights[t] for t in best if not covered(t)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """Means, scales and coefficients (the last is the constant) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    beta, keep = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep * len(x)), a.T @ (y - p) - keep * len(x) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        a = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        return 1 / (1 + np.exp(-np.clip(a @ self.beta, -30, 30)))


def labelled_sample(docs, labels, id_col, text_col, label_col, max_rows) -> DataFrame:
    """At most about ``max_rows`` labelled rows that may be learned from, chosen by a hash."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where(F.col("y").isNotNull() & ~is_held_out(F.col("id")))
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # no larger than max_rows ids and labels
    return texts.join(F.broadcast(chosen), "id").select(
        "text", "y", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    )


COUNTS = pa.schema([("term", pa.string())] + [(c, pa.int64()) for c in ("n00", "n01", "n10", "n11")])
COUNT_SCHEMA = "term string, n00 bigint, n01 bigint, n10 bigint, n11 bigint"


def count_entries(sample: DataFrame, entries) -> DataFrame:
    """Documents with each entry by half of the sample and label; every task adds up its
    batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            tables = [[Counter(), Counter()], [Counter(), Counter()]]
            for text, y, fold in zip(*(table.column(c).to_pylist() for c in ("text", "y", "fold"))):
                tables[fold][y].update(entries(folded(text)))
            flat = [c for pair in tables for c in pair]
            terms = sorted(set().union(*flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in flat)], schema=COUNTS
            )

    counted = sample.mapInArrow(count, COUNT_SCHEMA)
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS.names[1:]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    max_entries: int = 4000,
    exceptions: tuple[str, ...] = HARMLESS,
) -> ToxicityModel:
    """Learn the lexicon, its exceptions and the scale of the score.

    Fitted on at most about ``max_rows`` labelled rows, none of them held out; the model
    has at most ``max_entries`` entries.  Each half of the sample is scored with the
    lexicon of the other to fit the scale.  A phrase of two words around an entry that
    clean documents use at least as readily as toxic ones becomes an exception.  Without
    toxic or without clean rows the score is constant, the share of toxic rows.
    """
    sample = written(labelled_sample(docs, labels, id_col, text_col, label_col, max_rows), "toxicity-sample")
    sizes = {(r.fold, r.y): r.n for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n = [[sizes.get((f, y), 0) for y in (0, 1)] for f in (0, 1)]
    clean, toxic = n[0][0] + n[1][0], n[0][1] + n[1][1]
    given = tuple(" ".join(folded(p)) for p in exceptions)
    if not clean or not toxic:
        odds = 30.0 if toxic else -30.0
        return ToxicityModel(Lexicon({}, given), np.zeros(3), np.ones(3), np.array([0, 0, 0, odds]))
    useful = count_entries(sample, entries_of).where(
        f"n01 + n11 >= {max(3, math.ceil(0.003 * toxic))} AND (n01 + n11 + 0.5) * {clean + 1} > (n00 + n10 + 0.5) * {toxic + 1} * 2"
    )
    # a bounded sample has a bounded number of entries
    counts = [tuple(r) for r in useful.collect()]
    half = [
        select([(t, c[f][1], c[f][0]) for t, *v in counts if (c := (v[:2], v[2:]))], n[f][1], n[f][0], max_entries) for f in (0, 1)
    ]
    weights = select([(t, b + d, a + c) for t, a, b, c, d in counts], toxic, clean, max_entries)

    plain = Lexicon(weights, given)

    def phrases(words: list[str]) -> set[str]:
        places = {}
        at = 0
        for i, word in enumerate(words):
            places[at] = i
            at += len(word) + 1
        out = set()
        for start in hits(plain.automaton_held, words):
            i = places[start]
            out.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a and a + 2 <= len(words))
        return out

    def with_automaton(words: list[str]) -> set[str]:
        if not hasattr(plain, "automaton_held"):
            plain.automaton_held = plain.automaton()
        return phrases(words)

    spared = count_entries(sample, with_automaton).where(
        f"n00 + n10 >= 3 AND (n00 + n10) * {toxic} >= (n01 + n11) * {clean}"
    )
    learned = tuple(sorted(r.term for r in spared.collect()))
    lexicons = [Lexicon(w, given + learned) for w in half]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [lexicon.automaton() for lexicon in lexicons]
        schema = pa.schema([(c, pa.float64()) for c in ("a", "b", "c", "y")])
        for table in batches:
            rows = []
            for text, y, fold in zip(*(table.column(c).to_pylist() for c in ("text", "y", "fold"))):
                words = folded(text)
                rows.append((*features(hits(machines[1 - fold], words), len(words)), y))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * 4, schema=schema)

    # four numbers for each row of the bounded sample
    seen = np.array([tuple(r) for r in sample.mapInArrow(measure, "a double, b double, c double, y double").collect()])
    return ToxicityModel(Lexicon(weights, given + learned), *fit_logistic(seen[:, :3], seen[:, 3]))


SCORES = pa.schema([("id", pa.int64()), ("hits", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hits, score)`` per row: words that entries match, and the score from 0 to 1.

    Only the text is read.  Null and empty texts are scored as texts without hits.  Of
    entries that match at one place the heaviest counts; of equal ones it makes no
    difference.  Ids are whole numbers or null; rows repeated in the table are repeated in
    the result, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.lexicon.automaton()
        for table in batches:
            found, n, x = [], [], []
            for text in table.column("text"):
                words = folded(text.as_py())
                found.append(hits(machine, words))
                x.append(features(found[-1], len(words)))
            if x:
                yield pa.RecordBatch.from_arrays(
                    [table.column("id"), pa.array(list(map(len, found)), pa.int64()), pa.array(model.scores(np.array(x)))],
                    schema=SCORES,
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id bigint, hits bigint, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5, **options) -> DataFrame:
    """The rows whose score is below ``at``, with all their columns.

    The score is computed in the row, so rows need no join back to their text.
    """
    model = train(docs, labels, id_col, text_col, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.lexicon.automaton()
        place = None
        for table in batches:
            place = table.schema.get_field_index(text_col) if place is None else place
            x = []
            for text in table.column(place):
                words = folded(text.as_py() or "")
                x.append(features(hits(machine, words), len(words)))
            if x:
                yield table.filter(pa.array(model.scores(np.array(x)) < at))

    return docs.mapInArrow(keep, docs.schema)
