"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams by rank.  A document gets the
same kind of profile, and its distance to a language is the sum, over its n-grams, of
how far each is out of place there; an n-gram the language does not list counts as
much as the profile is long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blanks, digits and signs: what stands between words.
GAPS = re.compile(r"[\W\d_]+")
SIZES = (1, 2, 3)
UNDETERMINED = "und"
#: Characters of a text that are counted at once.
PIECE = 1 << 20


def is_held_out(doc_id: Column) -> Column:
    """Rows that no profile learns from: crc32 of the id leaves 1 by 3, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def ngram_counts(text: str, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams (up to 3 characters, 21 bits each) and their counts.

    Words are runs of letters in lower case with a blank on each side; no n-gram spans
    two words or is a blank alone.
    """
    words = GAPS.sub(" ", text.lower()).strip()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    parts, counts = [], []
    for at in range(0, len(codes), PIECE):
        # the last characters come again in the next piece, where their n-grams begin
        piece = codes[at : at + PIECE + max(sizes) - 1]
        keys = []
        for n in sizes:
            m = min(len(piece) - n + 1, PIECE)
            if m <= 0:
                continue
            key, fit = np.zeros(m, np.int64), np.ones(m, bool)
            for k in range(n):
                key |= piece[k : k + m] << 21 * k
                if n == 1 or 0 < k < n - 1:
                    fit &= piece[k : k + m] != 32
            keys.append(key[fit])
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        parts.append(found)
        counts.append(times)
    if len(parts) == 1:
        return parts[0], counts[0]
    found, where = np.unique(np.concatenate(parts), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def most_frequent(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The keys by falling count, equal counts by key."""
    return keys[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class LanguageProfiles:
    languages: list[str]
    keys: np.ndarray  # every listed n-gram, sorted
    ranks: np.ndarray  # its rank in each language, `length` where it is not listed
    length: int

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, from 0 (equal) to 1 (nothing shared)."""
        if not len(self.keys) or not len(ranked):
            return np.ones(len(self.languages))
        at = np.minimum(np.searchsorted(self.keys, ranked), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == ranked)[:, None], self.ranks[at], self.length)
        apart = np.where(ranks < self.length, np.abs(ranks - np.arange(len(ranked))[:, None]), self.length)
        return apart.sum(0) / (self.length * len(ranked))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how much nearer it is than the next (0 to 1)."""
        # superscripts and the like are neither blanks nor digits, but no letters either
        if not self.languages or not any(map(str.isalpha, text or "")):
            return UNDETERMINED, 0.0
        ranked = most_frequent(*ngram_counts(text), self.length)
        apart = self.distances(ranked)
        order = np.argsort(apart, kind="stable")
        if len(order) == 1:
            return self.languages[0], float(1 - apart[0])
        first, second = apart[order[0]], apart[order[1]]
        return self.languages[order[0]], float((second - first) / second) if second else 0.0


GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    length: int = 400,
    max_docs: int = 2000,
    max_languages: int = 200,
) -> LanguageProfiles:
    """A profile for each language of the rows that may be learned from.

    Fitted on whole texts of at most about ``max_docs`` rows per language, chosen by a
    hash of the id, and on the ``max_languages`` languages of most rows (ties: the first
    by name).  Rows without text or language teach nothing, rows repeated in the table
    teach each time, and an empty table teaches no language.  The driver receives
    ``length`` n-grams per language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("id")))
    # a row for each of at most max_languages, with the share of its rows to learn from
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_languages)
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("rows")).alias("share"))
    chosen = rows.join(F.broadcast(shares), "lang").where(
        F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            held: dict[str, list] = {}
            for text, lang in zip(table.column("text"), table.column("lang").to_pylist()):
                held.setdefault(lang, []).append(ngram_counts(text.as_py()))
            for lang, parts in held.items():
                grams, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], schema=GRAMS
                )

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    )
    top = ranked.where(F.col("rank") < length).select("lang", "gram", "rank").collect()
    languages = sorted({r.lang for r in top})
    keys = np.array(sorted({r.gram for r in top}), np.int64)
    ranks = np.full((len(keys), len(languages)), length, np.int64)
    for r in top:
        ranks[np.searchsorted(keys, r.gram), languages.index(r.lang)] = r.rank
    return LanguageProfiles(languages, keys, ranks, length)


PREDICTED = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, profiles: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row; only the text is read.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when
    no language was learned.  Of languages equally near the first by name is taken.  Ids
    are whole numbers; rows repeated in the table are repeated in the result, and an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            found = [profiles.predict(text.as_py()) for text in table.column("text")]
            yield pa.RecordBatch.from_arrays(
                [table.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=PREDICTED,
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, lang_pred string, score double")
