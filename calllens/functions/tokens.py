"""Tokens, sentences and n-grams as array columns of the transcript row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.functions.arrays import let

WORD = r"[\p{L}\p{N}_']+"
# Fixed value: the characters that Unicode calls white space, and four ASCII separators.
# The visible ASCII characters are ruled out by one test, as most characters are such.
BLANK = r"[[^!-~]&&[\p{IsWhite_Space}\x1c-\x1f]]"
# Plain letters first: the tests of a class run in order.
NOT_WORD = r"[^[a-z][\p{L}\p{N}_']]+"
SENTENCE_END = r"([.!?]+)(\s+|$)"
BREAK = "\u0001"


def words(c: Column) -> Column:
    """Words in their original case; an apostrophe stays inside its word."""
    return F.array_remove(F.split(c, NOT_WORD), "")


def tokens(c: Column) -> Column:
    return words(F.lower(c))


def tokens_of(text: str) -> list[str]:
    """The same tokens of a name or search term held on the driver."""
    return re.findall(r"[\w']+", text.lower())


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def whitespace_words(c: Column) -> Column:
    return F.filter(F.split(c, BLANK + "+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Trimmed non-empty pieces ending in ``.``, ``!`` or ``?`` before a blank."""
    marked = F.regexp_replace(c, SENTENCE_END, "$1" + BREAK)
    pieces = F.transform(F.split(marked, BREAK), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s != "")


def ngrams(toks: Column, n: int) -> Column:
    """Space-joined n-grams of a bound token array, in order."""
    if n == 1:
        return toks
    heads = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(0)))
    return F.transform(
        heads,
        lambda t, i: F.concat_ws(" ", t, *[F.get(toks, i + k) for k in range(1, n)]),
    )


def ngrams_upto(toks: Column, n_max: int) -> Column:
    return let(toks, lambda t: F.concat(*[ngrams(t, n) for n in range(1, n_max + 1)]))


def sentence_ngrams(c: Column, n: int) -> Column:
    """N-grams that do not cross a sentence end, in text order."""
    return F.flatten(
        F.transform(sentences(c), lambda s: let(tokens(s), lambda t: ngrams(t, n)))
    )


def candidate_phrases(c: Column, stop_words, min_words: int, min_chars: int) -> Column:
    """Maximal runs of words free of stop words and punctuation, in text order.

    Stands in for noun chunks; ``min_chars`` is exclusive.
    """
    # punctuation and stop words become "|", the runs lie between
    spaced = F.regexp_replace(F.lower(c), r"[^[a-z ][\p{L}\p{N}_'\s]]+", " | ")
    marked = F.transform(
        F.split(spaced, r"\s+"), lambda w: F.when(w.isin(*stop_words), F.lit("|")).otherwise(w)
    )
    # no blank is left beside a bar, and none but single ones elsewhere
    runs = F.split(F.trim(F.array_join(marked, " ")), r" *+\|[ |]*+")
    return F.filter(
        runs, lambda r: F.contains(r, F.lit(" ")) & (F.length(r) > min_chars)
    ) if min_words == 2 else F.filter(
        runs, lambda r: (F.size(F.split(r, " ")) >= min_words) & (F.length(r) > min_chars)
    )
