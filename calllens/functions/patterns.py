"""Token pattern matching over bound token arrays."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.functions.arrays import let, positions
from calllens.lexicons import pattern_phrases


def spans(toks: Column, patterns) -> Column:
    """Every match as ``struct<start, n>``, ordered; overlapping matches all count.

    The patterns are expanded to phrases once, on the driver.  Only positions
    holding the first word of a phrase are looked at, through hashed sets.
    """
    by_length: dict[int, list[str]] = defaultdict(list)
    for n, phrase in pattern_phrases(patterns):
        by_length[n].append(phrase)

    def at(n: int, starts: Column) -> Column:
        phrases = by_length[n]
        hits = F.filter(
            starts,
            lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(n)]).isin(*phrases),
        )
        return F.transform(
            hits, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"))
        )

    first_words = sorted({p.split(" ")[0] for group in by_length.values() for p in group})
    starts = F.filter(positions(toks), lambda i: F.get(toks, i).isin(*first_words))
    return let(
        starts,
        lambda st: F.sort_array(F.concat(*[at(n, st) for n in sorted(by_length)])),
    )


def span_text(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def window_bounds(start: Column, n: Column, size: Column, k: int) -> tuple[Column, Column]:
    """``(first index, length)`` of the span widened by ``k`` tokens, cut to the text."""
    lo = F.greatest(start - k, F.lit(0))
    hi = F.least(start + n + k, size)
    return lo, hi - lo
