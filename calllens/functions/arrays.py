"""Small array helpers; everything stays inside one row, so nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain reference would be copied into every lambda that uses it and be
    evaluated again for each array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(arr: Column) -> Column:
    """``[0, 1, .., n-1]``."""
    return F.transform(arr, lambda _, i: i)


def run_lengths(arr: Column) -> Column:
    """Distinct elements with their counts, ``array<struct<term, n>>`` ordered by term.

    Sorting brings equal elements together, so counting needs no shuffle.
    """

    def counted(s: Column) -> Column:
        starts = F.filter(
            positions(s), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, k + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(arr), counted)


def first_distinct(arr: Column, k: int | None) -> Column:
    """Order-preserving de-duplication, first ``k`` kept."""
    unique = F.array_distinct(arr)
    return unique if k is None else F.slice(unique, 1, k)


def rows_of(arr: Column, value: str, pos: str | None = None) -> Column:
    """Generator with one row per element (and its position).

    Unlike ``explode``, ``inline`` gets no inferred "array is not empty" filter,
    which would compute an expensive array a second time below the generator.
    """
    if pos is None:
        return F.inline(F.transform(arr, lambda x: F.struct(x.alias(value))))
    return F.inline(F.transform(arr, lambda x, i: F.struct(i.alias(pos), x.alias(value))))


def strings(values) -> Column:
    """A string array literal."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
