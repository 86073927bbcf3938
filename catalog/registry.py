"""Registry of named queries, each with the SQL that must give the same rows.

A query lists its output columns once, as ``name:kind``; both sides are cast and
rounded by that list, so types and names agree by construction and the two
statements stay independent in everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SPARK = {
    "long": lambda c: F.col(c).cast("bigint"),
    # a mean of cents often ends exactly on half a unit of the last digit, where the
    # order of summation decides the rounding: move both sides off that edge alike
    "d6": lambda c: F.round(F.col(c).cast("double") + 1e-9, 6),
    "str": lambda c: F.col(c).cast("string"),
    "bool": lambda c: F.col(c).cast("boolean"),
    "list": lambda c: F.array_join(c, "|"),
    "ts": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
}
_SQL = {
    "long": "CAST({c} AS BIGINT)",
    "d6": "round(CAST({c} AS DOUBLE) + 1e-9, 6)",
    "str": "CAST({c} AS VARCHAR)",
    "bool": "CAST({c} AS BOOLEAN)",
    "list": "array_to_string({c}, '|')",
    "ts": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_SPARK[kind](name).alias(name) for name, kind in _columns(spec)])


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` only its rows are checked."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            outer = ", ".join(f"{_SQL[k].format(c=c)} AS {c}" for c, k in _columns(spec))
            with_part, _, body = sql.rpartition("--final")
            ORACLE[name] = f"{with_part}\nSELECT {outer} FROM (\n{body}\n) AS q"
        return fn

    return register
