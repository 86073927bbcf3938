"""Joins, keyed updates and set operations over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_overview(
    calls: DataFrame, sentiments: DataFrame, leads: DataFrame, key: str = "call_id"
) -> DataFrame:
    """Each call with its sentiment and lead score; either may be absent."""
    return calls.join(sentiments, key, "left").join(leads, key, "left")


def nest_children(
    children: DataFrame, key: str, pos: str, fields: list[str], name: str, chunk_rows: int = 1000
) -> DataFrame:
    """Child rows as ordered lists ``(key, chunk, name)``.

    A list holds at most ``chunk_rows`` consecutive positions, so an ordinary
    call has one list (chunk 0) and a huge one has several, each built by its own
    task.
    """
    return (
        children.withColumn("chunk", F.floor(F.col(pos) / F.lit(chunk_rows)))
        .groupBy(key, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(pos, *fields))).alias(name))
    )


def call_nested(
    calls: DataFrame, nested: list[DataFrame], key: str = "call_id"
) -> DataFrame:
    """Calls with their nested lists (from :func:`nest_children`), childless calls kept."""
    lists = nested[0]
    for other in nested[1:]:
        lists = lists.join(other, [key, "chunk"], "full")
    joined = calls.join(lists, key, "left")
    return joined.withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("bigint")))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent; null keys are allowed by a foreign key."""
    ids = parent.select(F.col(parent_key or key).alias(key))
    return child.where(F.col(key).isNotNull()).join(ids, key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that stay after their parents in ``deleted`` are removed."""
    return children.join(deleted.select(key), key, "left_anti")


def cascade_targets(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that go with them."""
    return children.join(deleted.select(key), key, "left_semi")


def pending_calls(calls: DataFrame, results: DataFrame, key: str = "call_id") -> DataFrame:
    """Keys without a result."""
    return calls.select(key).distinct().join(results.select(key), key, "left_anti")


def latest_per_call(
    results: DataFrame, key: str, updated: str, tie: str, columns: list[str] | None = None
) -> DataFrame:
    """The newest result row per key; a partial aggregate, not a window."""
    columns = columns or [c for c in results.columns if c != key]
    newest = results.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(updated, tie)).alias("_row")
    )
    return newest.select(key, "_row.*")


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str, tie: str) -> DataFrame:
    """The rows to append so that each new key enters once and existing keys are untouched."""
    others = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(tie)).alias("_row"))
    return once.select(key, "_row.*").join(target.select(key), key, "left_anti")


def touch_updated_at(
    old: DataFrame, new: DataFrame, key: str, columns: list[str], now: Column,
    updated: str = "updated_at",
) -> DataFrame:
    """``new`` with ``updated_at`` set to ``now`` on rows that differ from ``old``.

    A null-safe comparison; unchanged rows keep their old stamp, new keys get ``now``.
    """
    before = old.select(
        key, F.col(updated).alias("_stamp"), F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_old_{c}") for c in columns],
    )
    same = F.coalesce(F.col("_known"), F.lit(False))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = new.drop(updated).join(before, key, "left")
    return joined.select(
        key, *columns, F.when(same, F.col("_stamp")).otherwise(now).alias(updated)
    )
