"""Constraint checks, rejects and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.functions.text import collapse_whitespace

# The allowed members of each enumerated column.
LEAD_CLASSES = ("Hot", "Warm", "Cold", "Unqualified", "Unknown")
STATUSES = ("pending", "processing", "completed", "failed", "reprocessing")
SENTIMENTS = ("Positive", "Neutral", "Negative", "Mixed")


def result_rules() -> dict[str, Column]:
    """The value ranges that stored call results must keep."""
    return {
        "lead_class": one_of("lead_class", LEAD_CLASSES),
        "status": one_of("status", STATUSES),
        "confidence": between("confidence", 0, 1),
        "sentiment": between("sentiment", -1, 1),
        "score": between("score", 0, 100),
        "file_name": not_null("file_name"),
    }


def between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def one_of(column: str, allowed) -> Column:
    return F.col(column).isin(*allowed)


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def check_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: names of the rules a row breaks, in one pass.

    As in SQL, a rule that is neither true nor false (null input) is not broken.
    """
    broken = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_rows(checked: DataFrame, key: str) -> DataFrame:
    return checked.select(key, F.explode("violations").alias("rule"))


def reject_reason(text: Column, min_length: int = 1, json: Column | None = None) -> Column:
    """Why a row cannot be analysed, null when it can."""
    stripped = collapse_whitespace(text)
    reason = (
        F.when(text.isNull(), "missing")
        .when(F.length(stripped) == 0, "blank")
        .when(F.length(text) < min_length, "too_short")
    )
    if json is not None:
        reason = reason.when(json.isNotNull() & F.try_parse_json(json).isNull(), "bad_json")
    return reason


def reject_invalid(
    df: DataFrame, text: str = "text", min_length: int = 1, json: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejected rows with a reason)``."""
    reason = reject_reason(F.col(text), min_length, F.col(json) if json else None)
    marked = df.withColumn("reason", reason)
    return (
        marked.where(F.col("reason").isNull()).drop("reason"),
        marked.where(F.col("reason").isNotNull()),
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
