"""Listing, paging, searching and looking up analysed calls."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.functions.text import (
    clamp,
    file_name_problem,
    sentiment_bucket,
    strip_prefix,
)

SORT_FIELDS = {"upload_timestamp": "uploaded_at", "file_size": "size_bytes"}
RESULT_JSON = (
    "leadScore struct<score: string, confidence: double>, sentiment double, "
    "metadata struct<call_duration_minutes: double>, _corrupt string"
)


def call_summary(documents: DataFrame) -> DataFrame:
    """Summaries of raw result documents ``(path, raw, size_bytes, uploaded_at)``.

    A document that cannot be read keeps its row, with status
    ``analysis_available`` and no details.
    """
    parsed = F.from_json(
        "raw", RESULT_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    staged = documents.withColumn("_d", parsed).withColumn(
        "_ok", F.col("_d").isNotNull() & F.col("_d._corrupt").isNull()
    )

    def detail(c: Column) -> Column:
        return F.when(F.col("_ok"), c)

    lead = F.col("_d.leadScore")
    return staged.select(
        strip_prefix(F.col("path")).alias("file_identifier"),
        F.col("uploaded_at").alias("upload_timestamp"),
        F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("file_size_mb"),
        F.when(F.col("_ok"), "completed").otherwise("analysis_available").alias("processing_status"),
        detail(lead["score"]).alias("lead_classification"),
        detail(
            F.when(lead.isNotNull(), F.coalesce(lead["confidence"], F.lit(0.0)) * 100)
        ).alias("confidence_percentage"),
        detail(F.col("_d.metadata.call_duration_minutes")).alias("call_duration_minutes"),
        detail(sentiment_bucket(F.col("_d.sentiment"))).alias("overall_sentiment"),
    )


def list_calls(
    calls: DataFrame,
    page: int = 1,
    page_size: int = 20,
    sort_by: str = "upload_timestamp",
    order: str = "desc",
    tie: str = "file_name",
    total: int | None = None,
) -> DataFrame:
    """One page of the calls: a top-k, never a global window.

    Give ``total`` (see :func:`page_info`) to have an out-of-range page refused.
    """
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be between 1 and 100")
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"unknown sort field: {sort_by!r}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    if total:
        pages = -(-total // page_size)
        if page > pages:
            raise ValueError(f"page {page} is out of bounds, valid range: 1-{pages}")
    field = F.col(SORT_FIELDS[sort_by])
    ordered = calls.orderBy(field.desc() if order == "desc" else field.asc(), tie)
    return ordered.offset((page - 1) * page_size).limit(page_size)


def page_info(calls: DataFrame, page: int, page_size: int) -> DataFrame:
    """One row: totals and whether there is a next or previous page."""
    pages = F.ceil(F.col("total_items") / F.lit(page_size))
    return (
        calls.agg(F.count(F.lit(1)).alias("total_items"))
        .withColumn("total_pages", pages)
        .select(
            F.lit(page).alias("current_page"),
            F.lit(page_size).alias("items_per_page"),
            "total_items",
            "total_pages",
            (F.lit(page) < F.col("total_pages")).alias("has_next_page"),
            F.lit(page > 1).alias("has_previous_page"),
        )
    )


def search_calls(
    calls: DataFrame,
    q: str | None = None,
    lead_score: str = "all",
    sentiment: str = "all",
    date_range: tuple[str, str] | None = None,
) -> DataFrame:
    """Conjunctive filters; ``all`` or None means no filter.  ``q`` is looked for in
    the file name or, when there is one, the transcript, ignoring case."""
    tests: list[Column] = []
    if q:
        needle = F.lit(q.lower())
        fields = [c for c in ("file_name", "text") if c in calls.columns]
        tests.append(reduce(lambda a, b: a | b, [F.contains(F.lower(c), needle) for c in fields]))
    if lead_score != "all":
        tests.append(F.col("lead_class") == lead_score)
    if sentiment != "all":
        tests.append(sentiment_bucket(F.col("sentiment")) == sentiment)
    if date_range:
        start, end = date_range
        tests += [
            F.col("uploaded_at") >= F.lit(start).cast("timestamp"),
            F.col("uploaded_at") < F.lit(end).cast("timestamp"),
        ]
    return calls.where(reduce(lambda a, b: a & b, tests)) if tests else calls


def get_call(calls: DataFrame, file_name: str) -> DataFrame:
    """The call of that name; a name that fails validation is refused, a missing one
    gives an empty frame."""
    if not file_name or not file_name.strip():
        raise ValueError("file name is empty")
    if ".." in file_name or file_name.startswith("/"):
        raise ValueError("file name leaves its folder")
    if not re.fullmatch(r"[a-zA-Z0-9._/-]+", file_name) or not file_name.strip("./"):
        raise ValueError("file name has invalid characters")
    return calls.where(F.col("file_name") == file_name)


def validate_file_names(names: DataFrame, name: str = "file_name") -> DataFrame:
    problem = file_name_problem(F.col(name))
    return names.withColumn("reason", problem).withColumn("valid", F.col("reason").isNull())


def by_status(calls: DataFrame, *statuses: str) -> DataFrame:
    return calls.where(F.col("status").isin(*statuses))


def by_classification(calls: DataFrame, *classes: str) -> DataFrame:
    return calls.where(F.col("lead_class").isin(*classes))


def by_confidence(calls: DataFrame, least: float) -> DataFrame:
    return calls.where(F.col("confidence") >= least)


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") >= now)


def json_contains(df: DataFrame, array_col: str, *values: str) -> DataFrame:
    """Rows whose string array holds every given value."""
    return df.where(reduce(lambda a, b: a & b, [F.array_contains(array_col, v) for v in values]))


def response_view(results: DataFrame) -> DataFrame:
    """The public detail shape: camel-case names, nested lead score and metadata."""
    clamped = clamp(F.col("sentiment"), -1.0, 1.0)
    return results.select(
        F.col("file_name").alias("fileName"),
        F.col("text").alias("transcript"),
        clamped.alias("sentiment"),
        F.col("key_phrases").alias("keywords"),
        F.col("topics").alias("topics"),
        F.col("moments").alias("wowMoments"),
        F.struct(
            F.col("lead_class").alias("score"),
            F.col("confidence").alias("confidence"),
        ).alias("leadScore"),
        F.struct(F.col("duration_minutes").alias("call_duration_minutes")).alias("metadata"),
    )
