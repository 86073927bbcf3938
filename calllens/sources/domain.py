"""The relational tables of call analytics: schemas, what their rows must keep, and how an
analysis becomes such tables.

Three sets exist side by side: the application's own tables (A), those of the processing
database (B), and a reduced form of these (C).  Reading adds the columns that a database
would generate; checking finds rows that break a rule of their table, a unique key or a
reference, each in one pass over the table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calllens.functions.text import minutes, size_mb
from calllens.operators import quality

# Names, types, lengths, ranges and members that the tables declare.
UNIT, SIGNED, PERCENT = (0, 1), (-1, 1), (0, 100)
STAMPS = ", created_at timestamp, updated_at timestamp"


@dataclass(frozen=True)
class Table:
    """One table: its columns as DDL, and the rules of its rows."""

    name: str
    columns: str
    key: str = "id"
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: Column to the table and column it refers to.
    refers: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    #: Longest text of a column.
    lengths: Mapping[str, int] = field(default_factory=dict)
    #: Columns that follow from others.
    generated: tuple[str, ...] = ()

    def digits(self) -> dict[str, int]:
        """The digits that each decimal may have before its point."""
        found = re.findall(r"(\w+) decimal\((\d+),(\d+)\)", self.columns)
        return {c: int(size) - int(scale) for c, size, scale in found}

    def rules(self) -> dict[str, Column]:
        """The rules of single rows, by name."""
        out = {f"{c}_missing": quality.not_null(c) for c in (self.key, *self.required)}
        out |= {f"{c}_range": quality.between(c, lo, hi) for c, (lo, hi) in self.ranges.items()}
        out |= {f"{c}_digits": F.abs(c) < 10 ** n for c, n in self.digits().items() if c not in self.ranges}
        out |= {f"{c}_domain": quality.one_of(c, members) for c, members in self.domains.items()}
        return out | {f"{c}_length": F.length(c) <= n for c, n in self.lengths.items()}


def _tables(*tables: Table) -> dict[str, Table]:
    return {t.name: t for t in tables}


OF_CALL = {"call_transcript_id": ("call_transcripts", "id")}
SET_A = _tables(
    Table(
        "call_transcripts",
        "id string, file_name string, s3_key string, file_size_bytes int, original_transcript string, "
        "processed_transcript string, upload_timestamp timestamp, processing_status string, "
        "processing_duration_seconds double, analysis_results string, word_count int, "
        "estimated_duration_minutes double, confidence_score double" + STAMPS,
        required=("file_name", "s3_key", "processing_status"), unique=(("s3_key",),),
        ranges={"confidence_score": UNIT}, lengths={"file_name": 255, "s3_key": 512, "processing_status": 50},
    ),
    Table(
        "sentiment_analyses",
        "id string, call_transcript_id string, overall_score double, confidence_rating double, "
        "emotion_categories map<string, double>, analysis_method string, model_versions map<string, string>" + STAMPS,
        required=("call_transcript_id", "overall_score", "confidence_rating", "emotion_categories", "analysis_method"),
        refers=OF_CALL, ranges={"overall_score": SIGNED, "confidence_rating": UNIT}, lengths={"analysis_method": 100},
    ),
    Table(
        "lead_scores",
        "id string, call_transcript_id string, primary_classification string, numerical_score double, "
        "confidence_level double, interest_signals array<string>, concern_indicators array<string>, "
        "buying_signals array<string>, personality_assessment string, decision_making_style string, "
        "recommended_strategy string, next_actions array<string>, risk_factors array<string>, "
        "conversion_probability double" + STAMPS,
        required=("call_transcript_id", "primary_classification", "numerical_score", "confidence_level", "conversion_probability"),
        refers=OF_CALL, ranges={"numerical_score": PERCENT, "confidence_level": UNIT, "conversion_probability": UNIT},
        lengths={"primary_classification": 20, "personality_assessment": 100, "decision_making_style": 100},
    ),
    Table(
        "interest_moments",
        "id string, call_transcript_id string, trigger_phrase string, contextual_content string, "
        "estimated_timestamp double, intensity_score double, topic_category string, speaker_identifier string, "
        "follow_up_recommendation string" + STAMPS,
        required=("call_transcript_id", "trigger_phrase", "intensity_score"), refers=OF_CALL,
        ranges={"intensity_score": UNIT}, lengths={"topic_category": 100, "speaker_identifier": 50},
    ),
    Table(
        "call_topics",
        "id string, call_transcript_id string, topic_name string, relevance_score double, keywords array<string>, "
        "discussion_duration_percentage double, topic_sentiment double" + STAMPS,
        required=("call_transcript_id", "topic_name", "relevance_score"), refers=OF_CALL,
        ranges={"relevance_score": UNIT, "topic_sentiment": SIGNED}, lengths={"topic_name": 200},
    ),
    Table(
        "processing_jobs",
        "id string, job_type string, status string, input_data string, output_data string, error_message string, "
        "started_at timestamp, completed_at timestamp, progress_percentage int" + STAMPS,
        required=("job_type", "status"), ranges={"progress_percentage": PERCENT},
        domains={"status": quality.STATUSES}, lengths={"job_type": 50, "status": 20},
    ),
    Table(
        "system_metrics",
        "id string, metric_name string, metric_value double, metric_unit string, component string, "
        "environment string, metadata string" + STAMPS,
        required=("metric_name", "metric_value", "component", "environment"),
        lengths={"metric_name": 100, "metric_unit": 20, "component": 50, "environment": 20},
    ),
)

OF_RESULT = {"analysis_result_id": ("analysis_results", "id")}
SET_B = _tables(
    Table(
        "audio_files",
        "id string, filename string, s3_key string, s3_bucket string, file_size_bytes bigint, "
        "duration_seconds decimal(10,2), audio_format string, sample_rate int, channels int, uploaded_at timestamp, "
        "uploaded_by string, metadata string" + STAMPS,
        required=("filename",), unique=(("filename",),), generated=("file_size_mb", "duration_minutes"),
        lengths={"filename": 512, "s3_key": 1024, "s3_bucket": 256, "audio_format": 50, "uploaded_by": 256},
    ),
    Table(
        "analysis_results",
        "id string, audio_file_id string, file_identifier string, processing_status string, "
        "sentiment_score decimal(5,4), sentiment_category string, sentiment_confidence decimal(5,4), "
        "sentiment_progression string, lead_classification string, lead_confidence_score decimal(5,4), "
        "engagement_level decimal(4,2), transcript_text string, key_phrases array<string>, topics array<string>, "
        "technical_terms array<string>, interest_moments string, processing_started_at timestamp, "
        "processing_completed_at timestamp, processing_duration_seconds decimal(10,2), ml_model_version string, "
        "analysis_metadata string" + STAMPS,
        required=("file_identifier",), unique=(("audio_file_id",), ("file_identifier",)),
        refers={"audio_file_id": ("audio_files", "id")}, ranges={"sentiment_score": SIGNED},
        domains={
            "processing_status": quality.STATUSES, "sentiment_category": quality.SENTIMENTS,
            "lead_classification": ("Hot", "Warm", "Cold", "Unknown"),
        },
        lengths={"file_identifier": 512, "ml_model_version": 100},
    ),
    Table(
        "lead_scoring_details",
        "id string, analysis_result_id string, interest_signals array<string>, concern_flags array<string>, "
        "followup_priority string, next_actions array<string>, buying_intent_score decimal(5,4), "
        "decision_maker_confidence decimal(5,4), budget_discussion_detected boolean, timeline_mentioned boolean, "
        "competitor_mentioned boolean" + STAMPS,
        unique=(("analysis_result_id",),), refers=OF_RESULT, lengths={"followup_priority": 50},
    ),
    Table(
        "processing_logs",
        "id string, analysis_result_id string, log_level string, log_message string, error_details string, "
        "processing_stage string, timestamp timestamp",
        required=("log_level", "log_message"), refers=OF_RESULT, lengths={"log_level": 20, "processing_stage": 100},
    ),
    Table(
        "user_sessions",
        "id string, session_key string, user_identifier string, session_data string, expires_at timestamp, "
        "created_at timestamp, last_accessed_at timestamp",
        required=("session_key", "expires_at"), unique=(("session_key",),),
        lengths={"session_key": 256, "user_identifier": 256},
    ),
)
SET_C = _tables(
    Table(
        "voice_calls",
        "id string, file_name string, file_key string, upload_timestamp timestamp, file_size_bytes bigint, "
        "duration_seconds double, status string" + STAMPS,
        required=("file_name",), unique=(("file_name",),), lengths={"file_name": 255, "file_key": 500, "status": 50},
    ),
    Table(
        "analysis_results",
        "id string, call_id string, sentiment_score double, lead_classification string, confidence_score double, "
        "keywords array<string>, topics array<string>, wow_moments string, processing_time_seconds double, "
        "model_version string, created_at timestamp",
        refers={"call_id": ("voice_calls", "id")}, lengths={"lead_classification": 20, "model_version": 50},
    ),
)
GENERATED = {
    "file_size_mb": lambda: size_mb(F.col("file_size_bytes")),
    "duration_minutes": lambda: minutes(F.col("duration_seconds")),
}


def shaped(df: DataFrame, table: Table, wide: bool = False) -> DataFrame:
    """The rows with the declared columns, in their types and order; absent ones are null.

    With ``wide``, for rows that are yet to be checked, decimals keep their places but may
    have any number of digits before the point: a value too large for its column is then
    one that a rule finds, and no error.
    """
    declared = df.sparkSession.createDataFrame([], table.columns).schema
    kinds = {f.name: T.DecimalType(38, f.dataType.scale) if wide and isinstance(f.dataType, T.DecimalType) else f.dataType for f in declared}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def write_tables(tables: Mapping[str, DataFrame], kinds: Mapping[str, Table], root: str) -> None:
    """Append each table's rows below ``root``."""
    for name, df in tables.items():
        shaped(df, kinds[name]).write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def read_domain(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """The stored rows of a table by its declared schema, with the generated columns."""
    rows = spark.read.schema(table.columns).parquet(f"{root.rstrip('/')}/{table.name}")
    return rows.withColumns({name: GENERATED[name]() for name in table.generated}) if table.generated else rows


def checked(df: DataFrame, table: Table) -> DataFrame:
    """The rows with ``violations``: the names of the rules each one breaks."""
    return quality.check_constraints(df, table.rules())


def violations(tables: Mapping[str, DataFrame], kinds: Mapping[str, Table]) -> DataFrame:
    """``(table_name, rule, rows)``: how many rows break each rule that any row breaks.

    ``<column>_unique`` counts the rows that share a value which may occur once (missing
    values may repeat), ``<column>_reference`` rows whose reference leads nowhere; tables
    that are not given are not referred to.  Equal keys are counted before they meet, so
    a value that fills a third of the table is one row of the join.
    """
    out = []
    for name, df in tables.items():
        table = kinds[name]
        broken = checked(df, table).select(F.explode("violations").alias("rule"))
        out.append(broken.groupBy("rule").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rule", "rows"))
        for columns in ((table.key,), *table.unique):
            known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
            twice = quality.duplicate_keys(df.where(known), list(columns)).agg(F.sum("count").alias("rows"))
            out.append(twice.select(F.lit(name).alias("table_name"), F.lit("_".join((*columns, "unique"))).alias("rule"), "rows"))
        for column, (parent, key) in table.refers.items():
            if parent in tables:
                asked = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count(F.lit(1)).alias("n"))
                there = tables[parent].select(F.col(key).alias("_ref")).distinct()
                lost = asked.join(there, "_ref", "left_anti").agg(F.sum("n").alias("rows"))
                out.append(lost.select(F.lit(name).alias("table_name"), F.lit(f"{column}_reference").alias("rule"), "rows"))
    return reduce(DataFrame.unionByName, out).where(F.col("rows") > 0)


def _id(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def normalised(analysis: DataFrame, method: str = "ensemble") -> dict[str, DataFrame]:
    """The tables of set A that an analysis (rows of ``schemas.ANALYSIS``) makes: each
    call, its sentiment and lead, and a row per moment and topic.

    Keys follow from the call and the place in its list, so the same analysis makes the
    same rows.
    """
    call = _id(F.col("call_id"))
    now = {"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}
    stamped = analysis.withColumn("_call", call)

    def children(column: str) -> DataFrame:
        """A row per element, with its place; an identity keeps the list from being computed twice."""
        return stamped.select("_call", F.posexplode(F.transform(column, lambda x: x)).alias("_at", "_x"))

    moments, topics = children("moments"), children("topics")
    tables = {
        "call_transcripts": stamped.select(
            F.col("_call").alias("id"), "file_name", F.col("call_id").cast("string").alias("s3_key"),
            F.col("text").alias("processed_transcript"), F.lit("completed").alias("processing_status"),
            F.col("word_count").cast("int").alias("word_count"), F.col("duration_minutes").alias("estimated_duration_minutes"),
            F.col("confidences")["overall_analysis"].alias("confidence_score"),
        ),
        "sentiment_analyses": stamped.select(
            _id(F.col("_call"), F.lit("sentiment")).alias("id"), F.col("_call").alias("call_transcript_id"),
            F.col("sentiment.score").alias("overall_score"), F.col("sentiment.confidence").alias("confidence_rating"),
            F.col("sentiment.emotions").alias("emotion_categories"), F.lit(method).alias("analysis_method"),
        ),
        "lead_scores": stamped.select(
            _id(F.col("_call"), F.lit("lead")).alias("id"), F.col("_call").alias("call_transcript_id"),
            F.col("lead.class").alias("primary_classification"), F.col("lead.score").alias("numerical_score"),
            F.col("lead.confidence").alias("confidence_level"), F.col("lead.interest").alias("interest_signals"),
            F.col("lead.concerns").alias("concern_indicators"), F.col("lead.buying").alias("buying_signals"),
            F.col("lead.personality").alias("personality_assessment"), F.col("lead.decision").alias("decision_making_style"),
            F.col("lead.strategy").alias("recommended_strategy"), F.col("lead.next_actions").alias("next_actions"),
            F.col("lead.risk_factors").alias("risk_factors"), F.col("lead.conversion_probability").alias("conversion_probability"),
        ),
        "interest_moments": moments.select(
            _id(F.col("_call"), F.lit("moment"), F.col("_at")).alias("id"), F.col("_call").alias("call_transcript_id"),
            F.col("_x.phrase").alias("trigger_phrase"), F.col("_x.context").alias("contextual_content"),
            F.col("_x.t").alias("estimated_timestamp"), F.col("_x.intensity").alias("intensity_score"),
            F.col("_x.topic").alias("topic_category"), F.col("_x.speaker").alias("speaker_identifier"),
            F.col("_x.follow_up").alias("follow_up_recommendation"),
        ),
        "call_topics": topics.select(
            _id(F.col("_call"), F.lit("topic"), F.col("_at")).alias("id"), F.col("_call").alias("call_transcript_id"),
            F.col("_x.name").alias("topic_name"), F.col("_x.relevance").alias("relevance_score"),
            F.array("_x.name").alias("keywords"),
        ),
    }
    return {name: shaped(df.withColumns(now), SET_A[name]) for name, df in tables.items()}
