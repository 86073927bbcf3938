"""DataFrame counterparts of the views in :mod:`catalog.sqlparts`, and probe lists.

The tables hold invented prose without sales words, so the checks use word lists
that do occur; the default lists are covered by the fixture tests.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.session import small_table
from calllens.sources import tables

PROBE = dict(
    interest=("that", "with", "this", "of the"),
    buying=("from", "in the", "by"),
    concern=("are", "to the", "queue"),
    analytical=("that", "nicht"),
    polarity={"for": 1.0, "with": 1.0, "that": 1.0, "was": -1.0, "are": -1.0, "from": -1.0, "der": 0.5},
    negators=("not", "on", "nicht", "un"),
    boosters_up=("the", "die"),
    boosters_down=("in", "que"),
    technical=("th", "ing", "heed", "ver"),
    competitor=("tion", "ement"),
    price=("ing of", "ung"),
    open_ended=("que", "un"),
    yes_no=("la", "und", "le", "die"),
    clarifying=("es", "ist"),
    interest_patterns=(
        (("this", "that"),),
        (("of", "in"), ("the", "a", "that")),
        (("of",), ("the",), ("and", "that", "is")),
        (("la", "le"), ("que", "de")),
    ),
    objection_patterns=(
        (("and", "with"), ("the", "that")),
        (("der", "die"), ("und", "in")),
        (("is", "are"),),
    ),
)
PROBE_V31 = replace(V31, **PROBE)
PROBE_V30 = replace(V30, **PROBE)
NAMES = [("ing", "ORG"), ("the that", "ORG"), ("of the", "ORG"), ("und die", "GPE"), ("la que", "ORG"), ("th", "PRODUCT")]
ORGS = tuple(n for n, label in NAMES if label == "ORG")


def names_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, NAMES, ["name", "label"])


def lexicon_table(spark: SparkSession) -> DataFrame:
    rows = [(t, c) for c in ("interest", "buying", "concern") for t in PROBE[c] if " " not in t]
    return small_table(spark, rows, ["term", "category"])


def asking(spark: SparkSession, sf: str) -> DataFrame:
    return tables.turns(spark, sf).withColumn(
        "text",
        F.when(F.col("speaker") == "prospect", F.replace("text", F.lit("."), F.lit("?"))).otherwise(
            F.col("text")
        ),
    )


def asking_docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.transcripts(spark, sf).select(
        "call_id",
        F.when(F.col("lang") != "en", F.replace("text", F.lit("."), F.lit("?")))
        .otherwise(F.col("text"))
        .alias("text"),
    )
