"""Signal extraction and lead scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.config import BOOTSTRAP, Bootstrap, Profile
from calllens.functions import extract, scoring
from calllens.functions.arrays import strings
from calllens.functions.tokens import token_count

LISTS = ("interest", "buying", "concern")


def _flag_columns(lower: Column, profile: Profile, match: str) -> dict[str, list[Column]]:
    return {name: extract.present(lower, getattr(profile, name), match) for name in LISTS}


def signal_extract(
    df: DataFrame, profile: Profile, text: str = "text", match: str = "substring"
) -> DataFrame:
    """Add the three labelled signal lists of each transcript; narrow."""
    staged = df.withColumn("_lower", F.lower(text))
    return staged.select(
        *df.columns,
        *[
            extract.matched(F.col("_lower"), getattr(profile, name), match, prefix).alias(
                f"{name}_signals"
            )
            for name, prefix in zip(LISTS, profile.prefixes)
        ],
    )


def lead_score(
    df: DataFrame,
    profile: Profile,
    text: str = "text",
    sentiment_col: str | None = None,
    match: str = "substring",
) -> DataFrame:
    """Score and class of each transcript row; one narrow stage, no shuffle.

    A null text takes the neutral fallback (Warm, 50, confidence 0.5).
    """
    staged = df.withColumn("_lower", F.lower(text)).withColumn("_tokens", token_count(F.col(text)))
    counts = {
        name: extract.count_true(flags)
        for name, flags in _flag_columns(F.col("_lower"), profile, match).items()
    }
    counted = staged.select(*df.columns, "_tokens", *[c.alias(f"n_{n}") for n, c in counts.items()])
    return _scored(counted, df.columns, profile, sentiment_col)


def _scored(counted, keep, profile, sentiment_col) -> DataFrame:
    value = scoring.score(
        F.col("n_interest"), F.col("n_buying"), F.col("n_concern"), F.col("_tokens"), profile,
        F.col(sentiment_col) if sentiment_col else None,
    )
    scored = counted.withColumn("_value", value)
    shown = scoring.score_or_neutral(F.col("_value"))
    return scored.select(
        *keep,
        F.coalesce("_tokens", F.lit(0)).alias("token_count"),
        *[F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in LISTS],
        shown.alias("lead_score"),
        scoring.class_or_neutral(F.col("_value"), profile).alias("lead_class"),
        scoring.confidence_or_neutral(F.col("_value"), profile).alias("lead_confidence"),
        (shown / 100).alias("conversion_probability"),
    )


def lead_score_turns(
    turns: DataFrame,
    profile: Profile,
    key: str = "call_id",
    text: str = "text",
    match: str = "substring",
) -> DataFrame:
    """Lead score of calls given as one row per turn.

    A signal counts for the call when any of its turns holds the term.  Turns are
    never joined into one text: each task reduces its turns to one row of flags
    per call before the shuffle, so a call with most of the turns costs no more
    than any other.  A phrase must be spoken within one turn.
    """
    staged = turns.withColumn("_lower", F.lower(text)).withColumn(
        "_tokens", token_count(F.col(text))
    )
    flags = _flag_columns(F.col("_lower"), profile, match)
    names = {n: [f"_{n}_{i}" for i in range(len(fs))] for n, fs in flags.items()}
    flagged = staged.select(
        key,
        "_tokens",
        *[f.alias(c) for n in LISTS for f, c in zip(flags[n], names[n])],
        scoring.personality(F.col("_lower"), profile).alias("_personality"),
        F.contains(F.col("_lower"), F.lit("we")).alias("_we"),
    )
    calls = flagged.groupBy(key).agg(
        F.sum("_tokens").alias("_tokens"),
        *[F.max(c).alias(c) for n in LISTS for c in names[n]],
        F.min("_personality").alias("personality"),  # "Analytical" sorts first
        F.max("_we").alias("_we"),
    )
    counted = calls.select(
        key,
        "_tokens",
        *[
            extract.count_true([F.coalesce(F.col(c), F.lit(False)) for c in names[n]]).alias(f"n_{n}")
            for n in LISTS
        ],
        *[
            extract.labelled([F.col(c) for c in names[n]], getattr(profile, n), prefix).alias(
                f"{n}_signals"
            )
            for n, prefix in zip(LISTS, profile.prefixes)
        ],
        "personality",
        F.when(F.col("_we"), "Collaborative").otherwise("Individual").alias("decision_style"),
    )
    keep = [key, *[f"{n}_signals" for n in LISTS], "personality", "decision_style"]
    return _scored(counted, keep, profile, None)


def insight_labels(df: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """Add personality, decision style, strategy, next actions and risk factors."""
    staged = df.withColumn("_lower", F.lower(text))
    staged = staged.withColumn(
        "risk_factors",
        extract.matched(F.col("_lower"), profile.concern, prefix=profile.prefixes[2]),
    )
    return staged.select(
        *df.columns,
        scoring.personality(F.col("_lower"), profile).alias("personality"),
        scoring.decision_style(F.col("_lower")).alias("decision_style"),
        scoring.strategy(F.size("risk_factors"), profile).alias("strategy"),
        strings(profile.next_actions).alias("next_actions"),
        "risk_factors",
    )


def bootstrap_score(
    df: DataFrame, text: str = "text", rule: Bootstrap = BOOTSTRAP
) -> DataFrame:
    """Three-class keyword label of the non-blank rows (see ``quality.reject_invalid``)."""
    valid = df.where(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0)
    return valid.withColumns(
        {
            "label": scoring.bootstrap_label(F.lower(text), rule),
            "confidence": F.lit(rule.confidence),
        }
    )


def score_batch(
    df: DataFrame, id_col: str = "id", text: str = "text", rule: Bootstrap = BOOTSTRAP
) -> DataFrame:
    """``(id, text)`` to ``(id, label, confidence)``; the caller counts through ``observe``."""
    return bootstrap_score(df, text, rule).select(id_col, "label", "confidence")


def rule_labels(features: DataFrame) -> DataFrame:
    """Add the training-label rule's value and class to a feature table."""
    value = scoring.rule_score(
        F.col("sentiment_score"),
        F.col("positive_word_ratio"),
        F.col("engagement_score"),
        F.col("interest_signals"),
    )
    return features.withColumn("rule_score", value).withColumn(
        "rule_label", scoring.rule_label(F.col("rule_score"))
    )


def lead_detail_flags(
    df: DataFrame,
    profile: Profile,
    budget=("budget",),
    timeline=("timeline", "when can we", "next steps"),
    text: str = "text",
) -> DataFrame:
    """Detail flags of a scored transcript (needs ``lead_class``)."""
    staged = df.withColumn("_lower", F.lower(text))
    low = F.col("_lower")
    buying = extract.count_true(extract.present(low, profile.buying))
    return staged.select(
        *df.columns,
        extract.contains_any(low, budget).alias("budget_discussion_detected"),
        extract.contains_any(low, timeline).alias("timeline_mentioned"),
        extract.contains_any(low, profile.competitor).alias("competitor_mentioned"),
        (buying / F.lit(len(profile.buying))).alias("buying_intent_score"),
        F.when(F.col("lead_class") == "Hot", "High")
        .when(F.col("lead_class") == "Warm", "Medium")
        .otherwise("Low")
        .alias("followup_priority"),
    )
