"""Lead score arithmetic and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.config import BOOTSTRAP, Bootstrap, Profile
from calllens.functions.extract import contains_any


def score(
    interest: Column,
    buying: Column,
    concern: Column,
    token_count: Column,
    profile: Profile,
    sentiment: Column | None = None,
) -> Column:
    """Score in [0, 100] from signal counts, length and an optional sentiment; null
    where there was no text to count."""
    wi, wb, wc, ws = profile.weights
    length = F.least(F.lit(profile.length_cap), token_count / F.lit(profile.tokens_per_point))
    raw = F.lit(50.0) + interest * wi + buying * wb + concern * wc + length
    if sentiment is not None:
        raw = raw + F.coalesce(sentiment, F.lit(0.0)) * ws
    # greatest and least pass over nulls, so a missing count would count as the cap
    return F.when(raw.isNotNull() & token_count.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


# What a call without a text is given.
NO_TEXT_SCORE, NO_TEXT_CLASS, NO_TEXT_CONFIDENCE = 50.0, "Warm", 0.5


def score_or_neutral(value: Column) -> Column:
    return F.coalesce(value, F.lit(NO_TEXT_SCORE))


def class_or_neutral(value: Column, profile: Profile) -> Column:
    """Class of a score that is null where there was no text."""
    return F.coalesce(lead_class(value, profile), F.lit(NO_TEXT_CLASS))


def confidence_or_neutral(value: Column, profile: Profile) -> Column:
    return F.when(value.isNotNull(), profile.lead_confidence).otherwise(NO_TEXT_CONFIDENCE)


def lead_class(value: Column, profile: Profile) -> Column:
    out = None
    for bound, name in profile.classes:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.when(value.isNotNull(), profile.floor_class)


def personality(lower_text: Column, profile: Profile) -> Column:
    return F.when(contains_any(lower_text, profile.analytical), "Analytical").otherwise(
        "Relationship-focused"
    )


def decision_style(lower_text: Column) -> Column:
    return F.when(F.contains(lower_text, F.lit("we")), "Collaborative").otherwise("Individual")


def strategy(concern_count: Column, profile: Profile) -> Column:
    with_concerns, without = profile.strategies
    return F.when(concern_count > 0, with_concerns).otherwise(without)


def bootstrap_label(lower_text: Column, rule: Bootstrap = BOOTSTRAP) -> Column:
    return (
        F.when(contains_any(lower_text, rule.hot), "Hot")
        .when(contains_any(lower_text, rule.warm), "Warm")
        .otherwise("Cold")
    )


def rule_score(sentiment: Column, positive_ratio: Column, engagement: Column,
               signals: Column) -> Column:
    return (
        sentiment * 0.3
        + positive_ratio * 0.2
        + engagement / F.lit(10.0) * 0.3
        + signals / F.lit(10.0) * 0.2
    )


def rule_label(value: Column) -> Column:
    return F.when(value > 0.6, "Hot").when(value > 0.3, "Warm").otherwise("Cold")
