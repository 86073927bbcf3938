"""Cleaning and other scalar text functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions.arrays import let
from calllens.functions.tokens import BLANK


def collapse_whitespace(c: Column) -> Column:
    """Every run of blanks as one space, none at the ends; blanks of all scripts count."""
    # single spaces, by far the most, are left alone
    return F.trim(F.regexp_replace(c, f"{BLANK}(?:(?<! ){BLANK}*+|{BLANK}++)", " "))


def strip_artifacts(c: Column, artifacts) -> Column:
    for tag in artifacts:
        c = F.replace(c, F.lit(tag), F.lit(""))
    return c


def strip_speaker_tags(c: Column, profile: Profile) -> Column:
    return F.regexp_replace(c, profile.speaker_tag, "")


def squeeze_punctuation(c: Column) -> Column:
    # most texts hold no run that is too long
    def cut(run: str, pattern: str, to: str):
        return lambda x: F.when(F.contains(x, F.lit(run)), F.regexp_replace(x, pattern, to)).otherwise(x)

    return let(let(c, cut("....", r"\.{3,}", "...")), cut("---", r"-{2,}", "--"))


def clean_transcript(c: Column, profile: Profile) -> Column:
    """Whitespace first, then artefacts, tags and punctuation; one narrow expression."""
    return clean_tidy(strip_artifacts(collapse_whitespace(c), profile.artifacts), profile)


def clean_tidy(c: Column, profile: Profile, has_tags: Column | None = None) -> Column:
    """The steps after the artefacts; ``has_tags`` is false where no tag can be in the text."""
    out = strip_speaker_tags(c, profile)
    if has_tags is not None:
        out = F.when(has_tags, out).otherwise(c)
    if profile.squeeze:
        out = squeeze_punctuation(out)
    return F.trim(out)


def processing_id(key: Column) -> Column:
    return F.substring(F.md5(key), 1, 8)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_prefix(path: Column, prefix: str = "analysis-results/") -> Column:
    # every occurrence goes, as in a plain string replacement
    return F.replace(path, F.lit(prefix), F.lit(""))


def size_mb(size_bytes: Column) -> Column:
    """Megabytes in exact decimal arithmetic, rounded half up."""
    return (size_bytes.cast("decimal(20,0)") / F.lit(Decimal("1048576.0"))).cast("decimal(10,2)")


def minutes(seconds: Column) -> Column:
    return (seconds.cast("decimal(10,2)") / F.lit(Decimal("60.0"))).cast("decimal(10,2)")


def sentiment_bucket(score: Column) -> Column:
    return (
        F.when(score > 0.2, "Positive")
        .when(score < -0.2, "Negative")
        .when(score.isNotNull(), "Neutral")
    )


def emotions(score: Column) -> dict[str, Column]:
    """Positive, negative and neutral shares of one score in [-1, 1]; null without one."""
    known = score.isNotNull()
    return {
        "positive": F.when(known, F.greatest(F.lit(0.0), score)),
        "negative": F.when(known, F.greatest(F.lit(0.0), -score)),
        "neutral": F.lit(1.0) - F.abs(score),
    }


def clamp(value: Column, low: float, high: float) -> Column:
    """The value held between two bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def file_name_problem(name: Column) -> Column:
    """Reason code for a file name that must not be looked up, null when it is fine."""
    return (
        F.when(name.isNull() | (F.trim(F.regexp_replace(name, r"\s", " ")) == ""), "empty")
        .when(F.contains(name, F.lit("..")) | F.startswith(name, F.lit("/")), "path_traversal")
        .when(~name.rlike(r"\A[a-zA-Z0-9._/-]+\z"), "invalid_characters")
        # a path made of "." parts only collapses to the bare prefix folder
        .when(name.rlike(r"\A(\./*)+\z"), "outside_prefix")
    )


def trigrams(c: Column) -> Column:
    """Distinct padded 3-grams of the words (two blanks before, one after each)."""
    words = F.filter(
        F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 when neither side has any."""
    ga, gb = trigrams(a), trigrams(b)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(ga, gb)), F.size(F.array_union(ga, gb))),
        F.lit(0.0),
    )
