"""Interest moments and objections: overlapping token patterns with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions import patterns as pt
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let, rows_of
from calllens.functions.tokens import sentences, tokens, words


def moments_array(c: Column, profile: Profile) -> Column:
    """``array<struct<start, phrase, context, t, intensity>>`` of one transcript."""
    return moments_from(words(c), profile)


def moments_from(
    word_array: Column, profile: Profile, toks: Column | None = None, values: Column | None = None
) -> Column:
    """``toks`` and ``values``, the lower-cased words and their ``sentiment.valences``, are
    given where they are at hand."""

    def moment(ws: Column, toks: Column, values: Column, span: Column) -> Column:
        lo, length = pt.window_bounds(
            span["start"], span["n"], F.size(toks), profile.context_window
        )
        polarity = sent.mean_of(F.slice(values, lo + 1, length))
        intensity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (polarity + 1) / 2))
        return F.struct(
            span["start"].alias("start"),
            pt.span_text(ws, span["start"], span["n"]).alias("phrase"),
            F.array_join(F.slice(ws, lo + 1, length), " ").alias("context"),
            (span["start"] / F.size(toks) * F.lit(profile.call_seconds)).alias("t"),
            intensity.alias("intensity"),
        )

    def found(ws: Column, toks: Column, values: Column) -> Column:
        return F.transform(pt.spans(toks, profile.interest_patterns), lambda s: moment(ws, toks, values, s))

    if values is not None:
        return found(word_array, toks, values)
    return let(word_array, lambda ws: let(
        F.transform(ws, lambda w: F.lower(w)),
        lambda toks: let(sent.valences(toks, profile.polarity), lambda values: found(ws, toks, values)),
    ))


def interest_moments(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """One row per match.  Only matches are exploded, so the token arrays are
    never copied per token."""
    return df.select(key, F.inline(moments_array(F.col(text), profile)))


def objections_array(c: Column, profile: Profile) -> Column:
    """The sentence of every objection match, once per match, in text order."""
    return objections_from(sentences(c), profile)


def objections_from(sents: Column, profile: Profile) -> Column:
    per_sentence = F.transform(
        sents,
        lambda s: let(
            tokens(s),
            lambda toks: F.transform(pt.spans(toks, profile.objection_patterns), lambda _: s),
        ),
    )
    return F.flatten(per_sentence)


def objections(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """One row per objection match ``(key, idx, sentence)``."""
    return df.select(key, rows_of(objections_array(F.col(text), profile), "sentence", "idx"))
