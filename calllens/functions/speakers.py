"""Speakers of a raw transcript, from its speaker tags; row-local array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calllens.config import Profile
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let, positions
from calllens.functions.text import collapse_whitespace, sentiment_bucket, squeeze_punctuation, strip_artifacts
from calllens.functions.tokens import sentences, token_count, words

# Fixed value: the name of whoever speaks before the first tag.
PRIMARY = "primary_speaker"
ROLES = ("prospect", "sales_representative", "decision_maker")
TAG, TAG_END = "\u0002", "\u0003"
# Fixed value: the combining dot above.
DOT = "\u0307"
BUCKETS = ("Positive", "Negative", "Neutral")


def speaker_spans(raw: Column, profile: Profile) -> Column:
    """``array<struct<speaker, text>>`` of a transcript that still holds its tags.

    A tag names the speaker of all that follows up to the next one; words before the first
    belong to ``primary_speaker``.  The texts are cleaned as the whole transcript is, so
    the tokens of the spans are, in order, those of the cleaned transcript (unless an
    apostrophe touches a tag).  Spans without text are left out.
    """
    return spans_of(marked_tags(strip_artifacts(collapse_whitespace(raw), profile.artifacts), profile), profile)


def marked_tags(tidy: Column, profile: Profile) -> Column:
    """A tidied transcript with its speaker tags between ``TAG`` and ``TAG_END``."""
    plain = F.replace(F.replace(tidy, F.lit(TAG), F.lit(" ")), F.lit(TAG_END), F.lit(" "))
    return F.regexp_replace(plain, profile.speaker_tag, f"{TAG}$0{TAG_END}")


def spans_of(marked: Column, profile: Profile) -> Column:
    """:func:`speaker_spans` of a transcript whose tags are marked."""
    pieces = F.split(marked, TAG)

    def span(piece: Column, i: Column) -> Column:
        # what a tag leaves of its colon goes with it
        text = F.regexp_replace(F.substring_index(piece, TAG_END, -1), r"^ *: *", "")
        text = F.trim(squeeze_punctuation(text) if profile.squeeze else text)
        name = F.rtrim(F.rtrim(F.substring_index(piece, TAG_END, 1), F.lit(":")))
        return F.struct(
            F.when(i == 0, F.lit(PRIMARY)).otherwise(name).alias("speaker"),
            F.when(i == 0, F.trim(piece)).otherwise(text).alias("text"),
        )

    return F.filter(F.transform(pieces, span), lambda s: s["text"] != "")


def word_spans(spans: Column) -> Column:
    """For each token of the transcript the number of its span."""
    return F.flatten(F.transform(spans, lambda s, i: F.array_repeat(i, token_count(s["text"]).cast("int"))))


def speaker_at(spans: Column, of_words: Column, place: Column) -> Column:
    """Who says the token at a place; ``of_words`` are the bound :func:`word_spans`, which
    a transcript of one span needs not."""
    return F.when(F.size(spans) == 1, F.get(spans, F.lit(0))["speaker"]).otherwise(F.get(spans, F.get(of_words, place))["speaker"])


def _measures(spans: Column, profile: Profile) -> Column:
    """Per span what adds up to a profile, ordered by speaker."""

    def measured(s: Column, i: Column) -> Column:
        lower = F.lower(s["text"])
        engaged = F.transform(
            sentences(s["text"]),
            lambda x: F.least(F.lit(1.0), F.regexp_count(x, F.lit(r"\S+")) / F.lit(profile.timeline_words)),
        )

        def struct(low: Column, toks: Column, polarity: Column, e: Column) -> Column:
            # only a dot that lower-casing adds to a letter can cut a word in two
            n = F.when(F.contains(low, F.lit(DOT)), token_count(s["text"])).otherwise(F.size(toks).cast("bigint"))
            return F.struct(
                s["speaker"].alias("speaker"),
                i.alias("at"),
                n.alias("n"),
                sentiment_bucket(polarity).alias("bucket"),
                F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("engaged"),
                F.size(e).alias("sentences"),
                low.alias("lower"),
            )

        # every part is bound, as a lambda computes what it names as often as it is named
        return let(lower, lambda low: let(words(low), lambda toks: let(
            sent.mean_valence(toks, profile.polarity), lambda p: let(engaged, lambda e: struct(low, toks, p, e))
        )))

    return F.array_sort(F.transform(spans, measured))


def speaker_profiles(spans: Column, profile: Profile) -> Column:
    """One struct per speaker, in the order of their first words: role, turns, words,
    share of all words in percent, shares of turns by sentiment, mean engagement of
    sentences, and the concerns raised.

    Spans are sorted by speaker and each run is added up, so the work grows with the
    spans, not with spans times speakers.
    """
    concerns = F.array(*[F.lit(t) for t in profile.concern]).cast("array<string>")

    def profiled(part: Column, everything: Column) -> Column:
        def total(field: str) -> Column:
            return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, s: a + s[field])

        name = F.get(part, F.lit(0))["speaker"]
        known = F.lower(F.replace(name, F.lit(" "), F.lit("_")))
        engaged = F.aggregate(part, F.lit(0.0), lambda a, s: a + s["engaged"])
        def share(name: str) -> Column:
            return F.size(F.filter(part, lambda s: s["bucket"] == name)) / F.size(part)

        return F.struct(
            F.get(part, F.lit(0))["at"].alias("at"),
            name.alias("speaker"),
            F.when(known.isin(*ROLES), known).otherwise("unknown").alias("role"),
            F.size(part).cast("bigint").alias("turn_count"),
            total("n").alias("word_count"),
            F.coalesce(F.try_divide(total("n"), everything) * 100, F.lit(0.0)).alias("share_pct"),
            *[share(b).alias(f"{b.lower()}_share") for b in BUCKETS],
            F.coalesce(F.try_divide(engaged, total("sentences")), F.lit(0.0)).alias("engagement"),
            F.filter(concerns, lambda c: F.exists(part, lambda s: F.contains(s["lower"], c))).alias("concerns"),
        )

    def by_runs(ms: Column) -> Column:
        first = F.filter(positions(ms), lambda i: (i == 0) | (F.get(ms, i)["speaker"] != F.get(ms, i - 1)["speaker"]))
        everything = F.aggregate(ms, F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
        return let(
            F.struct(first.alias("st"), everything.alias("n")),
            lambda b: F.transform(
                b["st"],
                lambda p, k: let(
                    F.slice(ms, p + 1, F.coalesce(F.get(b["st"], k + 1), F.size(ms)) - p), lambda part: profiled(part, b["n"])
                ),
            ),
        )

    profiles = F.array_sort(let(_measures(spans, profile), by_runs))
    return F.transform(profiles, lambda s: s.dropFields("at"))
