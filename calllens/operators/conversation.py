"""Measures of how a conversation runs.

Operators taking ``by_turn=True`` accept one row per turn and merge the turns of
a call by partial aggregation; otherwise each row is a whole transcript and the
result is computed inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens import lexicons as lx
from calllens.config import Profile
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let, rows_of
from calllens.functions.extract import contains_any
from calllens.functions.speakers import speaker_profiles, speaker_spans
from calllens.functions.text import sentiment_bucket
from calllens.functions.tokens import sentences, token_count, tokens, whitespace_words
from calllens.operators.ordered import count_changes, running_totals


def word_counts(sents: Column) -> Column:
    """Whitespace-separated words per sentence."""
    return F.transform(sents, lambda s: F.regexp_count(s, F.lit(r"\S+")))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)


def flow_measures(sents: Column, counts: Column | None = None) -> dict[str, Column]:
    """``counts`` are the :func:`word_counts`, where they are at hand."""

    def ending(mark: str) -> Column:
        return F.size(F.filter(sents, lambda s: F.endswith(s, F.lit(mark)))).cast("bigint")

    return {
        "total_sentences": F.size(sents).cast("bigint"),
        "_words": _total(word_counts(sents) if counts is None else counts),
        "question_count": ending("?"),
        "exclamation_count": ending("!"),
    }


def conversation_flow(
    df: DataFrame, key: str = "call_id", text: str = "text", by_turn: bool = False
) -> DataFrame:
    """Sentence count, mean words per sentence, questions, exclamations."""
    staged = df.select(key, sentences(F.col(text)).alias("_s"))
    measures = flow_measures(F.col("_s"))
    rows = staged.select(key, *[c.alias(n) for n, c in measures.items()])
    if by_turn:
        rows = rows.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])
    return rows.select(
        key,
        "total_sentences",
        F.try_divide("_words", "total_sentences").alias("average_sentence_length"),
        "question_count",
        "exclamation_count",
        F.lit("moderate").alias("conversation_pace"),
    )


def questions_from(sents: Column) -> Column:
    return F.filter(sents, lambda s: F.endswith(s, F.lit("?")))


def question_counts(q: Column, profile: Profile) -> dict[str, Column]:
    def count(test) -> Column:
        return F.size(F.filter(q, test)).cast("bigint")

    return {
        "total_questions": F.size(q).cast("bigint"),
        "open_ended": count(lambda s: contains_any(F.lower(s), profile.open_ended)),
        "yes_no": count(
            lambda s: F.arrays_overlap(
                F.slice(F.split(F.lower(s), r"\s+"), 1, 2), F.array(*[F.lit(w) for w in profile.yes_no])
            )
        ),
        "clarifying": count(lambda s: contains_any(F.lower(s), profile.clarifying)),
    }


def question_summary(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """Question counts by category and the first questions of each transcript row."""
    staged = df.select(key, questions_from(sentences(F.col(text))).alias("_q"))
    return staged.select(
        key,
        *[c.alias(n) for n, c in question_counts(F.col("_q"), profile).items()],
        F.slice("_q", 1, profile.sample_questions).alias("sample_questions"),
    )


def question_summary_turns(
    turns: DataFrame, profile: Profile, key: str = "call_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """As :func:`question_summary` for one row per turn.

    The sample keeps at most k rows per call on each side of the shuffle (a
    ranked filter), never the whole call.
    """
    staged = turns.select(key, turn, questions_from(sentences(F.col(text))).alias("_q"))
    names = list(question_counts(F.col("_q"), profile))
    counted = (
        staged.select(key, *[c.alias(n) for n, c in question_counts(F.col("_q"), profile).items()])
        .groupBy(key)
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    each = staged.select(key, turn, rows_of(F.col("_q"), "_text", "_i"))
    order = W.partitionBy(key).orderBy(turn, "_i")
    samples = (
        each.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= profile.sample_questions)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_r", "_text"))).alias("_rows"))
        .select(key, F.transform("_rows", lambda r: r["_text"]).alias("sample_questions"))
    )
    return counted.join(samples, key, "left").withColumn(
        "sample_questions", F.coalesce("sample_questions", F.array().cast("array<string>"))
    )


def engagement(word_count: Column, profile: Profile) -> Column:
    return F.least(F.lit(1.0), word_count / F.lit(profile.timeline_words))


def timeline_array(sents: Column, profile: Profile) -> Column:
    """``array<struct<t, v>>`` over the sentences of one transcript."""
    return timeline_from(word_counts(sents), profile)


def timeline_from(counts: Column, profile: Profile) -> Column:
    """The timeline of sentences whose words are counted."""
    return let(
        counts,
        lambda ns: F.transform(
            ns,
            lambda n, i: F.struct(
                (i / F.size(ns) * F.lit(profile.call_seconds)).alias("t"),
                engagement(n, profile).alias("v"),
            ),
        ),
    )


def engagement_timeline(
    df: DataFrame, profile: Profile, key: str = "call_id", text: str = "text"
) -> DataFrame:
    """One row per sentence ``(key, idx, t, v)``; the total comes from the array size."""
    points = timeline_array(sentences(F.col(text)), profile)
    numbered = F.transform(
        points, lambda p, i: F.struct(i.alias("idx"), p["t"].alias("t"), p["v"].alias("v"))
    )
    return df.select(key, F.inline(numbered))


def text_features(
    df: DataFrame, key: str = "call_id", text: str = "text",
    positive=lx.FEATURE_POSITIVE, question_words=lx.FEATURE_QUESTION, keep=(),
) -> DataFrame:
    """Linguistic features of each transcript: array functions only, no shuffle."""
    staged = df.select(
        key,
        *keep,
        F.filter(
            F.transform(F.split(text, r"\."), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))),
            lambda s: s != "",
        ).alias("_s"),
        whitespace_words(F.lower(text)).alias("_w"),
    )
    n_words, n_sents = F.size("_w"), F.size("_s")

    def having(mark: str) -> Column:
        return F.size(F.filter("_s", lambda s: F.contains(s, F.lit(mark)))).cast("bigint")

    return staged.select(
        key,
        *keep,
        n_words.cast("bigint").alias("total_word_count"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("unique_word_count"),
        n_sents.cast("bigint").alias("sentence_count"),
        (n_words / F.greatest(n_sents, F.lit(1))).alias("avg_sentence_length"),
        having("?").alias("question_count"),
        having("!").alias("exclamation_count"),
        (
            F.size(F.filter("_w", lambda w: contains_any(w, positive)))
            / F.greatest(n_words, F.lit(1))
        ).alias("positive_word_ratio"),
        (
            F.size(F.filter("_w", lambda w: w.isin(*question_words)))
            / F.greatest(n_words, F.lit(1))
        ).alias("question_word_ratio"),
    )


def speaker_profile(
    turns: DataFrame, profile: Profile, key: str = "call_id", speaker: str = "speaker", text: str = "text"
) -> DataFrame:
    """Per speaker of a call: share of words, sentiment shares, engagement, concerns."""
    staged = turns.select(
        key,
        speaker,
        token_count(F.col(text)).alias("_words"),
        sent.mean_valence(tokens(F.col(text)), profile.polarity).alias("_polarity"),
        F.transform(
            word_counts(sentences(F.col(text))), lambda n: engagement(n, profile)
        ).alias("_eng"),
        *[
            F.contains(F.lower(text), F.lit(t)).alias(f"_c{i}") for i, t in enumerate(profile.concern)
        ],
    )
    bucket = sentiment_bucket(F.col("_polarity"))
    flags = [f"_c{i}" for i in range(len(profile.concern))]
    spoken = staged.groupBy(key, speaker).agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.sum("_words").alias("word_count"),
        *[
            F.avg((bucket == name).cast("double")).alias(f"{name.lower()}_share")
            for name in ("Positive", "Negative", "Neutral")
        ],
        F.sum(F.aggregate("_eng", F.lit(0.0), lambda a, x: a + x)).alias("_eng_sum"),
        F.sum(F.size("_eng")).alias("_eng_n"),
        *[F.max(f).alias(f) for f in flags],
    )
    # one row per speaker by now, however many turns the call had
    total = F.sum("word_count").over(W.partitionBy(key))
    picks = [F.when(F.col(f), F.lit(t)) for f, t in zip(flags, profile.concern)]
    return spoken.select(
        key,
        speaker,
        "turn_count",
        "word_count",
        (F.try_divide(F.col("word_count"), total) * 100).alias("share_pct"),
        "positive_share",
        "negative_share",
        "neutral_share",
        F.coalesce(F.try_divide("_eng_sum", "_eng_n"), F.lit(0.0)).alias("engagement"),
        F.array_compact(F.array(*picks)).alias("concerns"),
    )


def speaker_profile_text(calls: DataFrame, profile: Profile, key: str = "call_id", text: str = "text") -> DataFrame:
    """As :func:`speaker_profile` for whole transcripts that hold their speaker tags; one
    row per call and speaker, computed inside the call's row."""
    return calls.select(key, F.inline(speaker_profiles(speaker_spans(F.col(text), profile), profile)))


def speaker_changes(
    turns: DataFrame, key: str = "call_id", turn: str = "turn", speaker: str = "speaker",
    bucket_turns: int = 4096,
) -> DataFrame:
    """Turns whose speaker differs from that of the turn before, per call; turns without a
    speaker are passed over."""
    return count_changes(
        turns, [key], turn, speaker, F.floor(F.col(turn) / F.lit(bucket_turns)), "speaker_changes"
    )


def response_time_avg(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Mean seconds between consecutive events of a key.

    The gaps telescope to (last - first) / (n - 1), so the rows need no ordering:
    three partial aggregates replace a window over the key.
    """
    span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    return events.groupBy(key).agg(
        (F.try_divide(span, F.count(ts) - 1) / F.lit(1e6)).alias("response_time_avg"),
        F.count(ts).alias("event_count"),
    )


def sentiment_progression(
    turns: DataFrame, profile: Profile, key: str = "call_id", turn: str = "turn",
    text: str = "text", window: int = 3, bucket_turns: int = 4096,
) -> DataFrame:
    """Polarity per turn and its moving mean over the last ``window`` turns.

    A turn without a text counts as neutral.  Turns are numbered along the call by
    buckets, then each sends its value to the turns it contributes to, and the mean is
    a plain aggregate keyed by (call, number): no task ever holds a whole call.
    """
    valence = F.coalesce(sent.mean_valence(tokens(F.col(text)), profile.polarity), F.lit(0.0))
    valued = running_totals(
        turns.select(key, turn, valence.alias("_v")), [key], [F.col(turn)],
        F.floor(F.col(turn) / F.lit(bucket_turns)), {"_number": F.lit(1).cast("bigint")},
    )
    offsets = F.array(*[F.lit(i) for i in range(window)])
    spread = valued.select(
        key, F.col(turn), F.col("_number"), F.col("_v"), F.explode(offsets).alias("_o")
    ).select(
        key,
        (F.col("_number") + F.col("_o")).alias("_number"),
        F.col("_v"),
        F.when(F.col("_o") == 0, F.col("_v")).alias("_own"),
        F.when(F.col("_o") == 0, F.col(turn)).alias(turn),
    )
    return (
        spread.groupBy(key, "_number")
        .agg(F.max(turn).alias(turn), F.max("_own").alias("sentiment"), F.avg("_v").alias("moving_sentiment"))
        .where(F.col("sentiment").isNotNull())
        .drop("_number")
    )
