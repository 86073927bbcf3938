"""Whole-call analysis: every text operator in one narrow pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calllens import lexicons as lx
from calllens.config import Profile
from calllens.functions import extract, scoring
from calllens.functions import sentiment as sent
from calllens.functions.arrays import let, strings
from calllens.functions.speakers import TAG, marked_tags, spans_of, speaker_at, speaker_profiles, word_spans
from calllens.functions.text import base_name, clean_tidy, collapse_whitespace, emotions, processing_id, strip_artifacts
from calllens.functions.tokens import candidate_phrases, sentences, words
from calllens.operators import conversation as conv
from calllens.operators import extraction, moments, topics
from calllens.operators.conversation import text_features


def analyze_calls(
    calls: DataFrame,
    profile: Profile,
    names=(),
    sentiment_in_score: bool = False,
    model_col: str | None = None,
    emotions_col: str | None = None,
) -> DataFrame:
    """One nested result row per transcript ``(call_id, path, text)``.

    No stage shuffles: words, sentences, phrases and scanned pieces are computed
    once per row and every result is built from them, so the job is a map over
    the transcripts whatever their number.

    A missing text stays missing and has the lists, sentiment and flow of an empty one;
    only its lead is the neutral one.  ``model_col`` is a signed score that enters the
    sentiment, ``emotions_col`` a map of labels and scores that stands in for the shares
    of the sentiment where it is not null.
    """
    text = F.col("text")
    tidied = calls.withColumn(
        "_tidy", strip_artifacts(collapse_whitespace(F.coalesce(text, F.lit(""))), profile.artifacts)
    ).withColumn("_marked", marked_tags(F.col("_tidy"), profile))
    read = tidied.select(
        "call_id",
        "path",
        text.isNotNull().alias("_known"),
        *([F.col(model_col).alias("_model")] if model_col else [F.lit(0.0).alias("_model")]),
        *([F.col(emotions_col).alias("_emotions")] if emotions_col else []),
        spans_of(F.col("_marked"), profile).alias("_spans"),
        clean_tidy(F.col("_tidy"), profile, F.contains("_marked", F.lit(TAG))).alias("text"),
    )
    split = read.select(
        "*",
        F.lower(text).alias("_lower"),
        words(text).alias("_words"),
        sentences(text).alias("_sents"),
        candidate_phrases(text, profile.stop_words, profile.min_phrase_words, 3).alias("_phrases"),
        extract.scan(text).alias("_pieces"),
    )
    arrays = split.select(
        "*",
        F.transform("_words", lambda w: F.lower(w)).alias("_toks"),
        conv.word_counts(F.col("_sents")).alias("_counts"),
        extract.entities(text).alias("_ents"),
        conv.questions_from(F.col("_sents")).alias("_questions"),
        *[
            extract.matched(F.col("_lower"), getattr(profile, n), prefix=p).alias(f"_{n}")
            for n, p in zip(("interest", "buying", "concern"), profile.prefixes)
        ],
    )
    valued = arrays.withColumn("_values", sent.valences(F.col("_toks"), profile.polarity))
    values = valued.select(
        "*",
        sent.compound(F.col("_toks"), profile, F.col("_values")).alias("_compound"),
        sent.mean_of(F.col("_values")).alias("_polarity"),
        F.size("_toks").alias("_n"),
        *[c.alias(f"_flow_{n}") for n, c in conv.flow_measures(F.col("_sents"), F.col("_counts")).items()],
    )
    mixed = sent.ensemble(F.col("_compound"), F.col("_polarity"), F.col("_model"), profile)
    scored = values.withColumn(
        "_sentiment", mixed if profile.enable_sentiment else F.lit(0.0)
    ).withColumn(
        "_value",
        scoring.score(
            F.size("_interest"), F.size("_buying"), F.size("_concern"), F.when(F.col("_known"), F.col("_n")), profile,
            F.col("_sentiment") if sentiment_in_score else None,
        ),
    ).withColumn("_score", scoring.score_or_neutral(F.col("_value")))
    shares = emotions(F.col("_sentiment")) if profile.enable_emotions else {}
    emotion_map = (
        F.create_map(*[x for n, c in shares.items() for x in (F.lit(n), c)])
        if shares
        else F.create_map().cast("map<string,double>")
    )
    if emotions_col and profile.enable_emotions:
        emotion_map = F.coalesce("_emotions", emotion_map)
    speaker_list = speaker_profiles(F.col("_spans") if profile.enable_speakers else F.slice("_spans", 1, 0), profile)
    moment_topic, follow_up = profile.moment_labels

    def spoken_by(m, of_words):
        if not profile.enable_speakers:
            return F.lit(None).cast("string")
        return speaker_at(F.col("_spans"), of_words, m["start"])

    def moment_list(of_words):
        return F.transform(
            moments.moments_from(F.col("_words"), profile, F.col("_toks"), F.col("_values")),
            lambda m: F.struct(
                m["phrase"].alias("phrase"),
                m["context"].alias("context"),
                m["t"].alias("t"),
                m["intensity"].alias("intensity"),
                F.lit(moment_topic).alias("topic"),
                spoken_by(m, of_words).alias("speaker"),
                F.lit(follow_up).alias("follow_up"),
            ),
        )

    topic_list = (
        F.transform(
            topics.topics_from(F.col("_phrases"), profile.max_topics),
            lambda t: F.struct(t["name"].alias("name"), t["relevance"].alias("relevance")),
        )
        if profile.enable_topics
        else F.array().cast("array<struct<name:string,relevance:double>>")
    )
    competitor_list = (
        extraction.competitors_from(F.col("_sents"), profile, names) if names else strings(())
    )
    questions = conv.question_counts(F.col("_questions"), profile)
    return scored.select(
        "call_id",
        base_name(F.col("path")).alias("file_name"),
        processing_id(F.col("path")).alias("processing_id"),
        F.when(F.col("_known"), text).alias("text"),
        F.col("_n").cast("bigint").alias("word_count"),
        (F.col("_n") / F.lit(profile.words_per_minute)).alias("duration_minutes"),
        F.struct(
            F.col("_sentiment").alias("score"),
            F.greatest("_compound", F.abs("_polarity")).alias("confidence"),
            emotion_map.alias("emotions"),
        ).alias("sentiment"),
        topic_list.alias("topics"),
        speaker_list.alias("speakers"),
        let(F.when(F.size("_spans") > 1, word_spans(F.col("_spans"))), moment_list).alias("moments"),
        F.struct(
            scoring.class_or_neutral(F.col("_value"), profile).alias("class"),
            F.col("_score").alias("score"),
            scoring.confidence_or_neutral(F.col("_value"), profile).alias("confidence"),
            F.col("_interest").alias("interest"),
            F.col("_buying").alias("buying"),
            F.col("_concern").alias("concerns"),
            scoring.personality(F.col("_lower"), profile).alias("personality"),
            scoring.decision_style(F.col("_lower")).alias("decision"),
            scoring.strategy(F.size("_concern"), profile).alias("strategy"),
            strings(profile.next_actions).alias("next_actions"),
            F.col("_concern").alias("risk_factors"),
            (F.col("_score") / 100).alias("conversion_probability"),
        ).alias("lead"),
        extraction.key_phrases_from(
            F.col("_phrases"), F.col("_ents"), F.col("_toks"), profile, names
        ).alias("key_phrases"),
        extract.technical_from(F.col("_pieces"), profile).alias("technical_terms"),
        competitor_list.alias("competitors"),
        extraction.pricing_from(F.col("_ents"), F.col("_sents"), profile).alias("pricing"),
        moments.objections_from(F.col("_sents"), profile).alias("objections"),
        F.struct(
            F.col("_flow_total_sentences").alias("total_sentences"),
            F.try_divide("_flow__words", "_flow_total_sentences").alias("average_sentence_length"),
            F.col("_flow_question_count").alias("question_count"),
            F.col("_flow_exclamation_count").alias("exclamation_count"),
            F.lit("moderate").alias("conversation_pace"),
        ).alias("flow"),
        conv.timeline_from(F.col("_counts"), profile).alias("timeline"),
        F.struct(
            *[c.alias(n) for n, c in questions.items()],
            F.slice("_questions", 1, profile.sample_questions).alias("sample_questions"),
        ).alias("questions"),
        F.create_map(*[F.lit(x) for pair in profile.confidences for x in pair]).alias("confidences"),
    )


FEATURES = (
    "sentiment_score",
    "avg_sentence_length",
    "question_count",
    "positive_word_ratio",
    "engagement_score",
    "response_time_avg",
    "technical_terms_count",
    "call_duration_minutes",
    "speaker_changes",
    "interest_signals",
)

# What stands in for a measure a call does not have.
DEFAULTS = {
    "sentiment_score": 0.0,
    "avg_sentence_length": 15.0,
    "question_count": 0,
    "positive_word_ratio": 0.0,
    "engagement_score": 5.0,
    "response_time_avg": 5.0,
    "technical_terms_count": 0,
    "call_duration_minutes": 15.0,
    "speaker_changes": 20,
    "interest_signals": 0,
}


def default_fill(df: DataFrame) -> DataFrame:
    """Replace missing features by their defaults."""
    present = {c: v for c, v in DEFAULTS.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in present.items()})


def metadata_features(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Features held in a JSON metadata column, typed and defaulted."""
    def field(name: str, kind: str):
        return F.get_json_object(metadata, f"$.{name}").try_cast(kind)

    return default_fill(
        df.select(
            "*",
            field("avg_sentence_length", "double").alias("avg_sentence_length"),
            field("engagement_score", "double").alias("engagement_score"),
            field("response_time_avg", "double").alias("response_time_avg"),
            field("call_duration_minutes", "double").alias("call_duration_minutes"),
            field("speaker_changes", "bigint").alias("speaker_changes"),
        )
    )


def feature_view(
    calls: DataFrame,
    profile: Profile,
    changes: DataFrame | None = None,
    responses: DataFrame | None = None,
    positive=lx.FEATURE_POSITIVE,
) -> DataFrame:
    """The ten named features of each transcript ``(call_id, text)``.

    ``changes`` and ``responses`` (``call_id`` plus one measure) are joined when a
    diarised or timed form of the calls exists; otherwise the defaults stand in.
    """
    base = analyze_calls(
        calls.withColumn("path", F.lit("")) if "path" not in calls.columns else calls, profile
    )
    measured = base.select(
        "call_id",
        F.col("sentiment.score").alias("sentiment_score"),
        (
            F.try_divide(
                F.aggregate("timeline", F.lit(0.0), lambda a, p: a + p["v"]), F.size("timeline")
            )
            * 10
        ).alias("engagement_score"),
        F.size("topics").alias("technical_terms_count"),
        F.col("duration_minutes").alias("call_duration_minutes"),
        F.size("moments").alias("interest_signals"),
        "text",
    )
    # the linguistic features come from the same row, so no join is needed
    rows = text_features(measured, "call_id", "text", positive, keep=measured.columns[1:-1])
    if changes is not None:
        rows = rows.join(changes.select("call_id", "speaker_changes"), "call_id", "left")
    else:
        rows = rows.withColumn("speaker_changes", F.lit(None).cast("bigint"))
    if responses is not None:
        rows = rows.join(responses.select("call_id", "response_time_avg"), "call_id", "left")
    else:
        rows = rows.withColumn("response_time_avg", F.lit(None).cast("double"))
    return default_fill(rows).select("call_id", *[F.col(f).cast("double").alias(f) for f in FEATURES])
