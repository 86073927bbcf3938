"""Speakers of raw transcripts, the null rule of the analysis, and emotions of a user model."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.functions.speakers import speaker_spans, word_spans
from calllens.functions.text import clean_transcript
from calllens.functions.tokens import words
from calllens.operators import sentiment as senti
from calllens.operators.conversation import speaker_changes, speaker_profile_text
from calllens.operators.sentiment import word_windows
from calllens.plans.analysis import analyze_calls

CALL = "Hello there. Speaker 1: This is perfect...  really. [music] SPEAKER_02 too expensive! Prospect: When can we start? Speaker 1: great, it's fine"


def calls(spark, *texts):
    return spark.createDataFrame([(i, f"p/{i}.txt", t) for i, t in enumerate(texts)], "call_id bigint, path string, text string")


def spans(spark, text, profile=V31):
    row = calls(spark, text).select(speaker_spans(F.col("text"), profile).alias("s")).first()
    return [(s.speaker, s.text) for s in row.s]


def test_spans(spark):
    assert spans(spark, CALL) == [
        ("primary_speaker", "Hello there."), ("Speaker 1", "This is perfect... really."), ("SPEAKER_02", "too expensive!"),
        ("Prospect", "When can we start?"), ("Speaker 1", "great, it's fine"),
    ]
    assert [s for s, _ in spans(spark, CALL, V30)] == ["primary_speaker", "Speaker 1", "Speaker 1"]
    assert spans(spark, "no tags at all") == [("primary_speaker", "no tags at all")]
    assert spans(spark, "Agent: Agent:  \x02 odd \x03 Agent:") == [("Agent", "odd")]
    assert spans(spark, "") == []


@pytest.mark.parametrize("profile", [V31, V30])
def test_spans_hold_the_words_of_the_cleaned_call(spark, profile):
    texts = [CALL, "A: b-- c --- d. SPEAKER_1:: e", "x:y z: 1:2 Speaker 12 three", "", "only: "]
    got = calls(spark, *texts).select(
        words(clean_transcript(F.col("text"), profile)).alias("all"),
        F.flatten(F.transform(speaker_spans(F.col("text"), profile), lambda s: words(s["text"]))).alias("parts"),
        word_spans(speaker_spans(F.col("text"), profile)).alias("at"),
    )
    for row in got.collect():
        assert row["all"] == row.parts and len(row["at"]) == len(row.parts)


def test_profiles(spark):
    rows = speaker_profile_text(calls(spark, CALL), V31).collect()
    assert [(r.speaker, r.role, r.turn_count, r.word_count) for r in rows] == [
        ("primary_speaker", "unknown", 1, 2), ("Speaker 1", "unknown", 2, 7), ("SPEAKER_02", "unknown", 1, 2),
        ("Prospect", "prospect", 1, 4),
    ]
    assert sum(r.share_pct for r in rows) == pytest.approx(100)
    assert rows[2].concerns == ["expensive"] and rows[2].negative_share == 1.0
    assert all(r.positive_share + r.negative_share + r.neutral_share == pytest.approx(1) for r in rows)


def test_a_moment_has_its_speaker(spark):
    row = analyze_calls(calls(spark, CALL), V31).first()
    assert [(m.phrase, m.speaker) for m in row.moments] == [
        ("This is perfect", "Speaker 1"), ("perfect", "Speaker 1"), ("When can we", "Prospect")
    ]
    assert {m.topic for m in row.moments} == {"general_interest"} and row.confidences["lead_scoring"] == 0.78
    off = analyze_calls(calls(spark, CALL), replace(V31, enable_speakers=False)).first()
    assert off.speakers == [] and {m.speaker for m in off.moments} == {None}


def test_a_call_of_very_many_tags(spark):
    """Every word names a new speaker; the work grows with the spans alone."""
    text = " ".join(f"w{i}: hello" for i in range(5000))
    row = analyze_calls(calls(spark, text), V31).select(F.size("speakers").alias("n"), F.aggregate("speakers", F.lit(0.0), lambda a, s: a + s["share_pct"]).alias("s")).first()
    assert row.n == 5000 and row.s == pytest.approx(100)


def test_a_missing_text_has_the_results_of_the_operators(spark):
    missing, empty = (analyze_calls(calls(spark, t), V31).first() for t in (None, ""))
    alone = senti.ensemble_sentiment(calls(spark, None), V31).first()
    assert missing.text is None and empty.text == ""
    assert (missing.sentiment.score, missing.sentiment.confidence) == (alone.sentiment_score, alone.sentiment_confidence) == (0.0, 0.0)
    assert missing.sentiment.emotions == {"positive": 0.0, "negative": 0.0, "neutral": 1.0} == {e: alone[e] for e in ("positive", "negative", "neutral")}
    for name in ("topics", "speakers", "moments", "key_phrases", "technical_terms", "pricing", "objections", "timeline"):
        assert missing[name] == empty[name] == [], name
    assert missing.lead["class"] == "Warm" and missing.lead.score == 50.0 and missing.lead.interest == []
    assert missing.word_count == 0 and missing.questions.total_questions == 0


def toy():
    """What loads a model: a function defined inside travels to the tasks by value."""

    def load():
        return lambda texts: [{"joy": t.count("joy") / len(t.split()), **({"fear": 1.0} if "fear" in t else {})} for t in texts]

    return load


def test_windows_hold_every_word():
    text = " ".join(map(str, range(23)))
    for size, overlap in ((5, 0), (5, 2), (23, 3), (100, 0), (1, 0)):
        parts = list(word_windows(text, size, overlap))
        joined = [p.split() for p, _ in parts]
        seen = joined[0] + [w for p in joined[1:] for w in p[overlap:]]
        assert seen == text.split() and all(n == len(p) for (_, n), p in zip(parts, joined))
    assert list(word_windows(" \n", 5, 1)) == []


@pytest.mark.parametrize("batch", [1, 2, 50])
def test_emotions_of_long_texts(spark, batch):
    long = "joy " * 30 + "fear " + "calm " * 69
    df = senti.emotion_scores(calls(spark, long, None, "", "joy"), toy(), size=10, overlap=0, batch=batch)
    got = [r.emotions for r in df.orderBy("call_id").collect()]
    assert got == [{"joy": pytest.approx(0.3), "fear": pytest.approx(0.1)}, None, None, {"joy": 1.0}]
    rows = analyze_calls(df, V31, emotions_col="emotions").orderBy("call_id").collect()
    assert rows[0].sentiment.emotions["fear"] == pytest.approx(0.1) and rows[1].sentiment.emotions["neutral"] == 1.0
    with pytest.raises(ValueError):
        senti.emotion_scores(df, toy(), size=4, overlap=4)


def test_speaker_changes_pass_over_unknown_speakers(spark):
    told = {1: "a-b", 2: "a-a", 3: "---", 4: "-ab", 5: "ab-a"}
    rows = [(k, i, None if s == "-" else s) for k, line in told.items() for i, s in enumerate(line)]
    turns = spark.createDataFrame(rows, "call_id int, turn int, speaker string")
    for width in (1, 2, 100):
        got = {r.call_id: r.speaker_changes for r in speaker_changes(turns, bucket_turns=width).collect()}
        assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: 2}
