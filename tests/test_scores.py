"""Hand-worked calls: scores, thresholds, signals and insight labels."""

import pytest
from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.functions import scoring as sc
from calllens.functions.text import sentiment_bucket
from calllens.operators import quality, scoring

CALLS = [
    (1, "When can we start? How much is the pricing? This is perfect, yes definitely."),
    (2, "It is too much and quite expensive. We are not sure, we need to think about budget constraints."),
    (3, "Please call back next week."),
    (4, "I saw the eyes of the data team."),
    (5, "But we feel the cost is high. How much would pricing be? Wow, I love this."),
]
EXPECTED = {
    V31.name: {1: (14, 100.0, "Hot"), 2: (18, 28.225, "Unqualified"), 3: (5, 50.0625, "Cold"),
               4: (8, 62.1, "Warm"), 5: (16, 100.0, "Hot")},
    V30.name: {1: (14, 100.0, "Hot"), 2: (18, 40.18, "Cold"), 3: (5, 50.05, "Warm"),
               4: (8, 60.08, "Warm"), 5: (16, 100.0, "Hot")},
}


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, "call_id int, text string")


@pytest.mark.parametrize("profile", [V31, V30], ids=lambda p: p.name)
def test_lead_score(calls, profile):
    got = {
        r.call_id: (r.token_count, round(r.lead_score, 6), r.lead_class)
        for r in scoring.lead_score(calls, profile).collect()
    }
    assert got == EXPECTED[profile.name]


@pytest.mark.parametrize("profile", [V31, V30], ids=lambda p: p.name)
def test_turn_form_agrees_with_row_form(calls, profile):
    rows = {r.call_id: (r.lead_score, r.lead_class) for r in scoring.lead_score(calls, profile).collect()}
    turns = {r.call_id: (r.lead_score, r.lead_class) for r in scoring.lead_score_turns(calls, profile).collect()}
    assert rows == turns


def test_turns_are_merged_not_joined(spark):
    turns = spark.createDataFrame(
        [(1, 0, "It sounds"), (1, 1, "good, yes"), (1, 2, "yes and pricing?")], "call_id int, turn int, text string"
    )
    row = scoring.lead_score_turns(turns, V31).first()
    # "sounds good" lies across two turns; "yes" counts once
    assert (row.n_interest, row.n_buying, row.token_count) == (1, 1, 7)
    assert row.interest_signals == ["Expressed: yes"]


def test_missing_text_takes_the_fallback(spark):
    row = scoring.lead_score(spark.createDataFrame([(1, None)], "call_id int, text string"), V31).first()
    assert (row.lead_class, row.lead_score, row.lead_confidence) == ("Warm", 50.0, 0.5)


def test_bootstrap(spark, calls):
    with_blank = calls.union(spark.createDataFrame([(6, "   ")], "call_id int, text string"))
    labels = {r.call_id: r.label for r in scoring.bootstrap_score(with_blank).collect()}
    assert labels == {1: "Hot", 2: "Cold", 3: "Warm", 4: "Cold", 5: "Hot"}
    rejected = quality.reject_invalid(with_blank)[1].collect()
    assert [(r.call_id, r.reason) for r in rejected] == [(6, "blank")]


@pytest.mark.parametrize("profile,cases", [
    (V31, {79.999: "Warm", 80.0: "Hot", 59.999: "Cold", 60.0: "Warm", 29.999: "Unqualified", 30.0: "Cold"}),
    (V30, {74.999: "Warm", 75.0: "Hot", 49.999: "Cold", 50.0: "Warm"}),
], ids=["v3.1", "v3.0"])
def test_class_thresholds(spark, profile, cases):
    scores = spark.createDataFrame([(v,) for v in cases], "score double")
    got = {r.score: r.c for r in scores.select("score", sc.lead_class(F.col("score"), profile).alias("c")).collect()}
    assert got == cases


def test_sentiment_bucket_edges(spark):
    cases = {0.2: "Neutral", 0.2001: "Positive", -0.2: "Neutral", -0.2001: "Negative", None: None}
    rows = spark.createDataFrame([(v,) for v in cases], "s double")
    assert {r.s: r.b for r in rows.select("s", sentiment_bucket(F.col("s")).alias("b")).collect()} == cases


def test_insights(calls):
    got = {r.call_id: r for r in scoring.insight_labels(calls, V31).collect()}
    assert got[4].personality == "Analytical" and got[4].decision_style == "Individual"
    assert got[3].decision_style == "Collaborative"  # "we" inside "week"
    assert got[2].strategy == "Focus on addressing concerns"
    assert got[1].strategy == "Accelerate engagement"
    assert got[1].next_actions == ["Schedule follow-up", "Send additional information", "Prepare proposal"]


def test_a_word_can_be_buying_and_concern_in_v30(calls):
    row = scoring.signal_extract(calls.where("call_id = 2"), V30).first()
    assert "Asked about: budget" in row.buying_signals
    assert "Expressed concern about: budget" in row.concern_signals


def test_token_match_ignores_words_inside_words(calls):
    loose = scoring.lead_score(calls.where("call_id = 4"), V31).first().n_interest
    strict = scoring.lead_score(calls.where("call_id = 4"), V31, match="token").first().n_interest
    assert (loose, strict) == (1, 0)


def test_sentiment_term_is_weighted(calls):
    plus = calls.withColumn("s", F.lit(-1.0)).where("call_id = 4")
    assert scoring.lead_score(plus, V31, sentiment_col="s").first().lead_score == pytest.approx(47.1)
    assert scoring.lead_score(plus, V30, sentiment_col="s").first().lead_score == pytest.approx(40.08)


def test_a_concern_never_raises_the_score(calls):
    base = {r.call_id: r.lead_score for r in scoring.lead_score(calls, V31).collect()}
    worse = calls.withColumn("text", F.concat("text", F.lit(" not sure")))
    for r in scoring.lead_score(worse, V31).collect():
        # two more words add 2/80 of a point at most
        assert r.lead_score <= base[r.call_id] + 0.025
        assert 0 <= r.lead_score <= 100
