"""Cleaning, tokens, patterns and extraction on small hand-made texts."""

import pytest
from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.functions import extract, text as tx, tokens as tk
from calllens.functions.arrays import run_lengths
from calllens.lexicons import OBJECTION_PATTERNS, pattern_phrases
from calllens.operators import conversation, extraction, moments, sentiment, topics
from calllens.plans.analysis import FEATURES, analyze_calls, feature_view


def one(spark, value, *columns):
    return spark.createDataFrame([(1, value)], "call_id int, text string").select(*columns).first()


TEXT = F.col("text")
NOISY = "Speaker 1: Hello   [inaudible] at 10:30.... SPEAKER_2: ok ---- bye"


@pytest.mark.parametrize("profile,expected", [
    (V31, ": Hello  at 30... : ok -- bye"),
    (V30, "Hello  at 10:30....  ok ---- bye"),
], ids=["v3.1", "v3.0"])
def test_clean(spark, profile, expected):
    assert one(spark, NOISY, tx.clean_transcript(TEXT, profile))[0] == expected


@pytest.mark.parametrize("value,expected", [
    ("LoudSpeaker 1 said", "LoudSpeaker 1 said"),
    ("Élève: oui", " oui"),
    ("a\t b\n\nc  d", "a b c d"),
    ("no change at all", "no change at all"),
])
def test_clean_details(spark, value, expected):
    tagged = tx.strip_speaker_tags(tx.collapse_whitespace(TEXT), V31)
    assert one(spark, value, tagged)[0] == expected


def test_clean_is_idempotent_on_clean_text(spark):
    once = one(spark, "We met at noon. It went well!", tx.clean_transcript(TEXT, V31))[0]
    assert one(spark, once, tx.clean_transcript(TEXT, V31))[0] == once


def test_tokens_and_sentences(spark):
    row = one(spark, "Don't wait... It's $1.50 now! Élan? ok", tk.tokens(TEXT), tk.sentences(TEXT))
    assert row[0] == ["don't", "wait", "it's", "1", "50", "now", "élan", "ok"]
    assert row[1] == ["Don't wait...", "It's $1.50 now!", "Élan?", "ok"]


def test_ngrams_stay_within_sentences(spark):
    assert one(spark, "a b. c d e", tk.sentence_ngrams(TEXT, 2))[0] == ["a b", "c d", "d e"]
    assert one(spark, "a", tk.sentence_ngrams(TEXT, 3))[0] == []


def test_run_lengths(spark):
    row = one(spark, "b a b c b", run_lengths(F.split(TEXT, " ")))[0]
    assert [(r.term, r.n) for r in row] == [("a", 1), ("b", 3), ("c", 1)]


def test_candidate_phrases(spark):
    text = "The pricing model, a very good deal for our small team"
    assert one(spark, text, tk.candidate_phrases(TEXT, V31.stop_words, 2, 4))[0] == [
        "pricing model", "good deal", "small team"]


def test_key_phrases_drop_blocked_starts_and_add_entities(spark):
    text = "Italian pasta bar. Italian pasta bar, great big kitchen for $20 and 5 % off."
    assert one(spark, text, extraction.key_phrases_array(TEXT, V31))[0] == ["great big kitchen", "$20", "5 %"]


def test_entities(spark):
    text = "We pay $1,200.50 or 15 % for 3 seats at www.foo.com/x, mail a.b@c.example.com about src7 and 1.5"
    got = [(e.label, e.text) for e in one(spark, text, extract.entities(TEXT))[0]]
    assert got == [("MONEY", "$1,200.50"), ("PERCENT", "15 %"), ("CARDINAL", "3"), ("URL", "www.foo.com/x"),
                   ("EMAIL", "a.b@c.example.com"), ("CARDINAL", "1.5")]


def test_entities_need_adjacent_parts(spark):
    assert [(e.label, e.text) for e in one(spark, "$ off 5 then 7 big %", extract.entities(TEXT))[0]] == [
        ("CARDINAL", "5"), ("CARDINAL", "7")]


@pytest.mark.parametrize("profile,expected", [
    (V31, ["API", "Cloud", "NASA", "a@b.co"]), (V30, ["API", "Cloud", "NASA"])], ids=["v3.1", "v3.0"])
def test_technical_terms(spark, profile, expected):
    text = "The API and Cloud of NASA, IT or OK: mail a@b.co"
    assert one(spark, text, extract.technical_terms(TEXT, profile))[0] == expected


def test_interest_moments(spark):
    text = "But we feel the cost is high. How much would pricing be? Wow, I love this. This is perfect"
    df = spark.createDataFrame([(5, text)], "call_id int, text string")
    got = [(r.start, r.phrase, round(r.t, 3)) for r in moments.interest_moments(df, V31).collect()]
    assert got == [(12, "Wow", 189.474), (14, "love this", 221.053), (16, "This is perfect", 252.632), (18, "perfect", 284.211)]
    assert all(r.intensity == 1.0 for r in moments.interest_moments(df, V31).collect())


def test_moment_context_is_cut_to_the_window(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " wow " + " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, text)], "call_id int, text string")
    for profile, k in ((V31, 25), (V30, 30)):
        context = moments.interest_moments(df, profile).first().context.split(" ")
        assert len(context) == 2 * k + 1 and context[0] == f"w{40 - k}" and context[-1] == f"x{k - 1}"


def test_v30_patterns_know_contractions(spark):
    df = spark.createDataFrame([(1, "That's great. What's the price?")], "call_id int, text string")
    assert [r.phrase for r in moments.interest_moments(df, V30).collect()] == ["That's great", "What's the price"]
    assert moments.interest_moments(df, V31).count() == 0


def test_objections_repeat_the_sentence_per_match(spark):
    text = "It is too much and quite expensive. We are not sure, we need to think about it. Fine."
    df = spark.createDataFrame([(2, text)], "call_id int, text string")
    got = [(r.idx, r.sentence[:10]) for r in moments.objections(df, V31).collect()]
    assert got == [(0, "It is too "), (1, "We are not"), (2, "We are not")]


def test_pattern_counts():
    assert len(pattern_phrases(V31.interest_patterns)) == 71
    assert len(pattern_phrases(V30.interest_patterns)) == 80
    assert len(pattern_phrases(OBJECTION_PATTERNS)) == 30


def test_pattern_table_agrees_with_row_form(spark):
    text = "Wow, I love this. This is perfect, when can we go"
    df = spark.createDataFrame([(1, text)], "call_id int, text string")
    table = extraction.pattern_table(spark, V31.interest_patterns)
    joined = {(r.pos, r.phrase) for r in extraction.pattern_matches(df, table).collect()}
    inline = {(r.start, r.phrase.lower()) for r in moments.interest_moments(df, V31).collect()}
    assert joined == inline and len(joined) == 5


def test_competitors_and_pricing(spark):
    text = "Acme Corp is an alternative. Acme Corp called. The fee is $10 and 3 seats. We like Beta versus ACME corp."
    row = one(spark, text, extraction.competitor_array(TEXT, V31, ("acme corp", "beta")),
              extraction.pricing_array(TEXT, V31), extraction.pricing_array(TEXT, V30))
    assert row[0] == ["Acme Corp", "Beta", "ACME corp"]
    assert row[1] == ["$10", "3", "The fee is $10 and 3 seats."]
    assert row[2] == ["$10"]


def test_sentiment_rules(spark):
    rows = [(1, "great"), (2, "not great"), (3, "very great"), (4, "not a very great"), (5, "plain words"), (6, "great but expensive")]
    df = spark.createDataFrame(rows, "call_id int, text string")
    got = {r.call_id: (round(r.compound, 6), r.polarity) for r in sentiment.lexicon_sentiment(df, V31).collect()}

    def norm(x):
        return round(x / (x * x + 15) ** 0.5, 6)

    assert got == {1: (norm(1.0), 1.0), 2: (norm(-0.74), 1.0), 3: (norm(1.293), 1.0),
                   4: (norm(1.293 * -0.74), 1.0), 5: (0.0, 0.0), 6: (0.0, 0.0)}
    lexicon = spark.createDataFrame(list(V31.polarity.items()), "term string, weight double")
    table = {r.call_id: (round(r.compound, 6), r.polarity)
             for r in sentiment.lexicon_sentiment_table(df, lexicon, V31).collect()}
    assert table == got


def test_emotion_shares(spark):
    df = spark.createDataFrame([(1, "great"), (2, "expensive"), (3, None)], "call_id int, text string")
    for r in sentiment.ensemble_sentiment(df, V31).collect():
        assert r.positive + r.negative + r.neutral == pytest.approx(1.0)
        if r.call_id == 3:
            assert (r.sentiment_score, r.sentiment_confidence, r.neutral) == (0.0, 0.0, 1.0)


def test_file_names(spark):
    cases = {"": "empty", "  ": "empty", "../x": "path_traversal", "/x": "path_traversal", "a b": "invalid_characters",
             ".": "outside_prefix", "2024/a-1_b.json": None, "a\x00b": "invalid_characters"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.p for r in rows.select("n", tx.file_name_problem(F.col("n")).alias("p")).collect()} == cases


def test_sizes(spark):
    row = one(spark, "", tx.size_mb(F.lit(2621440)), tx.minutes(F.lit(912.5)), tx.minutes(F.lit(8.7)))
    assert [str(v) for v in row] == ["2.50", "15.21", "0.15"]


def test_trigram_similarity(spark):
    row = one(spark, "", tx.trigram_similarity(F.lit("word"), F.lit("two words")), tx.trigram_similarity(F.lit(""), F.lit("")))
    assert row[0] == pytest.approx(4 / 11) and row[1] == 0.0


def test_text_features(spark):
    text = "How are you? I am interested. Sounds perfect! Can we"
    df = spark.createDataFrame([(1, text), (2, "")], "call_id int, text string")
    first, empty = conversation.text_features(df).orderBy("call_id").collect()
    assert (first.total_word_count, first.unique_word_count, first.sentence_count) == (10, 10, 2)
    assert (first.question_count, first.exclamation_count) == (1, 1)
    assert first.positive_word_ratio == pytest.approx(0.2) and first.question_word_ratio == pytest.approx(0.2)
    assert (empty.total_word_count, empty.avg_sentence_length) == (0, 0.0)


def test_tfidf_matches_the_formula(spark):
    import math
    from dataclasses import replace

    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "banana cherry cherry"), (4, "damson")]
    df = spark.createDataFrame(docs, "call_id int, text string")
    p = replace(V31, ngram_max=1)
    got = {(r.call_id, r.term): r.weight for r in topics.tfidf(df, p).collect()}

    def idf(k):
        return math.log((1 + 4) / (1 + k)) + 1

    a, b = 2 * idf(1), idf(3)
    assert got[(1, "apple")] == pytest.approx(a / math.hypot(a, b))
    assert got[(1, "banana")] == pytest.approx(b / math.hypot(a, b))
    assert got[(4, "damson")] == pytest.approx(1.0)
    unbounded = {(r.call_id, r.term): r.weight for r in topics.tfidf(df, replace(p, max_features=None)).collect()}
    assert unbounded == pytest.approx(got)


def test_analysis_of_one_call(spark):
    text = "Speaker 1: When can we start? How much is the pricing? This is perfect, yes definitely."
    df = spark.createDataFrame([(1, "calls/2024/a.txt", text)], "call_id bigint, path string, text string")
    row = analyze_calls(df, V31).first()
    assert row.file_name == "a.txt" and row.lead["class"] == "Hot" and row.word_count == 14
    assert row.questions.total_questions == 2 and row.questions.open_ended == 1
    assert [m.phrase for m in row.moments] == ["When can we", "This is perfect", "perfect"]
    assert len(row.timeline) == row.flow.total_sentences == 3
    features = feature_view(df, V31).first()
    assert list(features.asDict()) == ["call_id", *FEATURES]
    assert features.speaker_changes == 20.0 and features.interest_signals == 3.0


def test_switches(spark):
    from dataclasses import replace

    df = spark.createDataFrame([(1, "a", "great big deal. great big deal")], "call_id bigint, path string, text string")
    off = replace(V31, enable_sentiment=False, enable_topics=False, enable_emotions=False)
    row = analyze_calls(df, off).first()
    assert row.topics == [] and row.sentiment.score == 0.0 and row.sentiment.emotions == {}
    assert analyze_calls(df, V31).first().topics[0].name == "great big deal"


@pytest.mark.parametrize("k, max_df", [(1, 1.0), (4, 1.0), (4, 0.6), (1000, 0.9)])
def test_frequent_vocabulary_is_the_whole_one(spark, k, max_df):
    texts = ["a b a b c", "a b c a b", "a a a", "d a b", None, "c d c d e", ""]
    lists = spark.createDataFrame([(None if t is None else t.split(),) for t in texts], "w array<string>")
    counts = lists.select(F.inline(run_lengths(tk.ngrams_upto(F.col("w"), 3))))
    want = topics.vocabulary(counts, lists, k, 1, max_df).collect()
    assert want and topics.frequent_vocabulary(lists, "w", 3, k, 1, max_df).collect() == want
