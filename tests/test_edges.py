"""Inputs the given tables do not hold: missing texts, odd names, broken files."""

import json

import pytest
from pyspark.sql import functions as F

from calllens import V31
from calllens.functions import text as tx
from calllens.operators import conversation, extraction, listing, quality, scoring, topics
from calllens.plans.analysis import analyze_calls
from calllens.session import scratch_dir, small_table
from calllens.sources import files


def frame(spark, *texts):
    return spark.createDataFrame([(i, f"x/{i}.txt", t) for i, t in enumerate(texts)], "call_id int, path string, text string")


def test_one_rule_for_a_missing_text(spark):
    calls = frame(spark, None, "")
    lead = analyze_calls(calls, V31).select("call_id", "lead.*", "word_count", "flow.total_sentences").collect()
    plain = scoring.lead_score(calls, V31).collect()
    assert [(r["class"], r.score, r.confidence, r.word_count, r.total_sentences) for r in lead][0] == ("Warm", 50.0, 0.5, 0, 0)
    assert [(r.lead_class, r.lead_score, r.lead_confidence) for r in plain][0] == ("Warm", 50.0, 0.5)
    # an empty text is one, and scores by the usual rule
    assert lead[1].score == plain[1].lead_score == 50.0 and lead[1].confidence == plain[1].lead_confidence == 0.8
    turns = spark.createDataFrame([(1, 1, None), (2, 1, "hi")], "call_id int, turn int, text string")
    got = {r.call_id: (r.lead_class, r.lead_score, r.lead_confidence) for r in scoring.lead_score_turns(turns, V31).collect()}
    assert got[1] == ("Warm", 50.0, 0.5) and got[2][2] == 0.8


def test_a_missing_sentiment_stays_missing(spark):
    df = spark.createDataFrame([(None,), (3.0,), (-0.5,)], "s double")
    shares = tx.emotions(F.col("s"))
    assert [tuple(r) for r in df.limit(1).select(*shares.values()).collect()] == [(None, None, None)]
    assert [r.c for r in df.select(tx.clamp(F.col("s"), -1.0, 1.0).alias("c")).collect()] == [None, 1.0, -0.5]
    results = df.select(
        F.lit("a").alias("file_name"), F.lit("t").alias("text"), F.col("s").alias("sentiment"), F.array().alias("key_phrases"),
        F.array().alias("topics"), F.array().alias("moments"), F.lit("Hot").alias("lead_class"), F.lit(1.0).alias("confidence"),
        F.lit(1.0).alias("duration_minutes"),
    )
    assert [r.sentiment for r in listing.response_view(results).collect()] == [None, 1.0, -0.5]


NAMES = ("Coca-Cola", "bank of new york mellon", "O\'Neill & Sons", "---")


def test_names_are_cut_as_texts_are(spark):
    text = "We compared Coca-Cola with the Bank of New York Mellon. Their competitor O\'Neill & Sons is cheaper."
    df = frame(spark, text)
    phrases = [r.phrase for r in extraction.key_phrases(df, V31, NAMES).collect()]
    assert {"coca cola", "bank of new york mellon", "o\'neill sons"} <= set(phrases)
    table = small_table(spark, [(n, "ORG") for n in NAMES], ["name", "label"])
    found = extraction.gazetteer_join(extraction.sentence_rows(df), table).collect()
    assert {(r.phrase, r.n) for r in found} == {("coca cola", 2), ("bank of new york mellon", 5), ("o\'neill sons", 2)}
    assert not extraction.gazetteer_join(extraction.sentence_rows(df), table.where("name = '---'")).count()


def test_search_terms_are_cut_as_texts_are(spark):
    df = frame(spark, "A follow-up on pricing, please.", "the price", None)
    for query in ("follow-up", "pricing?", "Follow-Up PRICING!"):
        assert [r.call_id for r in topics.fulltext_search(df, query, 5, V31.stop_words).collect()] == [0]
    with pytest.raises(ValueError):
        topics.fulltext_search(df, "?!", 5, V31.stop_words)


def test_blanks_of_all_scripts(spark):
    df = spark.createDataFrame([("\u00a0a\u2003 b\x1cc\u3000\n",), ("  ",), (None,)], "t string")
    assert [r.c for r in df.select(tx.collapse_whitespace(F.col("t")).alias("c")).collect()] == ["a b c", "", None]
    blank = spark.createDataFrame([("\u00a0\u2003",)], "t string")
    assert blank.select(quality.reject_reason(F.col("t")).alias("r")).first().r == "blank"


def test_file_names_with_a_line_break_are_refused_alike(spark):
    df = spark.createDataFrame([("a.json\n",), ("a.json",)], "file_name string")
    assert [r.reason for r in listing.validate_file_names(df).collect()] == ["invalid_characters", None]
    with pytest.raises(ValueError):
        listing.get_call(df, "a.json\n")


def test_turns_without_text_stay(spark):
    turns = spark.createDataFrame(
        [(1, 1, "great"), (1, 4, None), (1, 9, "great"), (1, 10, "great")], "call_id int, turn int, text string"
    )
    got = {r.turn: (r.sentiment, round(r.moving_sentiment, 6)) for r in conversation.sentiment_progression(turns, V31).collect()}
    assert got == {1: (1.0, 1.0), 4: (0.0, 0.5), 9: (1.0, 0.666667), 10: (1.0, 0.666667)}


def test_broken_transcripts_are_told_apart(spark, tmp_path):
    for name, body in {"a.json": '{"transcript":"hi"}', "b.json": '{"transcript": "hi"', "c.txt": '{"transcript": "hi"', "d.txt": " "}.items():
        (tmp_path / name).write_text(body)
    good, bad = files.accepted(files.read_transcripts(spark, str(tmp_path), V31))
    assert {r.file_name: r.text for r in good.collect()} == {"a.json": "hi", "c.txt": '{"transcript": "hi"'}
    assert {r.file_name: (r.text, r.problem) for r in bad.collect()} == {"b.json": (None, "bad_json"), "d.txt": (" ", "blank")}


def test_indented_and_broken_results(spark, tmp_path):
    doc = {"call_id": "3f0e-uuid", "file_name": "a.txt", "lead": {"class": "Hot", "score": 90.5}}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "one" / "b.json").write_text("{ not json")
    got = files.read_results(spark, str(tmp_path / "one"), indented=True).collect()
    assert sorted((r.call_id or "", r.lead.score if r.lead else None, r.problem) for r in got) == [("", None, "malformed"), ("3f0e-uuid", 90.5, None)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text(json.dumps(doc) + "\n{ not json\n")
    good, bad = files.accepted(files.read_results(spark, str(tmp_path / "lines")))
    assert [r.call_id for r in good.collect()] == ["3f0e-uuid"] and bad.count() == 1


def test_result_rules(spark):
    rows = [("Hot", "completed", 0.5, 0.0, 50.0, "a"), ("Hot!", "done", 2.0, -3.0, 101.0, None), (None, None, None, None, None, "b")]
    df = spark.createDataFrame(rows, "lead_class string, status string, confidence double, sentiment double, score double, file_name string")
    got = quality.check_constraints(df, quality.result_rules()).collect()
    assert [r.violations for r in got] == [[], ["lead_class", "status", "confidence", "sentiment", "score", "file_name"], []]


def test_scratch_needs_a_shared_folder_off_this_machine(monkeypatch):
    class Conf:
        def __init__(self, root):
            self.root = root

        def get(self, key, default=None):
            return self.root

    class Session:
        def __init__(self, master, root=None):
            self.conf, self.sparkContext = Conf(root), type("C", (), {"master": master})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_dir(Session(master), "x")
        assert scratch_dir(Session(master, "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert scratch_dir(Session("local[2]"), "x")
