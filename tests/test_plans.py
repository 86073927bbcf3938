"""What the plans must and must not contain."""

import re

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from calllens import V31
from calllens.operators import conversation, listing, moments, scoring, topics
from calllens.plans.analysis import analyze_calls
from calllens.sources import tables

TRAINING = {"random_forest", "gradient_boosting", "cross_validate", "feature_importance", "saved_model",
            "text_classifier", "embedding_classes", "random_forest_rows", "gradient_boosting_rows", "boosted_rounds",
            "saved_model_rows", "feature_importance_names", "cross_validate_folds", "text_classifier_rows"}
# queries that write before they return; their plan is only the read back
STORED = {"stuck_jobs", "ingest_stream", "analyze_stream", "dedupe_requests", "running_performance_stream",
          "read_transcripts_v31", "read_transcripts_v30", "write_read_results", "results_by_day"}
PYTHON = {"model_scores", "analysis_emotions"}


@pytest.fixture(scope="module")
def many_splits(spark, small):
    """Transcripts as they lie."""
    return spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("call_id"), F.col("source").alias("path"), "text"
    )


@pytest.mark.parametrize("operator", [
    lambda d: analyze_calls(d, V31, ("acme",)),
    lambda d: scoring.lead_score(d, V31),
    lambda d: moments.interest_moments(d, V31),
    lambda d: conversation.text_features(d),
    lambda d: conversation.engagement_timeline(d, V31),
    lambda d: topics.phrase_frequency(d, V31),
    lambda d: topics.topic_rows(d, V31),
])
def test_row_operators_do_not_shuffle(many_splits, operator):
    plan = plan_of(operator(many_splits))
    assert "Exchange" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, small):
    calls = tables.analysis_results(spark, small)
    plan = plan_of(listing.search_calls(calls, date_range=("2024-01-03", "2024-01-05")).select("call_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "props" not in columns and "user_id" not in columns


def test_listing_never_reads_transcripts(spark, small):
    names = tables.transcripts(spark, small).select("file_name", "uploader")
    assert "text:string" not in plan_of(names)


def test_page_is_a_top_k(spark, small):
    plan = plan_of(listing.list_calls(tables.analysis_results(spark, small), 2, 20))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_large_lexicons_are_not_forced_to_broadcast(spark):
    from calllens.operators.extraction import lexicon_join

    toks = spark.range(10).select(F.lit(1).alias("call_id"), F.col("id").cast("string").alias("tok"))
    big = spark.range(5_000_000).select(F.col("id").cast("string").alias("term"), F.lit("x").alias("category"))
    assert "SortMergeJoin" in plan_of(lexicon_join(toks.union(toks), big)) or "BuildLeft" in plan_of(lexicon_join(toks, big))


@pytest.mark.parametrize("name", [n for n in entry_module.QUERIES if n not in TRAINING | STORED])
def test_registered_plans(spark, small, name):
    plan = plan_of(entry_module.QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[.*\], \[\]", plan), "window over the whole table"
    assert ("Python" in plan) == (name in PYTHON)


def test_tfidf_has_one_exchange_by_call_after_the_vocabulary(spark, small):
    plan = plan_of(topics.tfidf(tables.transcripts(spark, small), V31))
    by_call = re.findall(r"Exchange hashpartitioning\(call_id#\d+", plan)
    assert len(by_call) == 1


def test_sessions_reduce_before_the_first_window(spark, small):
    from calllens.streaming.events import user_sessions

    plan = plan_of(user_sessions(tables.read_table(spark, small, "events")))
    assert len(re.findall(r"\bWindow \[", plan)) == 2 and "partial_min" in plan


def test_names_meet_by_first_word(spark, small):
    from calllens.operators import extraction
    from catalog.views import names_table

    sents = extraction.sentence_rows(tables.transcripts(spark, small))
    plan = plan_of(extraction.gazetteer_join(sents, names_table(spark)))
    assert "_first" in plan and "CartesianProduct" not in plan


def test_patterns_meet_as_a_trie(spark):
    """No n-gram is built, and the tokens kept are those that some pattern holds."""
    from calllens.operators import extraction

    rows = [(1, "we want to buy now and buy it now buy"), (2, None), (3, "to to to to buy to")]
    df = spark.createDataFrame(rows, "call_id int, text string")
    phrases = ["buy", "buy it now", "want to buy", "to to to", "never said at all", "now buy"]
    table = spark.createDataFrame([(len(p.split()), p) for p in phrases], "n int, phrase string")
    got = sorted((r.call_id, r.pos, r.n, r.phrase) for r in extraction.pattern_matches(df, table).collect())
    want = []
    for key, text in rows:
        toks = (text or "").split()
        want += [(key, i, len(p.split()), p) for p in phrases for i in range(len(toks)) if toks[i : i + len(p.split())] == p.split()]
    assert got == sorted(want)
    assert extraction.pattern_matches(df, table.limit(0)).collect() == []
    edges = {(r.parent, r.tok): (r.depth, r.ends) for r in extraction.pattern_trie(table).collect()}
    assert edges["buy", "it"] == (2, False) and edges["", "buy"] == (1, True) and edges["to to", "to"] == (3, True)


def test_context_windows_leave_far_tokens_out_before_the_shuffle(spark):
    from calllens.operators import extraction

    toks = spark.range(100_000).select((F.col("id") % 50).alias("call_id"), F.floor(F.col("id") / 50).alias("pos"), F.lit("w").alias("tok"))
    hits = toks.where("pos = 1000 AND call_id < 5").select("call_id", F.col("pos").alias("start"), F.lit(1).alias("n"))
    found = extraction.context_window(hits, toks, 3)
    assert "LeftSemi" in plan_of(found) and found.count() == 5 * 7


def test_tfidf_cuts_the_texts_once(spark, small):
    plan = plan_of(topics.tfidf(tables.transcripts(spark, small), V31))
    assert "documents.parquet" not in plan and "term-counts" in plan


@pytest.mark.parametrize("name", ["analysis_key_phrases_v31", "analysis_pricing_v30", "analysis_objections_v31", "analysis_timeline_v31", "analysis_competitors_v31"])
def test_lists_are_not_computed_again_for_a_filter(spark, small, name):
    assert "Filter (" not in plan_of(entry_module.queries()[name](spark, small))


def test_speaker_profile_cuts_each_span_into_words_once(spark):
    calls = spark.createDataFrame([(1, "Agent: so good. Prospect: no")], "call_id bigint, text string")
    # the words of sentences, and the count for texts in which lower-casing adds a dot
    assert plan_of(conversation.speaker_profile_text(calls, V31)).count("regexp_extract_all(") <= 2
