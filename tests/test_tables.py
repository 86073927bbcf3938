"""Relational operators, listing, quality and files."""

import json

import pytest
from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.operators import listing, quality, relational
from calllens.plans.analysis import analyze_calls
from calllens.session import scratch_dir
from calllens.sources import files, tables


@pytest.fixture(scope="module")
def calls(spark, small):
    return tables.analysis_results(spark, small).persist()


def test_pages_cover_the_table_once(calls):
    rows = calls.limit(230).persist()
    seen = []
    for page in range(1, 4):
        seen += [r.call_id for r in listing.list_calls(rows, page, 100, total=230).collect()]
    assert len(seen) == len(set(seen)) == 230
    with pytest.raises(ValueError, match="out of bounds"):
        listing.list_calls(rows, 4, 100, total=230)


@pytest.mark.parametrize("bad", [dict(page=0), dict(page_size=101), dict(page_size=0), dict(order="invalid"), dict(sort_by="name")])
def test_bad_page_requests(calls, bad):
    with pytest.raises(ValueError):
        listing.list_calls(calls, **bad)


def test_empty_listing(calls):
    none = calls.where("call_id < 0")
    assert listing.list_calls(none, 1, 20, total=0).count() == 0
    info = listing.page_info(none, 1, 20).first()
    assert (info.total_items, info.total_pages, info.has_next_page, info.has_previous_page) == (0, 0, False, False)


def test_page_info(calls):
    info = listing.page_info(calls.limit(101), 2, 50).first()
    assert (info.total_items, info.total_pages, info.has_next_page, info.has_previous_page) == (101, 3, True, True)


def test_search_without_filters_is_everything(calls):
    assert listing.search_calls(calls, lead_score="all", sentiment="all").count() == calls.count()


def test_get_call_refuses_bad_names(calls):
    assert listing.get_call(calls, "call-1.json").count() == 1
    assert listing.get_call(calls, "absent.json").count() == 0
    for name in ("", " ", "../x", "/x", "a b", "."):
        with pytest.raises(ValueError):
            listing.get_call(calls, name)


def test_summary_of_unreadable_documents(spark):
    docs = spark.createDataFrame(
        [("analysis-results/a.json", '{"leadScore":{"score":"Hot"},"sentiment":0.3,"metadata":{"call_duration_minutes":15.2}}', 2621440),
         ("analysis-results/b.json", "{broken", 10), ("c.json", "{}", 10)],
        "path string, raw string, size_bytes bigint",
    ).withColumn("uploaded_at", F.current_timestamp())
    a, b, c = listing.call_summary(docs).orderBy("file_identifier").collect()
    assert (a.file_identifier, a.file_size_mb, a.confidence_percentage, a.overall_sentiment) == ("a.json", 2.5, 0.0, "Positive")
    assert a.lead_classification == "Hot" and a.call_duration_minutes == 15.2
    assert (b.processing_status, b.lead_classification, b.overall_sentiment) == ("analysis_available", None, None)
    assert (c.processing_status, c.confidence_percentage) == ("completed", None)


def test_constraints_pass_on_null(spark):
    df = spark.createDataFrame([(1, None, "Hot"), (2, 1.5, "Lukewarm"), (3, 0.5, "Cold")], "id int, confidence double, c string")
    rules = {"range": quality.between("confidence", 0, 1), "domain": quality.one_of("c", quality.LEAD_CLASSES)}
    checked = quality.check_constraints(df, rules)
    assert {r.id: r.violations for r in checked.collect()} == {1: [], 2: ["range", "domain"], 3: []}
    assert quality.violation_rows(checked, "id").count() == 2


def test_insert_keeps_existing_rows(spark):
    target = spark.createDataFrame([("a.wav", 1)], "filename string, v int")
    rows = spark.createDataFrame([("a.wav", 2), ("b.wav", 4), ("b.wav", 3)], "filename string, v int")
    assert [(r.filename, r.v) for r in relational.insert_if_absent(target, rows, "filename", "v").collect()] == [("b.wav", 3)]


def test_touch_only_changed_rows(spark):
    old = spark.createDataFrame([(1, "x", 10), (2, None, 10), (3, "z", 10)], "k int, v string, updated_at int")
    new = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0), (4, None, 0)], "k int, v string, updated_at int")
    got = {r.k: r.updated_at for r in relational.touch_updated_at(old, new, "k", ["v"], F.lit(99)).collect()}
    assert got == {1: 10, 2: 99, 3: 10, 4: 99}


def test_latest_breaks_ties(spark):
    rows = spark.createDataFrame([("f", 1, 5, "a"), ("f", 2, 5, "b"), ("g", 3, 1, "c")], "f string, id int, t int, s string")
    got = {r.f: r.s for r in relational.latest_per_call(rows, "f", "t", "id").collect()}
    assert got == {"f": "b", "g": "c"}


def test_orphans_allow_null_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, parent int")
    parents = spark.createDataFrame([(1,)], "parent int")
    assert [r.id for r in relational.orphans(child, parents, "parent").collect()] == [3]


@pytest.mark.parametrize("profile,b_text", [(V31, "hi"), (V30, '{"transcript":"hi"}')], ids=["v3.1", "v3.0"])
def test_transcript_files(spark, tmp_path, profile, b_text):
    bodies = {
        "a.json": '{"results":{"transcripts":[{"transcript":"hi"}]}}',
        "b.json": '{"transcript":"hi"}',
        "c.json": '{"other":1}',
        "d.txt": '{"transcript":"hi"}',
        "deep/e.txt": "two\nlines",
    }
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    read = {r.file_name: r for r in files.read_transcripts(spark, str(tmp_path), profile).collect()}
    assert {n: r.text for n, r in read.items()} == {
        "a.json": "hi", "b.json": b_text, "c.json": '{"other":1}', "d.txt": '{"transcript":"hi"}', "e.txt": "two\nlines"}
    assert read["e.txt"].size_bytes == 9 and read["e.txt"].path.endswith("deep/e.txt")


def test_audio_listing(spark, tmp_path):
    for name in ("a.mp3", "b.WAV", "c.txt", "d.flac.txt", "e.m4a"):
        (tmp_path / name).write_bytes(b"xx")
    got = {r.path.rsplit("/", 1)[1]: r.media_format for r in files.list_audio_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.mp3": "mp3", "b.WAV": "wav", "e.m4a": "m4a"}


def test_results_round_trip(spark):
    df = spark.createDataFrame([(1, "x/a.txt", "Wow, pricing? Yes.")], "call_id bigint, path string, text string")
    result = analyze_calls(df, V31)
    root = scratch_dir(spark, "roundtrip")
    files.write_results(result, root, "json")
    back = files.read_results(spark, root).first()
    assert json.loads(result.toJSON().first())["lead"]["score"] == back.lead.score
    assert back.moments[0].phrase == "Wow" and back.size_bytes > 0 and back.sentiment.emotions["neutral"] > 0
    with pytest.raises(Exception):
        files.write_results(result, root, "json")
