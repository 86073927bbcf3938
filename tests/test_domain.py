"""The relational tables: schemas, generated columns, rules, and an analysis as tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from calllens import V31
from calllens.plans.analysis import analyze_calls
from calllens.session import scratch_dir
from calllens.sources import domain
from catalog import load
from catalog.registry import QUERIES

load()


def rows(spark, table, *given):
    """Rows of a table; columns that are not given are null."""
    schema = spark.createDataFrame([], table.columns).schema
    return spark.createDataFrame([[g.get(f.name) for f in schema] for g in given], schema)


@pytest.mark.parametrize("kinds", [domain.SET_A, domain.SET_B, domain.SET_C])
def test_declarations_agree_with_their_columns(spark, kinds):
    for name, table in kinds.items():
        columns = set(spark.createDataFrame([], table.columns).columns)
        named = {table.key, *table.required, *table.ranges, *table.domains, *table.lengths, *table.refers, *[c for u in table.unique for c in u]}
        assert named <= columns and name == table.name
        for parent, key in table.refers.values():
            assert key in spark.createDataFrame([], kinds[parent].columns).columns
        assert domain.checked(rows(spark, table), table).count() == 0


def test_absent_columns_are_null_and_generated_ones_follow(spark):
    root, table = scratch_dir(spark, "tables"), domain.SET_B["audio_files"]
    files = spark.createDataFrame([("a", 1048576 * 3 // 2, 90), ("b", None, None)], "filename string, file_size_bytes bigint, duration_seconds int")
    domain.write_tables({"audio_files": files}, domain.SET_B, root)
    got = {r.filename: r for r in domain.read_domain(spark, root, table).collect()}
    assert got["a"].file_size_mb == Decimal("1.50") and got["a"].duration_minutes == Decimal("1.50")
    assert got["b"].file_size_mb is None and got["a"].s3_bucket is None


def test_rules_of_rows(spark):
    job = domain.SET_A["processing_jobs"]
    good = {"id": "1", "job_type": "analysis", "status": "pending", "progress_percentage": 0}
    given = [
        good, good | {"id": "2", "progress_percentage": 100}, good | {"id": "3", "progress_percentage": 101},
        good | {"id": "4", "status": "asleep"}, good | {"id": "5", "job_type": None}, good | {"id": "6", "job_type": "x" * 51},
        good | {"id": None, "progress_percentage": None},
    ]
    got = {r.id: r.violations for r in domain.checked(rows(spark, job, *given), job).collect()}
    assert got == {
        "1": [], "2": [], "3": ["progress_percentage_range"], "4": ["status_domain"], "5": ["job_type_missing"],
        "6": ["job_type_length"], None: ["id_missing"],
    }


def test_keys_and_references(spark):
    files = rows(spark, domain.SET_B["audio_files"], {"id": "1", "filename": "a"}, {"id": "2", "filename": "a"}, {"id": "2", "filename": "b"})
    results = rows(
        spark, domain.SET_B["analysis_results"],
        *[{"id": str(i), "file_identifier": f"f{i}", "audio_file_id": a, "sentiment_score": s} for i, (a, s) in enumerate([("1", None), ("9", Decimal(2)), (None, Decimal(1)), (None, None)])],
    )
    got = {(r.table_name, r.rule): r.rows for r in domain.violations({"audio_files": files, "analysis_results": results}, domain.SET_B).collect()}
    assert got == {
        ("audio_files", "id_unique"): 2, ("audio_files", "filename_unique"): 2,
        ("analysis_results", "audio_file_id_reference"): 1, ("analysis_results", "sentiment_score_range"): 1,
    }
    # a parent that is not given is not looked for
    alone = domain.violations({"analysis_results": results}, domain.SET_B).collect()
    assert [(r.rule, r.rows) for r in alone] == [("sentiment_score_range", 1)]


def test_an_analysis_as_tables(spark):
    calls = spark.createDataFrame(
        [(1, "c/a.txt", "Agent: This is perfect. Prospect: When can we start? great big deal. great big deal"), (2, "c/b.txt", None)],
        "call_id bigint, path string, text string",
    )
    made = domain.normalised(analyze_calls(calls, V31))
    assert domain.violations(made, domain.SET_A).collect() == []
    counts = {name: df.count() for name, df in made.items()}
    assert counts["call_transcripts"] == counts["sentiment_analyses"] == counts["lead_scores"] == 2
    moments = {r.trigger_phrase: r for r in made["interest_moments"].collect()}
    assert moments["When can we"].speaker_identifier == "Prospect" and counts["interest_moments"] == 3
    assert {r.topic_name for r in made["call_topics"].collect()} == {"great big deal"}
    root = scratch_dir(spark, "tables")
    domain.write_tables(made, domain.SET_A, root)
    back = domain.read_domain(spark, root, domain.SET_A["lead_scores"])
    assert back.join(made["call_transcripts"], back.call_transcript_id == made["call_transcripts"]["id"]).count() == 2
    again = domain.normalised(analyze_calls(calls, V31))["interest_moments"]
    assert again.exceptAll(made["interest_moments"]).count() == 0
    assert made["lead_scores"].where(F.col("primary_classification") == "Warm").count() >= 1


def test_values_too_large_for_their_column_are_found(spark):
    kinds = {"analysis_results": domain.SET_B["analysis_results"], "audio_files": domain.SET_B["audio_files"]}
    results = spark.createDataFrame([("1", "a", 12.5, 3.0), ("2", "b", 0.5, 100.0)], "id string, file_identifier string, sentiment_score double, engagement_level double")
    files = spark.createDataFrame([("1", "a", 1e8), ("2", "b", 1e8 - 1)], "id string, filename string, duration_seconds double")
    held = {"analysis_results": results, "audio_files": files}
    found = domain.violations({n: domain.shaped(df, kinds[n], wide=True) for n, df in held.items()}, kinds)
    assert sorted(map(tuple, found.collect())) == [
        ("analysis_results", "engagement_level_digits", 1), ("analysis_results", "sentiment_score_range", 1), ("audio_files", "duration_seconds_digits", 1),
    ]


def test_events_of_a_large_value_are_counted(spark):
    root = scratch_dir(spark, "events")
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'click' AS event_type, id * 700D AS value, '{\"k\": 12}' AS props FROM range(3)")
    rows.write.parquet(f"{root}/events.parquet")
    got = {(r.table_name, r.rule): r.rows for r in QUERIES["table_violations"](spark, root).collect()}
    assert got["analysis_results", "sentiment_score_range"] == 3
