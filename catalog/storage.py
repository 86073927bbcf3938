"""Sources and sinks, as round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.plans.analysis import analyze_calls
from calllens.session import scratch_dir
from calllens.sources import files, tables
from catalog import sqlparts as sp
from catalog.filters import class_sql, score_sql
from catalog.projections import clean_sql
from catalog.registry import query
from catalog.views import PROBE_V30, PROBE_V31


def _transcript_files(name, profile):
    nested = """CASE WHEN item_id % 4 = 3 THEN '{"transcript":"' || replace(text, chr(10), ' ') || '"}' ELSE replace(text, chr(10), ' ') END"""
    v31 = "replace(text, chr(10), ' ')"

    @query(name, "item:str text_md5:str", f"""--final
SELECT 'item-' || CAST(item_id AS VARCHAR) AS item, md5({v31 if profile.json_transcript_key else nested}) AS text_md5 FROM benchmark""")
    def _(spark, sf):
        root = scratch_dir(spark, "transcripts")
        flat = F.replace("text", F.lit("\n"), F.lit(" "))
        kind = F.col("item_id") % 4
        # plain text, and the two JSON layouts a transcript may come in
        body = (
            F.when(kind == 2, F.concat(F.lit('{"results":{"transcripts":[{"transcript":"'), flat, F.lit('"}]}}')))
            .when(kind == 3, F.concat(F.lit('{"transcript":"'), flat, F.lit('"}')))
            .otherwise(flat)
        )
        items = tables.read_table(spark, sf, "benchmark").select(
            F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item"), body.alias("value"),
            F.when(kind >= 2, ".json").otherwise(".txt").alias("suffix"),
        )
        items.select("item", "suffix", "value").write.partitionBy("suffix", "item").text(root)
        read = files.read_transcripts(spark, root, profile)
        # Spark names its files; the wanted suffix is in the folder
        named = read.withColumn("path", F.concat("path", F.regexp_extract("path", "suffix=([^/]+)/", 1)))
        text = files.transcript_text(F.col("path"), F.regexp_replace("raw", "\n$", ""), profile)
        return named.select(F.regexp_extract("path", "item=([^/]+)/", 1).alias("item"), F.md5(text).alias("text_md5"))


_transcript_files("read_transcripts_v31", PROBE_V31)
_transcript_files("read_transcripts_v30", PROBE_V30)


@query("write_read_results", "call_id:long word_count:long lead_score:d6 lead_class:str next_actions:list",
       f"""WITH {sp.TRANSCRIPTS}, tidy AS (SELECT call_id, {clean_sql('text', PROBE_V31)} AS text FROM transcripts),
scored AS (SELECT call_id, len({sp.words('text')}) AS word_count, {score_sql(PROBE_V31, 'lower(text)', f"len({sp.words('text')})")} AS lead_score FROM tidy) --final
SELECT *, {class_sql(PROBE_V31, 'lead_score')} AS lead_class, ['Schedule follow-up', 'Send additional information', 'Prepare proposal'] AS next_actions FROM scored""")
def _(spark, sf):
    root = scratch_dir(spark, "results")
    files.write_results(analyze_calls(tables.transcripts(spark, sf), PROBE_V31), root, "json")
    read = files.read_results(spark, root)
    return read.select("call_id", "word_count", F.col("lead.score").alias("lead_score"),
                       F.col("lead.class").alias("lead_class"), F.col("lead.next_actions").alias("next_actions"))


@query("results_by_day", "call_id:long lead_class:str upload_date:str",
       f"""WITH {sp.CALLS} --final
SELECT call_id, lead_class, strftime(uploaded_at, '%Y-%m-%d') AS upload_date FROM calls
WHERE uploaded_at >= TIMESTAMP '2024-01-10' AND uploaded_at < TIMESTAMP '2024-01-13'""")
def _(spark, sf):
    root = scratch_dir(spark, "by-day")
    dated = tables.analysis_results(spark, sf).withColumn("upload_date", F.to_date("uploaded_at"))
    files.write_results(dated, root, partition="upload_date")
    days = F.col("upload_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return spark.read.parquet(root).where(days)


@query("audio_uploads", "event_id:long path:str media_format:str", """WITH up AS (
  SELECT event_id, 'uploads/call-' || CAST(event_id AS VARCHAR) || CASE event_type WHEN 'click' THEN '.mp3' WHEN 'view' THEN '.WAV'
    WHEN 'purchase' THEN '.flac' WHEN 'error' THEN '.m4a.txt' ELSE '.ogg' END AS path FROM events) --final
SELECT event_id, path, string_split(lower(path), '.')[-1] AS media_format FROM up WHERE lower(path) LIKE '%.mp3' OR lower(path) LIKE '%.wav' OR lower(path) LIKE '%.flac'""")
def _(spark, sf):
    kind = F.col("event_type")
    ending = (F.when(kind == "click", ".mp3").when(kind == "view", ".WAV").when(kind == "purchase", ".flac")
              .when(kind == "error", ".m4a.txt").otherwise(".ogg"))
    listing = tables.read_table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("uploads/call-"), F.col("event_id").cast("string"), ending).alias("path")
    )
    return files.audio_uploads(listing)
