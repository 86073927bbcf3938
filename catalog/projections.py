"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens import V30, V31
from calllens.functions import text as tx
from calllens.functions.tokens import token_count
from calllens.operators import listing, scoring
from calllens.plans.analysis import metadata_features
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.registry import query
from catalog.views import PROBE_V30, PROBE_V31

# speaker tags, artefacts and long punctuation, none of which the prose has
NOISY_SQL = f"""WITH {sp.TURNS}, noisy AS (
  SELECT call_id, turn, 'Speaker ' || CAST(turn AS VARCHAR) || ':   [inaudible] '
         || replace(text, '. ', '.... ') || ' -----[music]  note: 10:30 SPEAKER_2: [unclear]' AS text
  FROM turns) --final
"""


def noisy(spark, sf):
    return tables.turns(spark, sf).select(
        "call_id",
        "turn",
        F.concat(
            F.lit("Speaker "), F.col("turn").cast("string"), F.lit(":   [inaudible] "),
            F.replace("text", F.lit(". "), F.lit(".... ")),
            F.lit(" -----[music]  note: 10:30 SPEAKER_2: [unclear]"),
        ).alias("text"),
    )


# written from the Unicode list of white space
SPACES = r"trim(regexp_replace({0}, '[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
TAGS = r"'(^|[^\p{L}\p{N}_])(Speaker [0-9]+|SPEAKER_[0-9]+)|[\p{L}\p{N}_]+:', '\1', 'g'"
TAGS_V30 = r"'(^|[^\p{L}\p{N}_])(Speaker [0-9]+|SPEAKER_[0-9]+):', '\1', 'g'"
DOTS = r"regexp_replace(regexp_replace({0}, '\.{{3,}}', '...', 'g'), '-{{2,}}', '--', 'g')"


def _strip(expr: str, artifacts) -> str:
    for a in artifacts:
        expr = f"replace({expr}, {sp.lit(a)}, '')"
    return expr


def clean_sql(text: str, profile) -> str:
    out = _strip(SPACES.format(text), profile.artifacts)
    if profile.squeeze:
        return f"trim({DOTS.format(f'regexp_replace({out}, {TAGS})')})"
    return f"trim(regexp_replace({out}, {TAGS_V30}))"


KEYED = "call_id:long turn:long text:str"
ODD_SQL = "replace(replace(text, '. ', '.' || chr(160) || ' ' || chr(8195)), ', ', ',' || chr(28) || chr(12288))"


@query("collapse_whitespace", "call_id:long text:str",
       f"WITH {sp.TRANSCRIPTS} --final\nSELECT call_id, {SPACES.format(ODD_SQL)} AS text FROM transcripts")
def _(spark, sf):
    odd = F.replace(F.replace("text", F.lit(". "), F.lit(".\u00a0 \u2003")), F.lit(", "), F.lit(",\x1c\u3000"))
    return tables.transcripts(spark, sf).select("call_id", tx.collapse_whitespace(odd).alias("text"))


@query("strip_artifacts", KEYED, NOISY_SQL + f"SELECT call_id, turn, {_strip('text', V31.artifacts)} AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.strip_artifacts(F.col("text"), V31.artifacts))


@query("strip_speaker_tags_v31", KEYED, NOISY_SQL + f"SELECT call_id, turn, regexp_replace(text, {TAGS}) AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.strip_speaker_tags(F.col("text"), V31))


@query("strip_speaker_tags_v30", KEYED, NOISY_SQL + f"SELECT call_id, turn, regexp_replace(text, {TAGS_V30}) AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.strip_speaker_tags(F.col("text"), V30))


@query("squeeze_punctuation", KEYED, NOISY_SQL + f"SELECT call_id, turn, {DOTS.format('text')} AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.squeeze_punctuation(F.col("text")))


@query("clean_transcript_v31", KEYED, NOISY_SQL + f"SELECT call_id, turn, {clean_sql('text', V31)} AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.clean_transcript(F.col("text"), V31))


@query("clean_transcript_v30", KEYED, NOISY_SQL + f"SELECT call_id, turn, {clean_sql('text', V30)} AS text FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).withColumn("text", tx.clean_transcript(F.col("text"), V30))


@query("clean_documents", "call_id:long text:str",
       f"WITH {sp.TRANSCRIPTS} --final\nSELECT call_id, {clean_sql('text', V31)} AS text FROM transcripts")
def _(spark, sf):
    return tables.transcripts(spark, sf).select("call_id", tx.clean_transcript(F.col("text"), V31).alias("text"))


@query("processing_id", "call_id:long processing_id:str",
       f"WITH {sp.TRANSCRIPTS} --final\nSELECT call_id, substr(md5(path), 1, 8) AS processing_id FROM transcripts")
def _(spark, sf):
    return tables.transcripts(spark, sf).select("call_id", tx.processing_id(F.col("path")).alias("processing_id"))


@query("file_name_parts", "page_id:long base_name:str stripped:str",
       """--final
SELECT page_id, string_split(url, '/')[-1] AS base_name,
       replace('analysis-results/' || url, 'analysis-results/', '') AS stripped FROM pages""")
def _(spark, sf):
    return tables.read_table(spark, sf, "pages").select(
        "page_id",
        tx.base_name(F.col("url")).alias("base_name"),
        tx.strip_prefix(F.concat(F.lit("analysis-results/"), "url")).alias("stripped"),
    )


@query("word_count_duration", "call_id:long word_count:long duration_minutes:d6",
       f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, len({sp.words('text')}) AS word_count, len({sp.words('text')}) / 150.0::DOUBLE AS duration_minutes
FROM transcripts""")
def _(spark, sf):
    counted = tables.transcripts(spark, sf).select("call_id", token_count(F.col("text")).alias("word_count"))
    return counted.withColumn("duration_minutes", F.col("word_count") / F.lit(V31.words_per_minute))


@query("derived_sizes", "call_id:long size_mb:d6 minutes:d6 listed_mb:d6",
       f"""WITH {sp.CALLS} --final
SELECT call_id, ((size_bytes * 200 + 1048576) // 2097152) / 100.0 AS size_mb,
       ((CAST(round(duration * 100) AS BIGINT) + 30) // 60) / 100.0 AS minutes,
       round(size_bytes / 1048576.0::DOUBLE, 2) AS listed_mb FROM calls""")
def _(spark, sf):
    return tables.analysis_results(spark, sf).select(
        "call_id",
        tx.size_mb(F.col("size_bytes")).alias("size_mb"),
        tx.minutes(F.col("duration")).alias("minutes"),
        F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("listed_mb"),
    )


BUCKET = "CASE WHEN sentiment > 0.2 THEN 'Positive' WHEN sentiment < -0.2 THEN 'Negative' WHEN sentiment IS NOT NULL THEN 'Neutral' END"


@query("sentiment_bucket", "call_id:long bucket:str",
       f"WITH {sp.CALLS} --final\nSELECT call_id, {BUCKET} AS bucket FROM calls")
def _(spark, sf):
    return tables.analysis_results(spark, sf).select("call_id", tx.sentiment_bucket(F.col("sentiment")).alias("bucket"))


# some documents are unreadable, some lack details
@query("call_summary",
       "file_identifier:str upload_timestamp:ts file_size_mb:d6 processing_status:str "
       "lead_classification:str confidence_percentage:d6 call_duration_minutes:d6 overall_sentiment:str",
       f"""WITH {sp.CALLS} --final
SELECT file_name AS file_identifier, uploaded_at AS upload_timestamp,
       round(size_bytes / 1048576.0::DOUBLE, 2) AS file_size_mb,
       CASE WHEN job_type = 'error' THEN 'analysis_available' ELSE 'completed' END AS processing_status,
       CASE WHEN job_type IN ('click', 'view', 'purchase') THEN lead_class END AS lead_classification,
       CASE WHEN job_type = 'click' THEN 0 WHEN job_type IN ('view', 'purchase') THEN confidence * 100 END AS confidence_percentage,
       CASE WHEN job_type IN ('view', 'purchase') THEN duration END AS call_duration_minutes,
       CASE WHEN job_type IN ('view', 'purchase') THEN {BUCKET} END AS overall_sentiment
FROM calls""")
def _(spark, sf):
    kind = F.col("job_type")
    lead = F.concat(F.lit('"leadScore":{"score":"'), "lead_class", F.lit('"'))
    rest = F.concat(
        F.lit(',"confidence":'), F.col("confidence").cast("string"), F.lit('},"sentiment":'),
        F.col("sentiment").cast("string"), F.lit(',"metadata":{"call_duration_minutes":'),
        F.col("duration").cast("string"), F.lit("}}"),
    )
    raw = (
        F.when(kind == "error", F.lit('{"leadScore": {"score"'))
        .when(kind == "signup", F.lit("{}"))
        .when(kind == "click", F.concat(F.lit("{"), lead, F.lit("}}")))
        .otherwise(F.concat(F.lit("{"), lead, rest))
    )
    docs = tables.analysis_results(spark, sf).select(
        F.concat(F.lit("analysis-results/"), "file_name").alias("path"), raw.alias("raw"), "size_bytes", "uploaded_at"
    )
    return listing.call_summary(docs)


@query("emotion_categories", "call_id:long positive:d6 negative:d6 neutral:d6",
       f"""WITH {sp.CALLS} --final
SELECT call_id, CASE WHEN job_type <> 'error' THEN greatest(0.0::DOUBLE, sentiment) END AS positive,
       CASE WHEN job_type <> 'error' THEN greatest(0.0::DOUBLE, -sentiment) END AS negative,
       CASE WHEN job_type <> 'error' THEN 1.0::DOUBLE - abs(sentiment) END AS neutral FROM calls""")
def _(spark, sf):
    # failed calls have no sentiment
    shares = tx.emotions(F.when(F.col("job_type") != "error", F.col("sentiment")))
    return tables.analysis_results(spark, sf).select("call_id", *[c.alias(n) for n, c in shares.items()])


@query("validate_file_name", "page_id:long file_name:str valid:bool reason:str",
       r"""WITH names AS (
  SELECT page_id, unnest([url, '../' || CAST(page_id AS VARCHAR), '/' || CAST(page_id AS VARCHAR) || '.json', '', '  ', '.',
    './.', CAST(page_id AS VARCHAR) || '/a-1_b.json', 'a b ' || CAST(page_id AS VARCHAR), CAST(page_id AS VARCHAR) || chr(10)]) AS file_name FROM pages),
judged AS (
  SELECT *, CASE WHEN trim(file_name) = '' THEN 'empty'
    WHEN contains(file_name, '..') OR starts_with(file_name, '/') THEN 'path_traversal'
    WHEN NOT regexp_full_match(file_name, '[a-zA-Z0-9._/-]+') THEN 'invalid_characters'
    WHEN replace(replace(file_name, '.', ''), '/', '') = '' THEN 'outside_prefix' END AS reason FROM names) --final
SELECT page_id, file_name, reason IS NULL AS valid, reason FROM judged""")
def _(spark, sf):
    page = F.col("page_id").cast("string")
    names = F.array(
        "url", F.concat(F.lit("../"), page), F.concat(F.lit("/"), page, F.lit(".json")), F.lit(""), F.lit("  "),
        F.lit("."), F.lit("./."), F.concat(page, F.lit("/a-1_b.json")), F.concat(F.lit("a b "), page),
        F.concat(page, F.lit("\n")),
    )
    rows = tables.read_table(spark, sf, "pages").select("page_id", F.explode(names).alias("file_name"))
    return listing.validate_file_names(rows)


def _insights(name, profile):
    concern = sp.hit_list("lower(text)", profile.concern, profile.prefixes[2])
    sql = f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, CASE WHEN {sp.any_like('lower(text)', profile.analytical)} THEN 'Analytical' ELSE 'Relationship-focused' END AS personality,
  CASE WHEN contains(lower(text), 'we') THEN 'Collaborative' ELSE 'Individual' END AS decision_style,
  CASE WHEN {sp.any_like('lower(text)', profile.concern)} THEN {sp.lit(profile.strategies[0])} ELSE {sp.lit(profile.strategies[1])} END AS strategy,
  [{', '.join(sp.lit(a) for a in profile.next_actions)}] AS next_actions, {concern} AS risk_factors
FROM transcripts"""

    @query(name, "call_id:long personality:str decision_style:str strategy:str next_actions:list risk_factors:list", sql)
    def _(spark, sf):
        return scoring.insight_labels(tables.transcripts(spark, sf), profile)


_insights("insight_labels_v31", PROBE_V31)
_insights("insight_labels_v30", PROBE_V30)


@query("default_fill",
       "call_id:long avg_sentence_length:d6 engagement_score:d6 response_time_avg:d6 call_duration_minutes:d6 speaker_changes:long",
       f"""WITH {sp.CALLS} --final
SELECT call_id, 15.0 AS avg_sentence_length,
       CASE WHEN job_type = 'click' THEN score / 10 ELSE 5.0 END AS engagement_score, 5.0 AS response_time_avg,
       CASE WHEN job_type IN ('click', 'purchase') THEN duration ELSE 15.0 END AS call_duration_minutes,
       CASE WHEN job_type = 'purchase' THEN CAST(score AS BIGINT) ELSE 20 END AS speaker_changes FROM calls""")
def _(spark, sf):
    kind = F.col("job_type")
    whole = F.col("score").cast("bigint").cast("string")
    minutes = F.concat(F.lit('"call_duration_minutes": '), F.col("duration").cast("string"))
    metadata = (
        F.when(kind == "purchase", F.concat(F.lit("{"), minutes, F.lit(', "speaker_changes": '), whole, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("{"), minutes, F.lit(', "engagement_score": '), (F.col("score") / 10).cast("string"), F.lit("}")))
        .when(kind == "error", F.lit('{"engagement_score": "high", "speaker_changes": "many"}'))
        .otherwise(F.lit("{}"))
    )
    return metadata_features(tables.analysis_results(spark, sf).select("call_id", metadata.alias("metadata")))


@query("response_view",
       "fileName:str sentiment:d6 keywords:list lead_class:str confidence:d6 call_duration_minutes:d6",
       f"""WITH {sp.CALLS} --final
SELECT file_name AS fileName, CASE WHEN job_type <> 'error' THEN sentiment END AS sentiment, [job_type, status] AS keywords, lead_class, confidence,
       duration AS call_duration_minutes FROM calls""")
def _(spark, sf):
    results = tables.analysis_results(spark, sf).select(
        "file_name", F.lit("").alias("text"), F.when(F.col("job_type") != "error", F.col("sentiment")).alias("sentiment"), F.array("job_type", "status").alias("key_phrases"),
        F.array("job_type").alias("topics"), F.array().cast("array<string>").alias("moments"),
        "lead_class", "confidence", F.col("duration").alias("duration_minutes"),
    )
    view = listing.response_view(results)
    return view.select("fileName", "sentiment", "keywords", F.col("leadScore.score").alias("lead_class"),
                       F.col("leadScore.confidence").alias("confidence"),
                       F.col("metadata.call_duration_minutes").alias("call_duration_minutes"))
