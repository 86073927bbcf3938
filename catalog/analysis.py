"""Every field of the analysis row, beside the SQL of the operator that defines it.

The standalone queries read raw transcripts; here their SQL reads cleaned ones, some of
them missing, as the analysis does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.functions.arrays import rows_of
from calllens.functions.tokens import sentences
from calllens.operators import sentiment as senti
from calllens.operators.conversation import response_time_avg, speaker_changes, speaker_profile_text
from calllens.plans.analysis import FEATURES, analyze_calls, feature_view
from calllens.session import scratch_dir
from calllens.sources import domain, tables
from catalog import aggregates, filters, joins, ordered, projections, text  # noqa: F401  the SQL they register
from catalog import sqlparts as sp
from catalog.aggregates import POLARITY_CASE
from catalog.filters import SOME_TEXT_SQL, some_text
from catalog.projections import clean_sql
from catalog.registry import ORACLE, query
from catalog.text import GRAMS3, pattern_values
from catalog.views import ORGS, PROBE_V30, PROBE_V31, asking_docs

PROFILES = {"v31": PROBE_V31, "v30": PROBE_V30}


def cleaned(profile, source: str = SOME_TEXT_SQL) -> str:
    """The view of transcripts with cleaned texts, missing ones empty."""
    raw = sp.TRANSCRIPTS.replace("transcripts AS (", "raw_calls AS (", 1)
    return f"""{raw}, transcripts AS (
  SELECT * EXCLUDE (text), coalesce({clean_sql(source, profile)}, '') AS text FROM raw_calls)"""


def oracle(name: str, profile, source: str = SOME_TEXT_SQL) -> str:
    """The SQL of a standalone query, over cleaned transcripts."""
    return ORACLE[name].replace(sp.TRANSCRIPTS, cleaned(profile, source))


def final(spec: str) -> str:
    """The columns of ``q0``, whose lists are joined already, cut into lists again."""
    kinds = [part.split(":") for part in spec.split()]
    cut = "CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '|') END AS {c}"
    return "--final\nSELECT " + ", ".join(cut.format(c=c) if k == "list" else c for c, k in kinds) + " FROM q0"


def rows(spark, sf, profile):
    return analyze_calls(some_text(tables.transcripts(spark, sf)), profile, ORGS)


def each(column: str):
    """A row per struct of the list.  Over a plain column Catalyst would compute the list a
    second time, in a filter that drops the empty ones."""
    return F.inline(F.transform(column, lambda x: x))


def field(name: str, spec: str, sql: str, fn) -> None:
    """Register ``fn`` of the analysis rows; a part of both rule generations each."""
    for tag, profile in PROFILES.items():
        standalone = f"{sql}_{tag}" if f"{sql}_{tag}" in ORACLE else sql
        if tag == "v30" and standalone == sql:
            continue  # the SQL is that of one generation
        body = oracle(standalone, profile)

        def run(spark, sf, profile=profile):
            return fn(rows(spark, sf, profile))

        query(f"analysis_{name}_{tag}", spec, f"WITH q0 AS ({body}) {final(spec)}")(run)


field("sentiment", "call_id:long sentiment_score:d6 sentiment_confidence:d6 positive:d6 negative:d6 neutral:d6", "ensemble_sentiment",
      lambda r: r.select("call_id", F.col("sentiment.score").alias("sentiment_score"), F.col("sentiment.confidence").alias("sentiment_confidence"),
                         *[F.col("sentiment.emotions")[e].alias(e) for e in ("positive", "negative", "neutral")]))
field("moments", "call_id:long phrase:str context_md5:str t:d6 intensity:d6", "interest_moments",
      lambda r: r.select("call_id", each("moments")).withColumn("context_md5", F.md5("context")))
field("key_phrases", "call_id:long pos:long phrase:str", "key_phrases",
      lambda r: r.select("call_id", rows_of(F.col("key_phrases"), "phrase", "pos")))
field("technical", "call_id:long technical_terms:list", "technical_terms", lambda r: r.select("call_id", "technical_terms"))
field("pricing", "call_id:long pos:long mention_md5:str", "pricing_mentions",
      lambda r: r.select("call_id", rows_of(F.col("pricing"), "mention", "pos")).withColumn("mention_md5", F.md5("mention")))
field("objections", "call_id:long idx:long sentence_md5:str", "objections",
      lambda r: r.select("call_id", rows_of(F.col("objections"), "s", "idx")).withColumn("sentence_md5", F.md5("s")))
field("timeline", "call_id:long idx:long t:d6 v:d6", "engagement_timeline",
      lambda r: r.select("call_id", rows_of(F.col("timeline"), "p", "idx")).select("call_id", "idx", "p.t", "p.v"))
field("signals", "call_id:long interest_signals:list buying_signals:list concern_signals:list", "signal_extract",
      lambda r: r.select("call_id", *[F.col(f"lead.{c}").alias(f"{n}_signals") for c, n in (("interest", "interest"), ("buying", "buying"), ("concerns", "concern"))]))
field("insights", "call_id:long personality:str decision_style:str strategy:str next_actions:list risk_factors:list", "insight_labels",
      lambda r: r.select("call_id", "lead.personality", F.col("lead.decision").alias("decision_style"), "lead.strategy", "lead.next_actions", "lead.risk_factors"))


@query("analysis_topics_v31", "call_id:long name:str relevance:d6",
       f"WITH q0 AS ({oracle('phrase_frequency', PROBE_V31)}) --final\nSELECT * FROM q0")
def _(spark, sf):
    return rows(spark, sf, PROBE_V31).select("call_id", each("topics"))


@query("analysis_competitors_v31", "call_id:long competitor:str mentions:long",
       f"""WITH q0 AS ({oracle('competitor_mentions', PROBE_V31)}) --final
SELECT call_id, competitor, count(*) AS mentions FROM q0 GROUP BY call_id, competitor""")
def _(spark, sf):
    found = rows(spark, sf, PROBE_V31).select("call_id", rows_of(F.col("competitors"), "name"))
    return found.groupBy("call_id", F.lower("name").alias("competitor")).agg(F.count(F.lit(1)).alias("mentions"))


ASKED = sp.ASKING_DOCS.replace("END AS text", "END AS asked").replace(
    "asking_docs AS (\n  SELECT", "asking_docs AS (SELECT call_id, " + clean_sql("asked", PROBE_V31) + " AS text FROM (\n  SELECT"
) + ")"


QUESTIONS = "call_id:long total_questions:long open_ended:long yes_no:long clarifying:long sample_questions:list"


@query("analysis_questions_v31", QUESTIONS,
       f"WITH q0 AS ({ORACLE['question_summary_v31'].replace(sp.ASKING_DOCS, ASKED)}) {final(QUESTIONS)}")
def _(spark, sf):
    asked = asking_docs(spark, sf).withColumn("path", F.lit("p"))
    return analyze_calls(asked, PROBE_V31).select("call_id", "questions.*")


# whole rows: one measure of every part -------------------------------------------------


def counts(name: str, alias: str) -> str:
    return f"(SELECT call_id, count(*) AS {alias} FROM ({oracle(name, PROBE_V31, 'text')}) GROUP BY call_id)"


PARTS = (("phrase_frequency", "topics"), ("interest_moments_v31", "moments"), ("competitor_mentions", "competitors"),
         ("pricing_mentions_v31", "pricing"), ("objections", "objections"), ("engagement_timeline_v31", "timeline"))


@query("analysis_documents",
       "call_id:long sentiment:d6 topics:long moments:long key_phrases:list technical_terms:list competitors:long pricing:long objections:long timeline:long questions:long",
       f"""WITH mood AS ({oracle('ensemble_sentiment_v31', PROBE_V31, 'text')}), phrases AS ({oracle('key_phrases_v31', PROBE_V31, 'text')}),
listed AS (SELECT call_id, list(phrase ORDER BY pos) AS key_phrases FROM phrases GROUP BY call_id),
terms AS (SELECT call_id, CASE WHEN technical_terms = '' THEN [] ELSE string_split(technical_terms, '|') END AS technical_terms
  FROM ({oracle('technical_terms_v31', PROBE_V31, 'text')})),
asks AS (SELECT call_id, count(*) AS questions FROM (WITH {cleaned(PROBE_V31, 'text')}, {sp.sent_rows('transcripts')} SELECT * FROM sent) WHERE ends_with(sent, '?') GROUP BY call_id) --final
SELECT m.call_id, m.sentiment_score AS sentiment, {', '.join(f'coalesce({a}, 0) AS {a}' for _, a in PARTS)},
  coalesce(key_phrases, []) AS key_phrases, technical_terms, coalesce(questions, 0) AS questions
FROM mood AS m LEFT JOIN listed USING (call_id) LEFT JOIN terms USING (call_id) LEFT JOIN asks USING (call_id)
""" + "\n".join(f"LEFT JOIN {counts(name, alias)} USING (call_id)" for name, alias in PARTS))
def _(spark, sf):
    return analyze_calls(tables.transcripts(spark, sf), PROBE_V31, ORGS).select(
        "call_id", F.col("sentiment.score").alias("sentiment"), F.size("topics").alias("topics"), F.size("moments").alias("moments"),
        "key_phrases", "technical_terms", F.size("competitors").alias("competitors"), F.size("pricing").alias("pricing"),
        F.size("objections").alias("objections"), F.size("timeline").alias("timeline"), F.col("questions.total_questions").alias("questions"),
    )


# features --------------------------------------------------------------------------------

POSITIVE = ("that", "with", "der")
WORDS_OF = ORACLE["text_features"].replace(sp.TRANSCRIPTS, cleaned(PROBE_V31)).replace(sp.ASKING_DOCS, "asking_docs AS (SELECT * FROM transcripts)")


# some calls have turns, some have timed events, some no text; the others take the defaults
@query("feature_view", "call_id:long " + " ".join(f"{f}:d6" for f in FEATURES),
       rf"""WITH {sp.TURNS}, words AS ({WORDS_OF}), mood AS ({oracle('ensemble_sentiment_v31', PROBE_V31)}),
line AS (SELECT call_id, avg(v) * 10 AS engagement_score, max(idx) + 1 AS n FROM ({oracle('engagement_timeline_v31', PROBE_V31)}) GROUP BY call_id),
topic AS (SELECT call_id, count(*) AS k FROM ({oracle('phrase_frequency', PROBE_V31)}) GROUP BY call_id),
moment AS (SELECT call_id, count(*) AS k FROM ({oracle('interest_moments_v31', PROBE_V31)}) GROUP BY call_id),
length AS (SELECT call_id, len({sp.words('text')}) AS n FROM (WITH {cleaned(PROBE_V31)} SELECT * FROM transcripts)),
seen AS (SELECT call_id, speaker, lag(speaker) OVER (PARTITION BY call_id ORDER BY turn) AS prev FROM turns),
changed AS (SELECT call_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> speaker) AS speaker_changes FROM seen GROUP BY call_id),
gaps AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
answered AS (SELECT user_id AS call_id, avg(gap) / 1000000.0 AS response_time_avg FROM gaps GROUP BY user_id) --final
SELECT w.call_id, sentiment_score, CASE WHEN w.call_id % 37 = 5 THEN 15.0 ELSE avg_sentence_length END AS avg_sentence_length, w.question_count,
  positive_word_ratio, coalesce(engagement_score, 5.0) AS engagement_score, coalesce(response_time_avg, 5.0) AS response_time_avg,
  coalesce(topic.k, 0) AS technical_terms_count, length.n / 150::DOUBLE AS call_duration_minutes, coalesce(speaker_changes, 20) AS speaker_changes,
  coalesce(moment.k, 0) AS interest_signals
FROM words AS w JOIN mood USING (call_id) JOIN length USING (call_id) LEFT JOIN line USING (call_id) LEFT JOIN topic USING (call_id)
LEFT JOIN moment USING (call_id) LEFT JOIN changed USING (call_id) LEFT JOIN answered USING (call_id)""")
def _(spark, sf):
    responses = response_time_avg(tables.read_table(spark, sf, "events"), "user_id").withColumnRenamed("user_id", "call_id")
    calls = some_text(tables.transcripts(spark, sf))
    return feature_view(calls, PROBE_V31, speaker_changes(tables.turns(spark, sf)), responses, POSITIVE)


# speakers -------------------------------------------------------------------------------

# which tag stands before sentence i of a call; a sentence without one goes on with the last
TAGS = ("Speaker 1: ", "SPEAKER_02: ", "", "Agent: ", "", "Prospect: ")


def tagged_calls(spark, sf):
    """Transcripts whose sentences begin with tags in turn, other colons taken out."""
    docs = tables.transcripts(spark, sf)
    calm = F.translate(F.translate("text", ":'", ", "), "\n", " ")
    tags = F.array(*map(F.lit, TAGS))
    told = F.transform(sentences(calm), lambda s, i: F.concat(F.get(tags, ((i + F.col("call_id")) % len(TAGS)).cast("int")), s))
    return docs.select("call_id", "path", F.array_join(told, " ").alias("text"))


TAG_CASE = f"list_extract([{', '.join(sp.lit(t.strip(': ')) for t in TAGS)}], 1 + CAST((idx + call_id) % {len(TAGS)} AS INT))"
SPOKEN = rf"""{sp.TRANSCRIPTS}, calm AS (SELECT call_id, replace(translate(text, ':''', ', '), chr(10), ' ') AS text FROM transcripts),
{sp.sent_rows('calm')},
named AS (SELECT call_id, idx, {TAG_CASE} AS tag, sent FROM sent),
run AS (SELECT *, sum(CASE WHEN tag <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY idx) AS span FROM named),
spans AS (SELECT call_id, span, coalesce(max(nullif(tag, '')), 'primary_speaker') AS speaker, string_agg(sent, ' ' ORDER BY idx) AS text, min(idx) AS idx0
  FROM run GROUP BY call_id, span),
{sp.tok_rows('spans', 'call_id, span', 'stok')}"""


@query("speaker_profile_text",
       "call_id:long speaker:str role:str turn_count:long word_count:long share_pct:d6 positive_share:d6 negative_share:d6 neutral_share:d6 engagement:d6 concerns:list",
       f"""WITH {SPOKEN},
mood AS (SELECT call_id, span, count(*) AS n, avg({POLARITY_CASE}) AS p FROM stok GROUP BY call_id, span),
{sp.sent_rows('spans', 'call_id, span', 'ssent')},
engaged AS (SELECT call_id, span, sum(least(1.0::DOUBLE, len(regexp_extract_all(sent, '\\S+')) / 25::DOUBLE)) AS e, count(*) AS k FROM ssent GROUP BY call_id, span) --final
SELECT s.call_id, s.speaker, CASE s.speaker WHEN 'Prospect' THEN 'prospect' ELSE 'unknown' END AS role, count(*) AS turn_count, sum(coalesce(m.n, 0)) AS word_count,
  sum(coalesce(m.n, 0)) * 100 / sum(sum(coalesce(m.n, 0))) OVER (PARTITION BY s.call_id)::DOUBLE AS share_pct,
  avg(CASE WHEN coalesce(p, 0) > 0.2 THEN 1 ELSE 0 END) AS positive_share, avg(CASE WHEN coalesce(p, 0) < -0.2 THEN 1 ELSE 0 END) AS negative_share,
  avg(CASE WHEN abs(coalesce(p, 0)) <= 0.2 THEN 1 ELSE 0 END) AS neutral_share, sum(e) / sum(k) AS engagement,
  list_filter([{', '.join(f"CASE WHEN bool_or(contains(lower(s.text), {sp.lit(c)})) THEN {sp.lit(c)} END" for c in PROBE_V31.concern)}], lambda x: x IS NOT NULL) AS concerns
FROM spans AS s LEFT JOIN mood AS m ON m.call_id = s.call_id AND m.span = s.span LEFT JOIN engaged AS g ON g.call_id = s.call_id AND g.span = s.span
GROUP BY s.call_id, s.speaker""")
def _(spark, sf):
    return speaker_profile_text(tagged_calls(spark, sf), PROBE_V31)


@query("analysis_speakers", "call_id:long speaker:str word_count:long moments:long first_t:d6",
       f"""WITH {SPOKEN},
tok AS (SELECT call_id, span, tok, row_number() OVER (PARTITION BY call_id ORDER BY span, pos) - 1 AS pos, count(*) OVER (PARTITION BY call_id) AS total FROM stok),
{GRAMS3},
hit AS (SELECT g.call_id, g.pos FROM gram AS g JOIN {pattern_values(PROBE_V31.interest_patterns)} ON pt.n = g.n AND pt.phrase = g.phrase),
told AS (SELECT s.call_id, s.speaker, count(*) AS word_count FROM tok AS t JOIN spans AS s ON s.call_id = t.call_id AND s.span = t.span GROUP BY s.call_id, s.speaker),
spoke AS (SELECT s.call_id, s.speaker, count(*) AS moments, min(t.pos / t.total::DOUBLE * 300) AS first_t FROM hit AS h
  JOIN tok AS t ON t.call_id = h.call_id AND t.pos = h.pos JOIN spans AS s ON s.call_id = t.call_id AND s.span = t.span GROUP BY s.call_id, s.speaker) --final
SELECT call_id, speaker, word_count, coalesce(moments, 0) AS moments, first_t FROM told LEFT JOIN spoke USING (call_id, speaker)""")
def _(spark, sf):
    found = analyze_calls(tagged_calls(spark, sf), PROBE_V31)
    told = found.select("call_id", each("speakers")).where("word_count > 0").select("call_id", "speaker", "word_count")
    spoke = found.select("call_id", each("moments")).groupBy("call_id", "speaker").agg(
        F.count(F.lit(1)).alias("moments"), F.min("t").alias("first_t")
    )
    return told.join(spoke, ["call_id", "speaker"], "left").withColumn("moments", F.coalesce("moments", F.lit(0)))


# emotions of a user model ---------------------------------------------------------------


def _toy_emotions():
    def score(texts):
        return [{"calm": t.count("th") / (1 + len(t)), **({"doubt": 0.5} if "?" in t or "q" in t else {})} for t in texts]

    return score


@query("analysis_emotions", "call_id:long labels:list calm:d6 doubt:d6",
       r"""WITH w AS (SELECT doc_id AS call_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 37 <> 5),
s AS (SELECT call_id, w, unnest(range(0, CAST(1 + ceil(greatest(len(w) - 60, 0) / 45.0) AS BIGINT))) * 45 AS s0 FROM w WHERE len(w) > 0),
p AS (SELECT call_id, array_to_string(w[s0 + 1 : s0 + 60], ' ') AS t, least(60, len(w) - s0) AS n FROM s),
m AS (SELECT call_id, sum(n * (length(t) - length(replace(t, 'th', ''))) / 2 / (1 + length(t))::DOUBLE) / sum(n) AS calm,
  sum(CASE WHEN contains(t, '?') OR contains(t, 'q') THEN 0.5 * n END) / sum(n) AS doubt FROM p GROUP BY call_id) --final
SELECT d.doc_id AS call_id, CASE WHEN m.call_id IS NULL THEN ['negative', 'neutral', 'positive'] WHEN doubt IS NULL THEN ['calm'] ELSE ['calm', 'doubt'] END AS labels,
  calm, doubt FROM documents AS d LEFT JOIN m ON m.call_id = d.doc_id""")
def _(spark, sf):
    calls = senti.emotion_scores(some_text(tables.transcripts(spark, sf)), _toy_emotions, size=60, overlap=15, out="model_emotions")
    found = analyze_calls(calls, PROBE_V31, emotions_col="model_emotions")
    labels = F.array_sort(F.map_keys("sentiment.emotions"))
    return found.select("call_id", labels.alias("labels"), *[F.col("sentiment.emotions")[e].alias(e) for e in ("calm", "doubt")])


# relational tables ----------------------------------------------------------------------


@query("table_interest_moments", "call_transcript_id:str trigger_phrase:str context_md5:str estimated_timestamp:d6 intensity_score:d6",
       f"""WITH q0 AS ({oracle('interest_moments_v31', PROBE_V31)}) --final
SELECT md5(CAST(call_id AS VARCHAR)) AS call_transcript_id, phrase AS trigger_phrase, context_md5, t AS estimated_timestamp, intensity AS intensity_score FROM q0""")
def _(spark, sf):
    root = scratch_dir(spark, "tables")
    made = domain.normalised(rows(spark, sf, PROBE_V31))
    domain.write_tables({"interest_moments": made["interest_moments"]}, domain.SET_A, root)
    held = domain.read_domain(spark, root, domain.SET_A["interest_moments"])
    return held.withColumn("context_md5", F.md5("contextual_content"))


@query("table_call_topics", "call_transcript_id:str topic_name:str relevance_score:d6",
       f"""WITH q0 AS ({oracle('phrase_frequency', PROBE_V31)}) --final
SELECT md5(CAST(call_id AS VARCHAR)) AS call_transcript_id, name AS topic_name, relevance AS relevance_score FROM q0""")
def _(spark, sf):
    return domain.normalised(rows(spark, sf, PROBE_V31))["call_topics"]


@query("table_audio_files", "filename:str file_size_bytes:long file_size_mb:d6 duration_seconds:d6 duration_minutes:d6", """WITH
a AS (SELECT 'call-' || CAST(doc_id AS VARCHAR) || '.mp3' AS filename, n_chars * 1000 AS file_size_bytes, CAST(n_chars / 7.0 AS DECIMAL(10, 2)) AS duration_seconds FROM documents) --final
SELECT filename, file_size_bytes, CAST(file_size_bytes / 1048576.0::DOUBLE AS DECIMAL(10, 2)) AS file_size_mb, duration_seconds,
  round(CAST(duration_seconds AS DOUBLE) / 60 + 1e-9, 2) AS duration_minutes FROM a""")
def _(spark, sf):
    root = scratch_dir(spark, "tables")
    files = tables.transcripts(spark, sf).select(
        F.concat(F.lit("call-"), F.col("call_id").cast("string"), F.lit(".mp3")).alias("filename"),
        (F.col("size_bytes") * 1000).alias("file_size_bytes"), (F.col("size_bytes") / 7).cast("decimal(10,2)").alias("duration_seconds"),
    )
    domain.write_tables({"audio_files": files}, domain.SET_B, root)
    return domain.read_domain(spark, root, domain.SET_B["audio_files"])


# jobs and results made of events, many of them broken; half of the results refer to no file
@query("table_violations", "table_name:str rule:str rows:long", """WITH
j AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'stuck' WHEN 'view' THEN NULL ELSE 'completed' END AS status, CAST(json_extract_string(props, '$.k') AS INT) * 2 - 20 AS progress FROM events),
f AS (SELECT CAST(user_id AS VARCHAR) AS id, 'file-' || CAST(user_id // 2 AS VARCHAR) AS filename FROM events GROUP BY user_id),
r AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN CAST(user_id + 75 AS VARCHAR) END AS audio_file_id, value / 60 - 1.1 AS score,
  repeat('x', 500 + CAST(event_id % 30 AS INT)) || CAST(event_id AS VARCHAR) AS ident, CASE WHEN event_type = 'error' THEN 'Lukewarm' ELSE 'Hot' END AS lead FROM events),
told AS (SELECT 'processing_jobs' AS table_name, 'status_missing' AS rule, count(*) FILTER (WHERE status IS NULL) AS n FROM j
  UNION ALL SELECT 'processing_jobs', 'status_domain', count(*) FILTER (WHERE status = 'stuck') FROM j
  UNION ALL SELECT 'processing_jobs', 'progress_percentage_range', count(*) FILTER (WHERE progress NOT BETWEEN 0 AND 100) FROM j
  UNION ALL SELECT 'audio_files', 'filename_unique', sum(n) FROM (SELECT count(*) AS n FROM f GROUP BY filename HAVING count(*) > 1)
  UNION ALL SELECT 'analysis_results', 'sentiment_score_range', count(*) FILTER (WHERE CAST(score AS DECIMAL(5, 4)) NOT BETWEEN -1 AND 1) FROM r
  UNION ALL SELECT 'analysis_results', 'lead_classification_domain', count(*) FILTER (WHERE lead = 'Lukewarm') FROM r
  UNION ALL SELECT 'analysis_results', 'file_identifier_length', count(*) FILTER (WHERE length(ident) > 512) FROM r
  UNION ALL SELECT 'analysis_results', 'audio_file_id_unique', sum(n) FROM (SELECT count(*) AS n FROM r WHERE audio_file_id IS NOT NULL GROUP BY audio_file_id HAVING count(*) > 1)
  UNION ALL SELECT 'analysis_results', 'audio_file_id_reference', count(*) FROM r WHERE audio_file_id IS NOT NULL AND audio_file_id NOT IN (SELECT id FROM f)) --final
SELECT table_name, rule, n AS rows FROM told WHERE n > 0""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events")
    kind, name = F.col("event_type"), F.col("event_id").cast("string")
    job_rows = events.select(
        name.alias("id"), kind.alias("job_type"), F.when(kind == "click", "stuck").when(kind != "view", "completed").alias("status"),
        (F.get_json_object("props", "$.k").cast("int") * 2 - 20).alias("progress_percentage"),
    )
    files = events.groupBy("user_id").agg(F.lit(1)).select(
        F.col("user_id").cast("string").alias("id"), F.concat(F.lit("file-"), F.floor(F.col("user_id") / 2).cast("string")).alias("filename")
    )
    results = events.select(
        name.alias("id"), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") + 75).cast("string")).alias("audio_file_id"),
        F.concat(F.repeat(F.lit("x"), (500 + F.col("event_id") % 30).cast("int")), name).alias("file_identifier"),
        (F.col("value") / 60 - 1.1).alias("sentiment_score"),
        F.when(kind == "error", "Lukewarm").otherwise("Hot").alias("lead_classification"),
    )
    held = {"processing_jobs": job_rows, "audio_files": files, "analysis_results": results}
    kinds = domain.SET_A | domain.SET_B
    return domain.violations({n: domain.shaped(df, kinds[n], wide=True) for n, df in held.items()}, kinds)
