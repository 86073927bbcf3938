"""Aggregations per call and over the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.operators import conversation as conv
from calllens.operators import dashboard, topics
from calllens.functions.tokens import tokens
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.registry import query
from catalog.views import PROBE_V30, PROBE_V31, asking, asking_docs

FLOW = "call_id:long total_sentences:long average_sentence_length:d6 question_count:long exclamation_count:long conversation_pace:str"
N_WORDS = r"len(regexp_extract_all(sent, '\S+'))"


def flow_sql(source: str) -> str:
    return f"""SELECT call_id, count(*) AS total_sentences, avg({N_WORDS}) AS average_sentence_length,
  count(*) FILTER (WHERE ends_with(sent, '?')) AS question_count,
  count(*) FILTER (WHERE ends_with(sent, '!')) AS exclamation_count, 'moderate' AS conversation_pace
FROM {source} GROUP BY call_id"""


@query("conversation_flow", FLOW,
       f"WITH {sp.TRANSCRIPTS}, {sp.ASKING_DOCS}, {sp.sent_rows('asking_docs')} --final\n{flow_sql('sent')}")
def _(spark, sf):
    return conv.conversation_flow(asking_docs(spark, sf))


@query("conversation_flow_turns", FLOW,
       f"WITH {sp.TURNS}, {sp.ASKING}, {sp.sent_rows('asking', 'call_id, turn')} --final\n{flow_sql('sent')}")
def _(spark, sf):
    return conv.conversation_flow(asking(spark, sf), by_turn=True)


QUESTIONS = "call_id:long total_questions:long open_ended:long yes_no:long clarifying:long sample_questions:list"


def question_sql(profile, key: str, order: str, base: str) -> str:
    yes_no = sp.in_list(profile.yes_no)
    return f"""SELECT b.call_id, count(q.sent) AS total_questions,
  count(q.sent) FILTER (WHERE {sp.any_like('lower(q.sent)', profile.open_ended)}) AS open_ended,
  count(q.sent) FILTER (WHERE string_split_regex(lower(q.sent), '\\s+')[1] IN {yes_no}
                          OR string_split_regex(lower(q.sent), '\\s+')[2] IN {yes_no}) AS yes_no,
  count(q.sent) FILTER (WHERE {sp.any_like('lower(q.sent)', profile.clarifying)}) AS clarifying,
  coalesce(list(q.sent ORDER BY {order}) FILTER (WHERE q.sent IS NOT NULL), [])[:{profile.sample_questions}] AS sample_questions
FROM (SELECT DISTINCT call_id FROM {base}) AS b
LEFT JOIN (SELECT * FROM sent WHERE ends_with(sent, '?')) AS q ON q.call_id = b.call_id GROUP BY b.call_id"""


def _questions(name, profile):
    @query(name, QUESTIONS, f"WITH {sp.TRANSCRIPTS}, {sp.ASKING_DOCS}, {sp.sent_rows('asking_docs')} --final\n"
           + question_sql(profile, "call_id", "q.idx", "transcripts"))
    def _(spark, sf):
        return conv.question_summary(asking_docs(spark, sf), profile)


_questions("question_summary_v31", PROBE_V31)
_questions("question_summary_v30", PROBE_V30)


@query("question_summary_turns", QUESTIONS,
       f"WITH {sp.TURNS}, {sp.ASKING}, {sp.sent_rows('asking', 'call_id, turn')} --final\n"
       + question_sql(PROBE_V31, "call_id", "q.turn, q.idx", "turns"))
def _(spark, sf):
    return conv.question_summary_turns(asking(spark, sf), PROBE_V31)


POLARITY_CASE = "CASE " + " ".join(f"WHEN tok = {sp.lit(t)} THEN {w}::DOUBLE" for t, w in PROBE_V31.polarity.items()) + " END"
CONCERNS = ", ".join(f"CASE WHEN bool_or(contains(lower(t.text), {sp.lit(c)})) THEN {sp.lit(c)} END" for c in PROBE_V31.concern)


@query("speaker_profile",
       "call_id:long speaker:str turn_count:long word_count:long share_pct:d6 positive_share:d6 negative_share:d6 neutral_share:d6 engagement:d6 concerns:list",
       f"""WITH {sp.TURNS}, {sp.tok_rows('turns', 'call_id, turn')}, {sp.sent_rows('turns', 'call_id, turn')},
pol AS (SELECT call_id, turn, coalesce(avg({POLARITY_CASE}), 0) AS p, count(*) AS words FROM tok GROUP BY call_id, turn),
eng AS (SELECT call_id, turn, sum(least(1.0::DOUBLE, {N_WORDS} / 25.0::DOUBLE)) AS e, count(*) AS k FROM sent GROUP BY call_id, turn),
spoken AS (SELECT t.call_id, t.speaker, count(*) AS turn_count, sum(coalesce(words, 0)) AS word_count,
  avg(CASE WHEN coalesce(p, 0) > 0.2 THEN 1.0 ELSE 0.0 END) AS positive_share,
  avg(CASE WHEN coalesce(p, 0) < -0.2 THEN 1.0 ELSE 0.0 END) AS negative_share,
  avg(CASE WHEN coalesce(p, 0) BETWEEN -0.2 AND 0.2 THEN 1.0 ELSE 0.0 END) AS neutral_share,
  coalesce(sum(e) / sum(k), 0) AS engagement, list_filter([{CONCERNS}], lambda x: x IS NOT NULL) AS concerns
  FROM turns AS t LEFT JOIN pol USING (call_id, turn) LEFT JOIN eng USING (call_id, turn) GROUP BY t.call_id, t.speaker) --final
SELECT *, 100.0::DOUBLE * word_count / sum(word_count) OVER (PARTITION BY call_id) AS share_pct FROM spoken""")
def _(spark, sf):
    return conv.speaker_profile(tables.turns(spark, sf), PROBE_V31)


PHRASES = "call_id:long name:str n:long relevance:d6"
PHRASE_TOP = """counted AS (SELECT call_id, phrase AS name, count(*) AS n FROM phr GROUP BY call_id, phrase),
placed AS (SELECT *, n / sum(n) OVER (PARTITION BY call_id) AS relevance,
  row_number() OVER (PARTITION BY call_id ORDER BY n DESC, name) AS r FROM counted)"""


@query("phrase_frequency", PHRASES,
       f"WITH {sp.TRANSCRIPTS}, {sp.phrase_rows('transcripts')}, {PHRASE_TOP} --final\nSELECT call_id, name, n, relevance FROM placed WHERE r <= 15")
def _(spark, sf):
    return topics.phrase_frequency(tables.transcripts(spark, sf), PROBE_V31)


@query("phrase_frequency_turns", PHRASES,
       f"WITH {sp.TURNS}, {sp.phrase_rows('turns', 'call_id, turn')}, {PHRASE_TOP} --final\nSELECT call_id, name, n, relevance FROM placed WHERE r <= 15")
def _(spark, sf):
    return topics.phrase_frequency_turns(tables.turns(spark, sf), PROBE_V31)


def tfidf_sql(profile) -> str:
    stop = sp.in_list(profile.stop_words)
    joins, term = "", "a.w"
    grams = ["SELECT call_id, w AS term FROM kept"]
    for k in range(1, profile.ngram_max):
        joins += f" JOIN kept AS k{k} ON k{k}.call_id = a.call_id AND k{k}.p = a.p + {k}"
        term += f" || ' ' || k{k}.w"
        grams.append(f"SELECT a.call_id, {term} FROM kept AS a{joins}")
    return rf"""WITH {sp.TRANSCRIPTS},
raw AS (SELECT call_id, unnest(t) AS w, unnest(range(len(t))) AS i
  FROM (SELECT call_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM transcripts) AS x),
kept AS (SELECT call_id, w, row_number() OVER (PARTITION BY call_id ORDER BY i) AS p FROM raw WHERE w NOT IN {stop}),
gram AS ({' UNION ALL '.join(grams)}),
tf AS (SELECT call_id, term, count(*) AS n FROM gram GROUP BY call_id, term),
total AS (SELECT count(*) AS n_docs FROM transcripts),
vocab AS (SELECT term, count(*) AS df, sum(n) AS cf FROM tf GROUP BY term
  HAVING count(*) <= {profile.max_df} * (SELECT n_docs FROM total) ORDER BY cf DESC, term LIMIT {profile.max_features}),
weighted AS (SELECT call_id, term, n * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN vocab USING (term), total),
scaled AS (SELECT call_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY call_id)) AS weight FROM weighted),
placed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(weight, 12) DESC, term) AS rank FROM scaled) --final
SELECT call_id, term, weight, rank FROM placed WHERE rank <= {profile.max_topics}"""


TFIDF = "call_id:long term:str weight:d6 rank:long"


@query("tfidf_v31", TFIDF, tfidf_sql(PROBE_V31))
def _(spark, sf):
    return topics.tfidf(tables.transcripts(spark, sf), PROBE_V31)


@query("tfidf_v30", TFIDF, tfidf_sql(PROBE_V30))
def _(spark, sf):
    return topics.tfidf(tables.transcripts(spark, sf), PROBE_V30)


@query("distinct_terms", "call_id:long terms:list", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, list_sort(list_distinct({sp.toks('text')})) AS terms FROM transcripts""")
def _(spark, sf):
    return tables.transcripts(spark, sf).select(
        "call_id", F.sort_array(F.array_distinct(tokens(F.col("text")))).alias("terms")
    )


@query("text_features",
       "call_id:long total_word_count:long unique_word_count:long sentence_count:long avg_sentence_length:d6 "
       "question_count:long exclamation_count:long positive_word_ratio:d6 question_word_ratio:d6",
       rf"""WITH {sp.TRANSCRIPTS}, {sp.ASKING_DOCS},
piece AS (SELECT call_id, unnest(string_split(text, '.')) AS s FROM asking_docs),
spoken AS (SELECT call_id, count(*) AS k, count(*) FILTER (WHERE contains(s, '?')) AS q, count(*) FILTER (WHERE contains(s, '!')) AS e
  FROM piece WHERE trim(regexp_replace(s, '\s+', ' ', 'g')) <> '' GROUP BY call_id),
wd AS (SELECT call_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM asking_docs),
wc AS (SELECT call_id, count(*) AS n, count(DISTINCT w) AS u,
  count(*) FILTER (WHERE {sp.any_like('w', ('that', 'with', 'der'))}) AS pos, count(*) FILTER (WHERE w IN ('in', 'la', 'und')) AS qw FROM wd GROUP BY call_id) --final
SELECT t.call_id, coalesce(n, 0) AS total_word_count, coalesce(u, 0) AS unique_word_count, coalesce(k, 0) AS sentence_count,
  coalesce(n, 0) / greatest(coalesce(k, 0), 1) AS avg_sentence_length, coalesce(q, 0) AS question_count, coalesce(e, 0) AS exclamation_count,
  coalesce(pos, 0) / greatest(coalesce(n, 0), 1) AS positive_word_ratio, coalesce(qw, 0) / greatest(coalesce(n, 0), 1) AS question_word_ratio
FROM transcripts AS t LEFT JOIN spoken USING (call_id) LEFT JOIN wc USING (call_id)""")
def _(spark, sf):
    return conv.text_features(
        asking_docs(spark, sf), positive=("that", "with", "der"), question_words=("in", "la", "und")
    )


# dashboard ------------------------------------------------------------------


@query("lead_score_distribution", "lead_class:str calls:long",
       f"WITH {sp.CALLS} --final\nSELECT lead_class, count(*) AS calls FROM calls GROUP BY lead_class")
def _(spark, sf):
    return dashboard.lead_score_distribution(tables.analysis_results(spark, sf))


@query("sentiment_trend", "bucket:ts mean_sentiment:d6 calls:long",
       f"WITH {sp.CALLS} --final\nSELECT date_trunc('day', uploaded_at)::TIMESTAMP AS bucket, avg(sentiment) AS mean_sentiment, count(*) AS calls FROM calls GROUP BY 1")
def _(spark, sf):
    return dashboard.sentiment_trend(tables.analysis_results(spark, sf))


@query("processing_performance", "job_type:str total_calls:long avg_processing_time:d6 success_rate:d6",
       f"""WITH {sp.CALLS} --final
SELECT job_type, count(*) AS total_calls, avg(duration) FILTER (WHERE status = 'completed') AS avg_processing_time,
  avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) AS success_rate FROM calls GROUP BY job_type""")
def _(spark, sf):
    return dashboard.processing_performance(tables.analysis_results(spark, sf), ["job_type"])


@query("processing_percentiles", "job_type:str p50:d6 p95:d6",
       f"""WITH {sp.CALLS} --final
SELECT job_type, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95
FROM calls WHERE status = 'completed' GROUP BY job_type""")
def _(spark, sf):
    return dashboard.processing_percentiles(tables.analysis_results(spark, sf), "job_type")


@query("processing_percentiles_approx", "job_type:str p50:d6 p95:d6")
def _(spark, sf):
    return dashboard.processing_percentiles_approx(tables.analysis_results(spark, sf), "job_type")


@query("model_accuracy", "task:str accuracy:d6 rows:long", """WITH both_tasks AS (
  SELECT 'quality' AS task, CAST(n_chars > 1500 AS INTEGER) AS prediction, quality AS label FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'toxicity', CAST(lang <> 'en' AS INTEGER), toxic FROM labels JOIN documents USING (doc_id)) --final
SELECT task, avg(CAST(prediction = label AS INTEGER)) AS accuracy, count(*) AS rows FROM both_tasks GROUP BY task""")
def _(spark, sf):
    joined = tables.read_table(spark, sf, "labels").join(
        tables.read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id"
    )
    pairs = joined.select(F.inline(F.array(
        F.struct(F.lit("quality").alias("task"), (F.col("n_chars") > 1500).cast("int").alias("prediction"), F.col("quality").alias("label")),
        F.struct(F.lit("toxicity").alias("task"), (F.col("lang") != "en").cast("int").alias("prediction"), F.col("toxic").alias("label")),
    )))
    return dashboard.model_accuracy(pairs)


@query("metric_rollup",
       "metric_name:str component:str environment:str day:ts level:long samples:long mean_value:d6 min_value:d6 max_value:d6 latest_value:d6",
       f"""WITH {sp.METRICS} --final
SELECT metric_name, component, environment, date_trunc('day', ts)::TIMESTAMP AS day, grouping(metric_name, component, environment, date_trunc('day', ts)) AS level,
  count(*) AS samples, avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value, arg_max(value, ts) AS latest_value
FROM metrics GROUP BY ROLLUP (metric_name, component, environment, date_trunc('day', ts))""")
def _(spark, sf):
    metrics = tables.metrics(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return dashboard.metric_rollup(metrics, ["metric_name", "component", "environment", "day"], tie="metric_id")


@query("log_summary", "log_level:str stage:str grouping:long entries:long", f"""WITH {sp.LOGS} --final
SELECT log_level, stage, grouping(log_level, stage) AS grouping, count(*) AS entries FROM logs GROUP BY CUBE (log_level, stage)""")
def _(spark, sf):
    return dashboard.log_summary(tables.logs(spark, sf))


@query("errors_per_analysis", "analysis_id:long errors:long entries:long", f"""WITH {sp.LOGS} --final
SELECT analysis_id, count(*) FILTER (WHERE log_level = 'ERROR') AS errors, count(*) AS entries FROM logs GROUP BY analysis_id""")
def _(spark, sf):
    return dashboard.errors_per_analysis(tables.logs(spark, sf), "analysis_id")


@query("label_distribution", "quality:long rows:long", "--final\nSELECT quality, count(*) AS rows FROM labels GROUP BY quality")
def _(spark, sf):
    return dashboard.label_distribution(tables.read_table(spark, sf, "labels"), "quality")
