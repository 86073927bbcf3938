"""Order-dependent operators: windows, ranks and running measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.functions.arrays import rows_of
from calllens.functions.tokens import tokens
from calllens.operators import conversation as conv
from calllens.operators import dashboard, relational, topics
from calllens.operators.extraction import token_rows
from calllens.operators.ordered import count_changes
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.aggregates import N_WORDS, POLARITY_CASE
from catalog.registry import query
from catalog.views import PROBE_V30, PROBE_V31


def _timeline(name, profile):
    @query(name, "call_id:long idx:long t:d6 v:d6", f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')} --final
SELECT call_id, idx, idx / n::DOUBLE * 300 AS t, least(1.0::DOUBLE, {N_WORDS} / {profile.timeline_words}::DOUBLE) AS v FROM sent""")
    def _(spark, sf):
        return conv.engagement_timeline(tables.transcripts(spark, sf), profile)


_timeline("engagement_timeline_v31", PROBE_V31)
_timeline("engagement_timeline_v30", PROBE_V30)


@query("speaker_changes", "call_id:long speaker_changes:long", f"""WITH {sp.TURNS},
seen AS (SELECT call_id, speaker, lag(speaker) OVER (PARTITION BY call_id ORDER BY turn) AS prev FROM turns) --final
SELECT call_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> speaker) AS speaker_changes FROM seen GROUP BY call_id""")
def _(spark, sf):
    return conv.speaker_changes(tables.turns(spark, sf))


# turns whose speaker is not known are passed over
@query("speaker_changes_gaps", "call_id:long speaker_changes:long", f"""WITH {sp.TURNS},
told AS (SELECT call_id, turn, CASE WHEN (turn * 7 + call_id) % 3 > 0 AND call_id % 5 > 0 THEN speaker END AS speaker FROM turns),
seen AS (SELECT call_id, speaker, lag(speaker) OVER (PARTITION BY call_id ORDER BY turn) AS prev FROM told WHERE speaker IS NOT NULL),
changed AS (SELECT call_id, count(*) FILTER (WHERE prev <> speaker) AS n FROM seen GROUP BY call_id) --final
SELECT call_id, coalesce(n, 0) AS speaker_changes FROM (SELECT DISTINCT call_id FROM turns) LEFT JOIN changed USING (call_id)""")
def _(spark, sf):
    known = ((F.col("turn") * 7 + F.col("call_id")) % 3 > 0) & (F.col("call_id") % 5 > 0)
    turns = tables.turns(spark, sf).withColumn("speaker", F.when(known, F.col("speaker")))
    return conv.speaker_changes(turns, bucket_turns=2)


@query("event_changes", "user_id:long changes:long", """WITH seen AS (SELECT user_id, event_type,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) --final
SELECT user_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> event_type) AS changes FROM seen GROUP BY user_id""")
def _(spark, sf):
    # events of one time follow each other by their ids
    events = tables.read_table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return count_changes(events, ["user_id"], "at", "event_type", F.date_trunc("day", "ts"), "changes")


@query("response_time_avg", "user_id:long response_time_avg:d6 event_count:long", """WITH gaps AS (
  SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) --final
SELECT user_id, avg(gap) / 1000000.0 AS response_time_avg, count(*) AS event_count FROM gaps GROUP BY user_id""")
def _(spark, sf):
    return conv.response_time_avg(tables.read_table(spark, sf, "events"), "user_id")


@query("running_performance",
       "call_id:long job_type:str files_processed:long average_duration:d6 success_rate:d6", f"""WITH {sp.CALLS} --final
SELECT call_id, job_type, count(*) OVER w AS files_processed,
  avg(CASE WHEN status = 'completed' THEN duration END) OVER w AS average_duration,
  avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) OVER w AS success_rate
FROM calls WINDOW w AS (PARTITION BY lead_class ORDER BY uploaded_at, call_id)""")
def _(spark, sf):
    return dashboard.running_performance(
        tables.analysis_results(spark, sf), ["lead_class"], [F.col("uploaded_at"), F.col("call_id")],
        F.date_trunc("hour", "uploaded_at"),
    )


@query("top_k_per_call", "call_id:long tok:str n:long rank:long", f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
counted AS (SELECT call_id, tok, count(*) AS n FROM tok GROUP BY call_id, tok),
placed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, tok) AS rank FROM counted) --final
SELECT call_id, tok, n, rank FROM placed WHERE rank <= 15""")
def _(spark, sf):
    counts = token_rows(tables.transcripts(spark, sf)).groupBy("call_id", "tok").agg(F.count(F.lit(1)).alias("n"))
    return topics.top_k_per_call(counts, ["call_id"], [F.col("n").desc(), F.col("tok")], 15)


@query("first_occurrence_distinct", "call_id:long tok:str rank:long", f"""WITH {sp.TURNS},
tok AS (SELECT call_id, turn, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT call_id, turn, {sp.toks('text')} AS t FROM turns) AS x),
firsts AS (SELECT call_id, tok, min(turn * 1000000 + pos) AS place FROM tok GROUP BY call_id, tok),
placed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY place) AS rank FROM firsts) --final
SELECT call_id, tok, rank FROM placed WHERE rank <= 20""")
def _(spark, sf):
    rows = tables.turns(spark, sf).select("call_id", "turn", rows_of(tokens(F.col("text")), "tok", "pos"))
    firsts = rows.groupBy("call_id", "tok").agg(F.min(F.struct("turn", "pos")).alias("place"))
    return topics.top_k_per_call(firsts, ["call_id"], [F.col("place")], 20)


# some turns have no text
@query("sentiment_progression", "call_id:long turn:long sentiment:d6 moving_sentiment:d6",
       f"""WITH {sp.TURNS}, {sp.tok_rows("(SELECT call_id, turn, CASE WHEN turn % 5 <> 3 THEN text END AS text FROM turns) AS q", 'call_id, turn')},
pol AS (SELECT call_id, turn, avg({POLARITY_CASE}) AS p FROM tok GROUP BY call_id, turn),
full_pol AS (SELECT t.call_id, t.turn, coalesce(p, 0) AS sentiment FROM turns AS t LEFT JOIN pol USING (call_id, turn)) --final
SELECT call_id, turn, sentiment, avg(sentiment) OVER (PARTITION BY call_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_sentiment FROM full_pol""")
def _(spark, sf):
    turns = tables.turns(spark, sf).withColumn("text", F.when(F.col("turn") % 5 != 3, F.col("text")))
    return conv.sentiment_progression(turns, PROBE_V31)


@query("latest_per_call", "user_id:long call_id:long uploaded_at:ts status:str", f"""WITH {sp.CALLS},
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, call_id DESC) AS r FROM calls) --final
SELECT user_id, call_id, uploaded_at, status FROM placed WHERE r = 1""")
def _(spark, sf):
    return relational.latest_per_call(
        tables.analysis_results(spark, sf), "user_id", "uploaded_at", "call_id", ["call_id", "uploaded_at", "status"]
    )


@query("rank_leads", "call_id:long lead_class:str score:d6 rank:long percent_rank:d6 quartile:long", f"""WITH {sp.CALLS},
placed AS (SELECT call_id, lead_class, score, rank() OVER w AS rank, percent_rank() OVER w AS percent_rank,
  ntile(4) OVER (PARTITION BY lead_class ORDER BY score DESC, call_id) AS quartile FROM calls WINDOW w AS (PARTITION BY lead_class ORDER BY score DESC)) --final
SELECT * FROM placed""")
def _(spark, sf):
    return dashboard.rank_leads(tables.analysis_results(spark, sf))
