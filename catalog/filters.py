"""Filters, predicates and listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.config import Bootstrap
from calllens.functions import extract
from calllens.functions.text import clean_transcript
from calllens.functions.arrays import first_distinct
from calllens.functions.tokens import tokens
from calllens.operators import listing, scoring
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.projections import BUCKET, clean_sql
from catalog.registry import query
from catalog.views import PROBE_V30, PROBE_V31

ROW = "call_id:long file_name:str uploaded_at:ts lead_class:str sentiment:d6"
PICK = "call_id, file_name, uploaded_at, lead_class, sentiment"


@query("search_calls", ROW, f"""WITH {sp.CALLS} --final
SELECT {PICK} FROM calls WHERE contains(lower(file_name), 'call-1') AND lead_class = 'Hot'
  AND {BUCKET} = 'Positive' AND uploaded_at >= TIMESTAMP '2024-01-03' AND uploaded_at < TIMESTAMP '2024-01-25'""")
def _(spark, sf):
    return listing.search_calls(
        tables.analysis_results(spark, sf), "CALL-1", "Hot", "Positive", ("2024-01-03", "2024-01-25")
    )


@query("search_transcripts", "call_id:long file_name:str", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, file_name FROM transcripts
WHERE contains(lower(file_name), 'of the') OR contains(lower(text), 'of the')""")
def _(spark, sf):
    return listing.search_calls(tables.transcripts(spark, sf), "Of The")


@query("get_call", ROW, f"WITH {sp.CALLS} --final\nSELECT {PICK} FROM calls WHERE file_name = 'call-42.json'")
def _(spark, sf):
    return listing.get_call(tables.analysis_results(spark, sf), "call-42.json")


@query("by_status", ROW, f"WITH {sp.CALLS} --final\nSELECT {PICK} FROM calls WHERE status = 'failed'")
def _(spark, sf):
    return listing.by_status(tables.analysis_results(spark, sf), "failed")


@query("by_classification", ROW, f"WITH {sp.CALLS} --final\nSELECT {PICK} FROM calls WHERE lead_class IN ('Hot', 'Warm')")
def _(spark, sf):
    return listing.by_classification(tables.analysis_results(spark, sf), "Hot", "Warm")


@query("by_confidence", ROW, f"WITH {sp.CALLS} --final\nSELECT {PICK} FROM calls WHERE confidence >= 0.8")
def _(spark, sf):
    return listing.by_confidence(tables.analysis_results(spark, sf), 0.8)


@query("live_sessions", "call_id:long expires_at:ts", """--final
SELECT event_id AS call_id, ts + INTERVAL 30 MINUTE AS expires_at FROM events
WHERE ts + INTERVAL 30 MINUTE >= TIMESTAMP '2024-01-20 12:00:00'""")
def _(spark, sf):
    sessions = tables.analysis_results(spark, sf).select(
        "call_id", (F.col("uploaded_at") + F.expr("INTERVAL 30 MINUTES")).alias("expires_at")
    )
    return listing.live_sessions(sessions, F.lit("2024-01-20 12:00:00").cast("timestamp"))


@query("contains_any", "call_id:long found:bool", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, {sp.any_like('lower(text)', PROBE_V31.concern)} AS found FROM transcripts""")
def _(spark, sf):
    return tables.transcripts(spark, sf).select(
        "call_id", extract.contains_any(F.lower("text"), PROBE_V31.concern).alias("found")
    )


@query("matched_keywords", "call_id:long substring_hits:list token_hits:list", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id, {sp.hit_list('lower(text)', PROBE_V31.concern)} AS substring_hits,
  {sp.hit_list("' ' || array_to_string(" + sp.toks('text') + ", ' ') || ' '", [f' {t} ' for t in PROBE_V31.concern])} AS padded,
  list_transform(padded, lambda p: trim(p)) AS token_hits
FROM transcripts""")
def _(spark, sf):
    low = F.lower("text")
    return tables.transcripts(spark, sf).select(
        "call_id",
        extract.matched(low, PROBE_V31.concern).alias("substring_hits"),
        extract.matched(low, PROBE_V31.concern, "token").alias("token_hits"),
    )


@query("json_contains", "call_id:long", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id FROM transcripts WHERE list_contains({sp.toks('text')}, 'of') AND list_contains({sp.toks('text')}, 'was')""")
def _(spark, sf):
    tagged = tables.transcripts(spark, sf).select("call_id", F.array_distinct(tokens(F.col("text"))).alias("tags"))
    return listing.json_contains(tagged, "tags", "of", "was").select("call_id")


@query("list_calls_by_time", "call_id:long file_name:str uploaded_at:ts", f"""WITH {sp.CALLS} --final
SELECT call_id, file_name, uploaded_at FROM calls ORDER BY uploaded_at DESC, file_name LIMIT 50 OFFSET 100""")
def _(spark, sf):
    calls = tables.analysis_results(spark, sf)
    return listing.list_calls(calls, page=3, page_size=50, total=calls.count())


@query("list_calls_by_size", "call_id:long file_name:str size_bytes:long", f"""WITH {sp.CALLS} --final
SELECT call_id, file_name, size_bytes FROM calls ORDER BY size_bytes, file_name LIMIT 100""")
def _(spark, sf):
    return listing.list_calls(
        tables.analysis_results(spark, sf), page_size=100, sort_by="file_size", order="asc"
    )


@query("page_info",
       "current_page:long items_per_page:long total_items:long total_pages:long has_next_page:bool has_previous_page:bool",
       f"""WITH {sp.CALLS} --final
SELECT 3 AS current_page, 50 AS items_per_page, count(*) AS total_items, ceil(count(*) / 50.0) AS total_pages,
       3 < ceil(count(*) / 50.0) AS has_next_page, TRUE AS has_previous_page FROM calls""")
def _(spark, sf):
    return listing.page_info(tables.analysis_results(spark, sf), 3, 50)


@query("first_n_items", "call_id:long items:list", f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
firsts AS (SELECT call_id, tok, min(pos) AS pos FROM tok GROUP BY call_id, tok),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) AS r FROM firsts) --final
SELECT t.call_id, coalesce(list(r.tok ORDER BY r.r) FILTER (WHERE r.r <= 20), []) AS items
FROM transcripts AS t LEFT JOIN ranked AS r ON r.call_id = t.call_id GROUP BY t.call_id""")
def _(spark, sf):
    return tables.transcripts(spark, sf).select(
        "call_id", first_distinct(tokens(F.col("text")), PROBE_V31.max_phrases).alias("items")
    )


# lead scores ---------------------------------------------------------------

SCORE = "call_id:long token_count:long n_interest:long n_buying:long n_concern:long lead_score:d6 lead_class:str lead_confidence:d6"


def score_sql(profile, low: str, n_tokens: str) -> str:
    wi, wb, wc, _ = profile.weights
    i, b, c = (sp.hits(low, getattr(profile, n)) for n in ("interest", "buying", "concern"))
    return (
        f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50.0::DOUBLE + {i} * {wi} + {b} * {wb} + {c} * ({wc}) "
        f"+ least({profile.length_cap}::DOUBLE, {n_tokens} / {profile.tokens_per_point}::DOUBLE)))"
    )


def class_sql(profile, value: str) -> str:
    whens = " ".join(f"WHEN {value} >= {bound} THEN '{name}'" for bound, name in profile.classes)
    return f"CASE {whens} ELSE '{profile.floor_class}' END"


SOME_TEXT_SQL = "CASE WHEN call_id % 37 <> 5 THEN text END"


def some_text(calls):
    """Calls of which some have no text."""
    return calls.withColumn("text", F.when(F.col("call_id") % 37 != 5, F.col("text")))


def _lead(name, profile):
    counts = ", ".join(f"{sp.hits('low', getattr(profile, n))} AS n_{n}" for n in ("interest", "buying", "concern"))
    sql = f"""WITH {sp.TRANSCRIPTS},
staged AS (SELECT call_id, lower({SOME_TEXT_SQL}) AS low, len({sp.words(SOME_TEXT_SQL)}) AS n FROM transcripts),
scored AS (SELECT *, {counts}, {score_sql(profile, 'low', 'n')} AS s FROM staged) --final
SELECT call_id, coalesce(n, 0) AS token_count, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in ("interest", "buying", "concern"))},
  CASE WHEN low IS NULL THEN 50 ELSE s END AS lead_score, CASE WHEN low IS NULL THEN 'Warm' ELSE {class_sql(profile, 's')} END AS lead_class,
  CASE WHEN low IS NULL THEN 0.5 ELSE 0.8 END AS lead_confidence FROM scored"""

    @query(name, SCORE, sql)
    def _(spark, sf):
        return scoring.lead_score(some_text(tables.transcripts(spark, sf)), profile)


_lead("lead_score_v31", PROBE_V31)


_lead("lead_score_v30", PROBE_V30)


@query("signal_extract", "call_id:long interest_signals:list buying_signals:list concern_signals:list",
       f"WITH {sp.TRANSCRIPTS} --final\nSELECT call_id, " + ", ".join(
           f"{sp.hit_list('lower(text)', getattr(PROBE_V31, n), p)} AS {n}_signals"
           for n, p in zip(("interest", "buying", "concern"), PROBE_V31.prefixes)) + " FROM transcripts")
def _(spark, sf):
    return scoring.signal_extract(tables.transcripts(spark, sf), PROBE_V31)


# The flagship: calls as turns.  A term counts when some turn holds it.
def _flagship():
    p = PROBE_V31
    flags = [(n, i, t) for n in ("interest", "buying", "concern") for i, t in enumerate(getattr(p, n))]
    any_turn = ", ".join(f"max(CAST(contains(lower(text), {sp.lit(t)}) AS INTEGER)) AS {n}_{i}" for n, i, t in flags)
    sums = {n: " + ".join(f"{n}_{i}" for m, i, _ in flags if m == n) for n in ("interest", "buying", "concern")}
    lists = ", ".join(
        "list_filter([" + ", ".join(f"CASE WHEN {n}_{i} = 1 THEN {sp.lit(pre + t)} END" for m, i, t in flags if m == n)
        + f"], lambda x: x IS NOT NULL) AS {n}_signals"
        for n, pre in zip(("interest", "buying", "concern"), p.prefixes)
    )
    wi, wb, wc, _ = p.weights
    sql = f"""WITH {sp.TURNS}, tidy AS (SELECT call_id, {clean_sql('text', p)} AS text FROM turns),
called AS (SELECT call_id, sum(len({sp.words('text')})) AS token_count, {any_turn},
  bool_or({sp.any_like('lower(text)', p.analytical)}) AS analytical, bool_or(contains(lower(text), 'we')) AS we
  FROM tidy GROUP BY call_id),
scored AS (SELECT *, {lists}, {sums['interest']} AS n_interest, {sums['buying']} AS n_buying, {sums['concern']} AS n_concern,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50.0::DOUBLE + ({sums['interest']}) * {wi} + ({sums['buying']}) * {wb} + ({sums['concern']}) * ({wc})
  + least(25.0::DOUBLE, token_count / 80.0::DOUBLE))) AS lead_score FROM called) --final
SELECT *, {class_sql(p, 'lead_score')} AS lead_class, lead_score / 100 AS conversion_probability,
  CASE WHEN analytical THEN 'Analytical' ELSE 'Relationship-focused' END AS personality,
  CASE WHEN we THEN 'Collaborative' ELSE 'Individual' END AS decision_style FROM scored"""

    @query("call_leads",
           "call_id:long token_count:long n_interest:long n_buying:long n_concern:long lead_score:d6 lead_class:str "
           "conversion_probability:d6 personality:str decision_style:str interest_signals:list buying_signals:list concern_signals:list",
           sql)
    def _(spark, sf):
        # each turn is cleaned as a transcript is
        turns = tables.turns(spark, sf).withColumn("text", clean_transcript(F.col("text"), p))
        return scoring.lead_score_turns(turns, p).orderBy(F.col("lead_score").desc(), "call_id")


_flagship()


@query("bootstrap_score", "id:long label:str confidence:d6", f"""WITH {sp.TRANSCRIPTS} --final
SELECT call_id AS id, CASE WHEN contains(lower(text), 'of the') OR contains(lower(text), 'queue') THEN 'Hot'
  WHEN contains(lower(text), 'in ') THEN 'Warm' ELSE 'Cold' END AS label, 0.75 AS confidence
FROM transcripts WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def _(spark, sf):
    rule = Bootstrap(hot=("of the", "queue"), warm=("in ",))
    calls = tables.transcripts(spark, sf).withColumnRenamed("call_id", "id")
    return scoring.bootstrap_score(calls, rule=rule)


@query("score_batch", "id:long label:str confidence:d6", """--final
SELECT item_id AS id, CASE WHEN contains(lower(text), 'pricing') OR contains(lower(text), 'interested') THEN 'Hot'
  WHEN contains(lower(text), 'call back') THEN 'Warm' ELSE 'Cold' END AS label, 0.75 AS confidence
FROM (SELECT item_id, CASE WHEN item_id < 20 THEN text || ' Pricing?' WHEN item_id < 30 THEN text || ' Call back.' ELSE text END AS text
      FROM benchmark) AS b""")
def _(spark, sf):
    item = F.col("item_id")
    text = (F.when(item < 20, F.concat("text", F.lit(" Pricing?")))
            .when(item < 30, F.concat("text", F.lit(" Call back."))).otherwise(F.col("text")))
    batch = tables.read_table(spark, sf, "benchmark").select(item.alias("id"), text.alias("text"))
    return scoring.score_batch(batch)


@query("rule_label", "call_id:long rule_score:d6 rule_label:str", f"""WITH {sp.CALLS},
f AS (SELECT call_id, sentiment * 0.3 + (confidence / 2) * 0.2 + (least(10.0::DOUBLE, duration / 10) / 10.0) * 0.3
      + ((CAST(score AS BIGINT) % 10) / 10.0::DOUBLE) * 0.2 AS rule_score FROM calls) --final
SELECT call_id, rule_score, CASE WHEN rule_score > 0.6 THEN 'Hot' WHEN rule_score > 0.3 THEN 'Warm' ELSE 'Cold' END AS rule_label FROM f""")
def _(spark, sf):
    features = tables.analysis_results(spark, sf).select(
        "call_id",
        F.col("sentiment").alias("sentiment_score"),
        (F.col("confidence") / 2).alias("positive_word_ratio"),
        F.least(F.lit(10.0), F.col("duration") / 10).alias("engagement_score"),
        (F.col("score").cast("bigint") % 10).alias("interest_signals"),
    )
    return scoring.rule_labels(features)


@query("lead_detail_flags",
       "call_id:long budget_discussion_detected:bool timeline_mentioned:bool competitor_mentioned:bool buying_intent_score:d6 followup_priority:str",
       f"""WITH {sp.TRANSCRIPTS},
scored AS (SELECT call_id, lower(text) AS low, {score_sql(PROBE_V31, 'lower(text)', f"len({sp.words('text')})")} AS s FROM transcripts) --final
SELECT call_id, contains(low, 'from') AS budget_discussion_detected, {sp.any_like('low', ('by', 'to the'))} AS timeline_mentioned,
  {sp.any_like('low', PROBE_V31.competitor)} AS competitor_mentioned, {sp.hits('low', PROBE_V31.buying)} / 3.0::DOUBLE AS buying_intent_score,
  CASE WHEN s >= 80 THEN 'High' WHEN s >= 60 THEN 'Medium' ELSE 'Low' END AS followup_priority FROM scored""")
def _(spark, sf):
    scored = scoring.lead_score(tables.transcripts(spark, sf), PROBE_V31)
    return scoring.lead_detail_flags(scored, PROBE_V31, budget=("from",), timeline=("by", "to the"))
