"""Joins, keyed updates, set operations and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens.functions.extract import contains_any
from calllens.operators import extraction, quality, relational
from calllens.sources import tables
from catalog import sqlparts as sp
from catalog.registry import query
from catalog.views import NAMES, PROBE_V31, lexicon_table, names_table


@query("call_overview", "call_id:long file_name:str sentiment:d6 lead_class:str", f"""WITH {sp.CALLS} --final
SELECT c.call_id, c.file_name, s.sentiment, l.lead_class FROM calls AS c
LEFT JOIN (SELECT call_id, sentiment FROM calls WHERE status = 'completed') AS s ON s.call_id = c.call_id
LEFT JOIN (SELECT call_id, lead_class FROM calls WHERE score >= 30) AS l ON l.call_id = c.call_id""")
def _(spark, sf):
    calls = tables.analysis_results(spark, sf)
    return relational.call_overview(
        calls.select("call_id", "file_name"),
        calls.where(F.col("status") == "completed").select("call_id", "sentiment"),
        calls.where(F.col("score") >= 30).select("call_id", "lead_class"),
    )


@query("call_nested", "o_orderkey:long chunk:long parts:list suppliers:list", """WITH
kids AS (SELECT l_orderkey, l_linenumber // 3 AS chunk, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS parts
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
more AS (SELECT l_orderkey, l_linenumber // 3 AS chunk, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_suppkey) AS suppliers
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
both_lists AS (SELECT coalesce(k.l_orderkey, m.l_orderkey) AS o_orderkey, coalesce(k.chunk, m.chunk) AS chunk, parts, suppliers
  FROM kids AS k FULL JOIN more AS m ON k.l_orderkey = m.l_orderkey AND k.chunk = m.chunk) --final
SELECT o.o_orderkey, coalesce(b.chunk, 0) AS chunk, b.parts, b.suppliers
FROM orders AS o LEFT JOIN both_lists AS b ON b.o_orderkey = o.o_orderkey""")
def _(spark, sf):
    lines = tables.read_table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = relational.nest_children(
        lines.where(F.col("l_returnflag") != "R"), "o_orderkey", "l_linenumber", ["l_partkey"], "parts", 3
    )
    suppliers = relational.nest_children(
        lines.where(F.col("l_linestatus") == "O"), "o_orderkey", "l_linenumber", ["l_suppkey"], "suppliers", 3
    )
    orders = tables.read_table(spark, sf, "orders").select("o_orderkey")
    nested = relational.call_nested(orders, [parts, suppliers], "o_orderkey")
    return nested.select(
        "o_orderkey", "chunk",
        F.transform("parts", lambda p: p["l_partkey"].cast("string")).alias("parts"),
        F.transform("suppliers", lambda p: p["l_suppkey"].cast("string")).alias("suppliers"),
    )


@query("orphans", "o_orderkey:long o_custkey:long", """--final
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)""")
def _(spark, sf):
    parents = tables.read_table(spark, sf, "customer").where(F.col("c_acctbal") > 1000)
    return relational.orphans(tables.read_table(spark, sf, "orders"), parents, "o_custkey", "c_custkey")


def _deleted(spark, sf):
    customers = tables.read_table(spark, sf, "customer")
    return customers.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))


@query("cascade_delete", "o_orderkey:long o_custkey:long", """--final
SELECT o_orderkey, o_custkey FROM orders AS o WHERE NOT EXISTS
  (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    return relational.cascade_delete(tables.read_table(spark, sf, "orders"), _deleted(spark, sf), "o_custkey")


@query("cascade_targets", "o_orderkey:long o_custkey:long", """--final
SELECT o_orderkey, o_custkey FROM orders AS o WHERE EXISTS
  (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    return relational.cascade_targets(tables.read_table(spark, sf, "orders"), _deleted(spark, sf), "o_custkey")


LEXICON_SQL = "(VALUES " + ", ".join(
    f"({sp.lit(t)}, '{c}')" for c in ("interest", "buying", "concern") for t in getattr(PROBE_V31, c) if " " not in t
) + ") AS lex(term, category)"


@query("lexicon_join", "call_id:long category:str hits:long first_pos:long", f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')} --final
SELECT call_id, category, count(*) AS hits, min(pos) AS first_pos FROM tok JOIN {LEXICON_SQL} ON tok.tok = lex.term GROUP BY call_id, category""")
def _(spark, sf):
    joined = extraction.lexicon_join(
        extraction.token_rows(tables.transcripts(spark, sf)), lexicon_table(spark)
    )
    return joined.groupBy("call_id", "category").agg(
        F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos")
    )


@query("context_window", "call_id:long start:long n_tokens:long lo:long hi:long context_md5:str",
       f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
hit AS (SELECT call_id, pos AS start FROM tok WHERE tok IN ('was', 'nicht', 'queue')) --final
SELECT h.call_id, h.start, count(*) AS n_tokens, min(t.pos) AS lo, max(t.pos) AS hi, md5(string_agg(t.tok, ' ' ORDER BY t.pos)) AS context_md5
FROM hit AS h JOIN tok AS t ON t.call_id = h.call_id AND t.pos BETWEEN h.start - 25 AND h.start + 25 GROUP BY h.call_id, h.start""")
def _(spark, sf):
    toks = extraction.token_rows(tables.transcripts(spark, sf))
    matches = toks.where(F.col("tok").isin("was", "nicht", "queue")).select(
        "call_id", F.col("pos").alias("start"), F.lit(1).alias("n")
    )
    # a context holds at most 2k + n tokens
    return extraction.context_window(matches, toks, 25).groupBy("call_id", "start").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.md5(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]), " "
            )
        ).alias("context_md5"),
    )


NAMES_SQL = "(VALUES " + ", ".join(f"({sp.lit(n)}, '{c}')" for n, c in NAMES) + ") AS g(name, label)"
SENT_NGRAMS = f"""st AS (SELECT call_id, idx, sent, {sp.toks('sent')} AS t FROM sent),
single AS (SELECT call_id, idx, sent, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM st),
gram AS (SELECT call_id, idx, sent, pos, 1 AS n, tok AS phrase FROM single
  UNION ALL SELECT a.call_id, a.idx, a.sent, a.pos, 2, a.tok || ' ' || b.tok FROM single AS a
  JOIN single AS b ON b.call_id = a.call_id AND b.idx = a.idx AND b.pos = a.pos + 1)"""


@query("gazetteer_join", "call_id:long idx:long pos:long n:long phrase:str label:str",
       f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')}, {SENT_NGRAMS} --final
SELECT call_id, idx, pos, n, phrase, label FROM gram JOIN {NAMES_SQL} ON gram.phrase = g.name""")
def _(spark, sf):
    sents = extraction.sentence_rows(tables.transcripts(spark, sf))
    return extraction.gazetteer_join(sents, names_table(spark))


@query("competitor_mentions", "call_id:long idx:long pos:long competitor:str",
       f"""WITH {sp.TRANSCRIPTS}, {sp.sent_rows('transcripts')}, {SENT_NGRAMS} --final
SELECT call_id, idx, pos, phrase AS competitor FROM gram JOIN {NAMES_SQL} ON gram.phrase = g.name
WHERE label = 'ORG' AND {sp.any_like('lower(sent)', PROBE_V31.competitor)}""")
def _(spark, sf):
    sents = extraction.sentence_rows(tables.transcripts(spark, sf))
    return extraction.competitor_mentions(sents, names_table(spark), PROBE_V31)


# set operations -------------------------------------------------------------


@query("pending_calls", "user_id:long", """--final
SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events")
    done = events.where((F.col("event_type") == "purchase") & (F.col("value") > 150))
    return relational.pending_calls(events, done, "user_id")


@query("union_phrases", "call_id:long phrase:str rank:long", f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')},
both_sources AS (SELECT call_id, 0 AS src, pos, tok AS phrase FROM tok WHERE length(tok) > 6
  UNION ALL SELECT call_id, 1, pos, tok FROM tok WHERE length(tok) <= 3),
firsts AS (SELECT call_id, phrase, min(src * 10000000 + pos) AS place FROM both_sources GROUP BY call_id, phrase),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY place, phrase) AS rank FROM firsts) --final
SELECT call_id, phrase, rank FROM ranked WHERE rank <= 20""")
def _(spark, sf):
    toks = extraction.token_rows(tables.transcripts(spark, sf)).withColumnRenamed("tok", "phrase")
    return extraction.union_phrases(
        toks.where(F.length("phrase") > 6), toks.where(F.length("phrase") <= 3), 20
    )


@query("union_pricing", "call_id:long source_rank:long pos:long mention:str",
       f"""WITH {sp.TRANSCRIPTS}, {sp.tok_rows('transcripts')}, {sp.sent_rows('transcripts')},
both_sources AS (SELECT call_id, 0 AS source_rank, pos, tok AS mention FROM tok WHERE regexp_matches(tok, '^[0-9]+$')
  UNION ALL SELECT call_id, 1, idx, sent FROM sent WHERE {sp.any_like('lower(sent)', PROBE_V31.price)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY source_rank, pos) AS r FROM both_sources) --final
SELECT call_id, source_rank, pos, mention FROM ranked WHERE r <= 10""")
def _(spark, sf):
    calls = tables.transcripts(spark, sf)
    numbers = extraction.token_rows(calls).where(F.col("tok").rlike("^[0-9]+$")).withColumnRenamed("tok", "mention")
    priced = extraction.sentence_rows(calls).where(contains_any(F.lower("sent"), PROBE_V31.price))
    return extraction.union_pricing(
        numbers, priced.select("call_id", F.col("idx").alias("pos"), F.col("sent").alias("mention")), 10
    )


@query("insert_if_absent", "user_id:long event_id:long event_type:str", """WITH
target AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100),
fresh AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id) --final
SELECT f.user_id, f.event_id, e.event_type FROM fresh AS f JOIN events AS e ON e.event_id = f.event_id
WHERE f.user_id NOT IN (SELECT user_id FROM target)""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    target = events.where((F.col("event_type") == "purchase") & (F.col("value") > 100))
    rows = events.where(F.col("event_type") != "purchase")
    return relational.insert_if_absent(target, rows, "user_id", "event_id")


@query("read_table", "o_orderkey:long c_name:str o_totalprice:d6", """--final
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(spark, sf):
    leads = tables.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return tables.read_table(spark, sf, "orders").join(leads, "o_custkey")


# quality --------------------------------------------------------------------

RULES_SQL = """list_filter([CASE WHEN NOT (score / 95 BETWEEN 0 AND 1) THEN 'confidence_range' END,
  CASE WHEN NOT (duration BETWEEN 0 AND 100) THEN 'score_range' END,
  CASE WHEN NOT (lead_class IN ('Hot', 'Warm', 'Cold')) THEN 'lead_domain' END,
  CASE WHEN NOT (CASE WHEN job_type = 'view' THEN NULL ELSE sentiment END > -0.9) THEN 'sentiment_range' END,
  CASE WHEN job_type = 'view' THEN 'sentiment_missing' END], lambda x: x IS NOT NULL)"""


@query("check_constraints", "call_id:long violations:list", f"WITH {sp.CALLS} --final\nSELECT call_id, {RULES_SQL} AS violations FROM calls")
def _(spark, sf):
    calls = tables.analysis_results(spark, sf).select(
        "call_id", (F.col("score") / 95).alias("confidence"), F.col("duration").alias("score"), "lead_class",
        F.when(F.col("job_type") != "view", F.col("sentiment")).alias("sentiment"),
    )
    return quality.check_constraints(calls, {
        "confidence_range": quality.between("confidence", 0, 1),
        "score_range": quality.between("score", 0, 100),
        "lead_domain": quality.one_of("lead_class", ("Hot", "Warm", "Cold")),
        "sentiment_range": F.col("sentiment") > -0.9,
        "sentiment_missing": quality.not_null("sentiment"),
    })


@query("violation_counts", "rule:str rows:long", f"""WITH {sp.CALLS}, v AS (SELECT unnest({RULES_SQL}) AS rule FROM calls) --final
SELECT rule, count(*) AS rows FROM v WHERE rule NOT LIKE 'sentiment%' GROUP BY rule""")
def _(spark, sf):
    calls = tables.analysis_results(spark, sf).select(
        "call_id", (F.col("score") / 95).alias("confidence"), F.col("duration").alias("score"), "lead_class"
    )
    checked = quality.check_constraints(calls, {
        "confidence_range": quality.between("confidence", 0, 1),
        "score_range": quality.between("score", 0, 100),
        "lead_domain": quality.one_of("lead_class", ("Hot", "Warm", "Cold")),
    })
    return quality.violation_rows(checked, "call_id").groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("reject_invalid", "event_id:long reason:str", r"""WITH req AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN '   ' WHEN 'view' THEN 'ab' WHEN 'signup' THEN NULL ELSE 'hello there' END AS text,
    CASE WHEN event_type = 'error' THEN '{"k": ' ELSE props END AS body, event_type FROM events) --final
SELECT event_id, CASE event_type WHEN 'click' THEN 'blank' WHEN 'view' THEN 'too_short' WHEN 'signup' THEN 'missing' ELSE 'bad_json' END AS reason
FROM req WHERE event_type <> 'purchase'""")
def _(spark, sf):
    kind = F.col("event_type")
    requests = tables.read_table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", "   ").when(kind == "view", "ab").when(kind != "signup", "hello there").alias("text"),
        F.when(kind == "error", F.lit('{"k": ')).otherwise(F.col("props")).alias("body"),
    )
    return quality.reject_invalid(requests, "text", 3, "body")[1]


@query("touch_updated_at", "c_custkey:long c_acctbal:d6 c_mktsegment:str updated_at:ts", """WITH
changed AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer) --final
SELECT c_custkey, c_acctbal, c_mktsegment, CASE WHEN c_nationkey < 5 OR c_nationkey = 7 OR c_acctbal > 9000
  THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM changed""")
def _(spark, sf):
    customers = tables.read_table(spark, sf, "customer")
    old = customers.where(
        ~((F.col("c_nationkey") >= 5) & (F.col("c_acctbal") > 9000))
    ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    new = customers.select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return relational.touch_updated_at(
        old, new, "c_custkey", ["c_acctbal", "c_mktsegment"], F.lit("2024-06-01").cast("timestamp")
    )


@query("duplicate_keys", "o_custkey:long o_orderpriority:str count:long", """--final
SELECT o_custkey, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return quality.duplicate_keys(tables.read_table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])
