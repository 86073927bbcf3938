"""Streaming operators; windows, sessions and job states in their batch form too."""

from __future__ import annotations

from pyspark.sql import functions as F

from calllens import schemas
from calllens.session import scratch_dir
from calllens.sources import tables
from calllens.streaming import chains, ingest, jobs, late, running, state
from calllens.streaming import events as ev
from catalog import sqlparts as sp
from catalog.filters import score_sql
from catalog.projections import clean_sql
from catalog.registry import query
from catalog.views import PROBE_V31


@query("metrics_tumbling", "window_start:ts component:str samples:long mean_value:d6 min_value:d6 max_value:d6",
       f"""WITH {sp.METRICS} --final
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, component, count(*) AS samples, avg(value) AS mean_value,
  min(value) AS min_value, max(value) AS max_value FROM metrics GROUP BY ALL""")
def _(spark, sf):
    return ev.metrics_tumbling(tables.metrics(spark, sf), "15 minutes")


@query("rate_limit_breaches", "window_start:ts user_id:long requests:long", """WITH spread AS (
  SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest(range(0, 12))) AS window_start, ts FROM events) --final
SELECT window_start, user_id, count(*) AS requests FROM spread WHERE ts < window_start + INTERVAL 12 HOUR GROUP BY window_start, user_id HAVING count(*) > 4""")
def _(spark, sf):
    return ev.rate_limit_breaches(tables.read_table(spark, sf, "events"), 4, "12 hours", "1 hour")


@query("user_sessions", "user_id:long session_start:ts last_accessed_at:ts expires_at:ts events:long", """WITH
flagged AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM flagged) --final
SELECT user_id, min(ts) AS session_start, max(ts) AS last_accessed_at, max(ts) + INTERVAL 4 HOUR AS expires_at, count(*) AS events FROM numbered GROUP BY user_id, s""")
def _(spark, sf):
    return ev.user_sessions(tables.read_table(spark, sf, "events"), 4 * 3600)


STATUS_SQL = """CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'reprocessing' END"""


def changes(frame):
    """Events as state changes of one job per user."""
    status = (
        F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .otherwise("reprocessing")
    )
    return frame.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("change_id"), "ts", status.alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("progress"),
    )


@query("job_states", "job_id:long status:str progress:long changed_at:ts changes:long", f"""WITH
placed AS (SELECT user_id AS job_id, {STATUS_SQL} AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS progress, ts AS changed_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS changes FROM events) --final
SELECT * FROM placed WHERE r = 1""")
def _(spark, sf):
    return ev.job_states(changes(tables.read_table(spark, sf, "events")))


def table_stream(spark, sf, name, schema):
    """The files of one table as a stream; the table is one file or a folder of them."""
    # a pattern matches both, a plain path to a file is refused as a base folder
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.[p]arquet")


def event_stream(spark, sf):
    return table_stream(spark, sf, "events", schemas.EVENTS)


def finish(running):
    running.awaitTermination()
    error = running.exception()
    if error is not None:
        raise error


def in_parts(spark, sf, parts):
    """The events as a stream of files, one file a batch, in the order of ``parts``: filters."""
    root = scratch_dir(spark, "event-parts")
    events = tables.read_table(spark, sf, "events")
    for part in parts:
        events.where(part).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(root)


# four batches, in which jobs change again and again; times are cut to minutes so that some tie
@query("job_states_table", "job_id:long status:str progress:long changed_at:ts changes:long", f"""WITH
placed AS (SELECT user_id AS job_id, {STATUS_SQL} AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS progress, date_trunc('day', ts) AS changed_at,
  row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS changes FROM events) --final
SELECT * FROM placed WHERE r = 1""")
def _(spark, sf):
    out = scratch_dir(spark, "job-states")
    rows = changes(in_parts(spark, sf, [f"event_id % 4 = {i}" for i in (2, 0, 3, 1)])).withColumn("ts", F.date_trunc("day", "ts"))
    finish(state.keep_latest(rows, out, f"{out}-state", "job_id", ["ts", "change_id"], buckets=8))
    kept = state.read_latest(spark, out, "job_id", "job_id bigint, change_id bigint, ts timestamp, status string, progress int")
    return kept.withColumnRenamed("ts", "changed_at")


# a batch without every seventh event, then those: most of them come too late
LATE_SQL = """WITH first_batch AS (SELECT max(ts) AS newest FROM events WHERE event_id % 7 > 0),
told AS (SELECT e.*, event_id % 7 = 0 AS second, event_id % 7 = 0 AND {until} <= newest - INTERVAL 10 MINUTE AS late FROM events AS e, first_batch) --final
"""


@query("late_rows", "event_id:long user_id:long late:bool", LATE_SQL.format(until="ts") + "SELECT event_id, user_id, late FROM told")
def _(spark, sf):
    out = scratch_dir(spark, "admitted")
    finish(late.admit(in_parts(spark, sf, ["event_id % 7 > 0", "event_id % 7 = 0"]), out, f"{out}-state"))
    admitted, dropped = (spark.read.parquet(f"{out}/{folder}").withColumn("late", F.lit(x)) for folder, x in (("admitted", False), ("late", True)))
    return admitted.unionByName(dropped)


@query("late_counts", "batch:long rows:long late:long", LATE_SQL.format(until="time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 12 HOUR")
       + "SELECT CAST(second AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (WHERE late) AS late FROM told GROUP BY second")
def _(spark, sf):
    out = scratch_dir(spark, "admitted")
    parts = in_parts(spark, sf, ["event_id % 7 > 0", "event_id % 7 = 0"])
    finish(late.admit(parts, out, f"{out}-state", expires=late.window_end("ts", "12 hours", "1 hour")))
    return late.late_counts(spark, out)


@query("metrics_admitted", "window_start:ts component:str samples:long mean_value:d6 min_value:d6 max_value:d6",
       LATE_SQL.format(until="time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR") + """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS component,
  count(*) AS samples, avg(value) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM told WHERE NOT late GROUP BY ALL""")
def _(spark, sf):
    out = scratch_dir(spark, "admitted")
    parts = in_parts(spark, sf, ["event_id % 7 > 0", "event_id % 7 = 0"])
    finish(late.admit(parts, out, f"{out}-state", expires=late.window_end("ts", "1 hour")))
    admitted = spark.readStream.schema(schemas.EVENTS).parquet(f"{out}/admitted")
    windows = ev.metrics_tumbling(admitted.withColumnRenamed("event_type", "component"), "1 hour")
    finish(ingest.snapshots_to(windows, f"{out}-windows", f"{out}-windows-state"))
    held = spark.read.parquet(f"{out}-windows")
    return held.where(F.col("batch") == held.agg(F.max("batch")).first()[0])


@query("stuck_jobs", "job_id:long status:str changed_at:ts", f"""WITH
placed AS (SELECT user_id AS job_id, {STATUS_SQL} AS status, ts AS changed_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) --final
SELECT job_id, status, changed_at FROM placed WHERE r = 1 AND status IN ('pending', 'processing', 'reprocessing')
  AND changed_at + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    out = scratch_dir(spark, "stuck")
    stream = jobs.stuck_jobs(changes(event_stream(spark, sf)), 3600, tie="change_id")
    finish(ingest.append_to(stream, out, f"{out}-state"))
    return spark.read.schema(jobs.OUT).parquet(out)


@query("ingest_stream", "file_name:str chars:long text_md5:str", """--final
SELECT 'call-' || CAST(item_id AS VARCHAR) || '.txt' AS file_name, length(text) AS chars, md5(text) AS text_md5 FROM benchmark""")
def _(spark, sf):
    base = scratch_dir(spark, "arrivals")
    # one text file per transcript, as an upload would leave them
    items = tables.read_table(spark, sf, "benchmark").select(
        F.concat(F.lit("call-"), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("value")
    )
    items.write.partitionBy("name").option("lineSep", "\u0001").text(f"{base}/in")
    arrivals = ingest.ingest_transcripts(spark, f"{base}/in", PROBE_V31)
    finish(ingest.append_to(arrivals, f"{base}/out", f"{base}/state"))
    read = spark.read.parquet(f"{base}/out")
    body = F.regexp_replace("text", "\u0001$", "")
    return read.select(
        F.concat(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".txt")).alias("file_name"),
        F.length(body).alias("chars"), F.md5(body).alias("text_md5"),
    )


@query("analyze_stream", "call_id:long word_count:long lead_score:d6",
       f"""WITH {sp.TRANSCRIPTS}, tidy AS (SELECT call_id, {clean_sql('text', PROBE_V31)} AS text FROM transcripts) --final
SELECT call_id, len({sp.words('text')}) AS word_count, {score_sql(PROBE_V31, 'lower(text)', f"len({sp.words('text')})")} AS lead_score FROM tidy""")
def _(spark, sf):
    out = scratch_dir(spark, "analysis")
    docs = table_stream(spark, sf, "documents", "doc_id bigint, text string, source string")
    arrivals = docs.select(F.col("doc_id").alias("call_id"), F.col("source").alias("path"), "text")
    finish(ingest.append_to(ingest.analyze_stream(arrivals, PROBE_V31), out, f"{out}-state"))
    return spark.read.parquet(out).select("call_id", "word_count", F.col("lead.score").alias("lead_score"))


@query("dedupe_requests", "event_type:str first_ts:ts requests:long", """WITH RECURSIVE r AS (SELECT event_type, event_type || CAST(user_id AS VARCHAR) AS text, ts FROM events),
let_in AS (SELECT event_type, text, min(ts) AS ts FROM r GROUP BY event_type, text
  UNION ALL SELECT k.event_type, k.text, min(r.ts) FROM let_in AS k JOIN r ON r.text = k.text AND r.ts >= k.ts + INTERVAL 300 SECOND GROUP BY k.event_type, k.text, k.ts) --final
SELECT event_type, min(ts) AS first_ts, count(*) AS requests FROM let_in GROUP BY event_type""")
def _(spark, sf):
    out = scratch_dir(spark, "requests")
    requests = event_stream(spark, sf).select("event_type", "ts", F.concat("event_type", F.col("user_id").cast("string")).alias("text"))
    finish(ingest.append_to(ev.dedupe_requests(requests), out, f"{out}-state"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("requests"))


# one text per event type: a few texts hold all rows
@query("dedupe_requests_batch", "event_type:str event_id:long ts:ts", """WITH RECURSIVE r AS (SELECT event_type, event_id, ts FROM events),
let_in AS (SELECT event_type, min(ts) AS ts FROM r GROUP BY event_type
  UNION ALL SELECT k.event_type, min(r.ts) FROM let_in AS k JOIN r ON r.event_type = k.event_type AND r.ts >= k.ts + INTERVAL 3600 SECOND GROUP BY k.event_type, k.ts) --final
SELECT event_type, min(r.event_id) AS event_id, ts FROM let_in JOIN r USING (event_type, ts) GROUP BY event_type, ts""")
def _(spark, sf):
    requests = tables.read_table(spark, sf, "events").withColumn("text", F.concat(F.lit("call of "), "event_type"))
    return chains.dedupe_requests_batch(requests, 3600, tie="event_id").select("event_type", "event_id", "ts")


# a row after each job, in three batches cut by time
@query("running_performance_live", "call_id:long component:str files_processed:long average_duration:d6 success_rate:d6", """--final
SELECT event_id AS call_id, event_type AS component, count(*) OVER w AS files_processed, avg(CASE WHEN user_id % 5 > 0 THEN value END) OVER w AS average_duration,
  avg(CASE WHEN user_id % 5 > 0 THEN 1.0 ELSE 0.0 END) OVER w AS success_rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def _(spark, sf):
    out = scratch_dir(spark, "performance")
    lo, hi = tables.read_table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    a, b = (f"timestamp'{lo + (hi - lo) * x}'" for x in (0.2, 0.7))
    done = in_parts(spark, sf, [f"ts < {a}", f"ts >= {a} AND ts < {b}", f"ts >= {b}"]).select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("component"), F.col("value").alias("duration"), "ts",
        F.when(F.col("user_id") % 5 > 0, "completed").otherwise("failed").alias("status"),
    )
    finish(running.live_performance(done, out, f"{out}-state", "component", ["ts", "call_id"], F.date_trunc("hour", "ts")))
    return running.read_live(spark, out)


@query("running_performance_stream", "component:str files_processed:long average_duration:d6 success_rate:d6", """--final
SELECT event_type AS component, count(*) AS files_processed, avg(value) FILTER (WHERE event_type <> 'error') AS average_duration,
  avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate FROM events GROUP BY event_type""")
def _(spark, sf):
    out = scratch_dir(spark, "performance")
    done = event_stream(spark, sf).select(
        F.col("event_type").alias("component"), F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
    )
    finish(ingest.snapshots_to(ev.running_performance_stream(done), out, f"{out}-state"))
    stored = spark.read.parquet(out)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == last)
