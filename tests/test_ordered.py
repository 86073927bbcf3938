"""Skew-proof ordered operators against plain windows, on data with one hot key."""

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens import V31
from calllens.operators import conversation, dashboard, extraction, ml, ordered, relational, topics
from calllens.streaming import events as ev


@pytest.fixture(scope="module")
def rows(spark):
    """Key 0 holds a third of 6,000 rows, with ties in time and value."""
    n = F.col("id")
    df = spark.range(6000).select(
        n.alias("event_id"),
        F.when(n % 3 == 0, 0).otherwise(1 + n % 41).cast("bigint").alias("user_id"),
        F.timestamp_seconds(1_700_000_000 + (F.hash("id") % 20_000_000).cast("bigint") / 100).alias("ts"),
        (F.abs(F.hash(n + 7)) % 500 / 5).alias("value"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.abs(F.hash(n + 3)) % 3 + 1).cast("int")).alias("kind"),
    )
    return df.persist()


def same(got, want, keys):
    a = got.toPandas().sort_values(keys).reset_index(drop=True)
    b = want.select(*got.columns).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_running_totals(rows):
    order = [F.col("ts"), F.col("event_id")]
    got = ordered.running_totals(rows, ["user_id"], order, F.date_trunc("hour", "ts"), {"total": F.col("value")})
    w = W.partitionBy("user_id")
    want = rows.withColumns({
        "total": F.sum("value").over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)),
        "total_all": F.sum("value").over(w),
    })
    same(got.select("event_id", "total", "total_all"), want, ["event_id"])


def test_a_hot_key_is_spread_over_tasks(spark):
    """A third of the rows share a key; no window task may hold most of them."""
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        totals = ordered.running_totals(df, ["k"], [F.col("at")], F.floor(F.col("at") / 100), {"n": F.lit(1)})
        # the running total is used, so the window stays in the plan
        held = totals.where("n > 0").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [r["count"] for r in held.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 90_000 and max(sizes) < 2 * 90_000 / 8


def test_null_keys_and_values_are_kept(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0), (2, "a", None), (3, None, 2.0), (4, None, 2.0), (5, "a", 7.0)], "id int, k string, v double"
    )
    got = {r.id: (r.rank, r.group_size) for r in ordered.rank_by_value(df, "k", "v").collect()}
    assert got == {5: (1, 3), 1: (2, 3), 2: (3, 3), 3: (1, 2), 4: (1, 2)}
    totals = ordered.running_totals(df, ["k"], [F.col("id")], F.floor(F.col("id") / 2), {"n": F.lit(1)})
    assert {r.id: (r.n, r.n_all) for r in totals.collect()} == {1: (1, 3), 2: (2, 3), 5: (3, 3), 3: (1, 2), 4: (2, 2)}


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_count_changes(rows, width):
    got = ordered.count_changes(rows, ["user_id"], "event_id", "kind", F.floor(F.col("event_id") / width), "changes")
    prev = F.lag("kind").over(W.partitionBy("user_id").orderBy("event_id"))
    want = rows.withColumn("p", prev).groupBy("user_id").agg(F.count_if(F.col("p") != F.col("kind")).alias("changes"))
    same(got, want, ["user_id"])


def test_rank_by_value(rows):
    got = ordered.rank_by_value(rows, "kind", "value").select("event_id", "rank", "group_size")
    w = W.partitionBy("kind")
    want = rows.withColumns({"rank": F.rank().over(w.orderBy(F.col("value").desc())), "group_size": F.count("*").over(w)})
    same(got, want, ["event_id"])


def test_rank_leads_quartiles(rows):
    got = dashboard.rank_leads(rows, "event_id", "kind", "value")
    w = W.partitionBy("kind").orderBy(F.col("value").desc())
    tied = W.partitionBy("kind").orderBy(F.col("value").desc(), "event_id")
    want = rows.withColumns({"percent_rank": F.percent_rank().over(w), "quartile": F.ntile(4).over(tied).cast("bigint")})
    same(got.select("event_id", "percent_rank", "quartile"), want, ["event_id"])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 9])
def test_quartiles_of_small_classes(spark, n):
    df = spark.createDataFrame([(i, "x", float(i // 2)) for i in range(n)], "call_id bigint, lead_class string, score double")
    w = W.partitionBy("lead_class").orderBy(F.col("score").desc(), "call_id")
    want = {r.call_id: r.q for r in df.withColumn("q", F.ntile(4).over(w)).collect()}
    assert {r.call_id: r.quartile for r in dashboard.rank_leads(df).collect()} == want


def test_percentiles(rows):
    got = {r.kind: (r.p50, r.p90) for r in ordered.percentiles(rows, "kind", "value", [0.5, 0.9]).collect()}
    pdf = rows.toPandas()
    for kind, part in pdf.groupby("kind"):
        values = part["value"].sort_values().to_numpy()
        for p, v in zip((0.5, 0.9), got[kind]):
            assert v == values[int(-(-len(values) * p // 1)) - 1]


def test_sessions(rows):
    got = ev.user_sessions(rows, 600)
    w = W.partitionBy("user_id").orderBy("ts")
    t = F.unix_micros("ts")
    fresh = F.coalesce((t - F.lag(t).over(w) > 600_000_000).cast("int"), F.lit(1))
    want = (
        rows.withColumn("f", fresh)
        .withColumn("s", F.sum("f").over(w.rangeBetween(W.unboundedPreceding, 0)))
        .groupBy("user_id", "s")
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_accessed_at"), F.count("*").alias("events"))
    )
    same(got.select("user_id", "session_start", "last_accessed_at", "events"), want, ["user_id", "session_start"])


def test_batch_sessions_agree_with_session_window(rows):
    got = ev.user_sessions(rows, 600).select("user_id", "session_start", "events")
    same(got, ev.user_sessions_stream(rows, 600), ["user_id", "session_start"])


def test_response_time(rows):
    t = F.unix_micros("ts")
    gap = t - F.lag(t).over(W.partitionBy("user_id").orderBy("ts"))
    want = rows.withColumn("g", gap).groupBy("user_id").agg((F.avg("g") / 1e6).alias("response_time_avg"))
    same(conversation.response_time_avg(rows, "user_id").select("user_id", "response_time_avg"), want, ["user_id"])


def test_stratified_split_is_exact(rows):
    split = ml.stratified_split(rows, "kind", "event_id")
    for r in split.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect():
        assert r.k == -(-r.n // 5)
    assert split.count() == rows.count()
    again = ml.stratified_split(rows.repartition(5), "kind", "event_id")
    assert split.exceptAll(again.select(*split.columns)).isEmpty()
    folds = ml.fold_column(rows, "kind", "event_id", 5)
    sizes = [r["count"] for r in folds.groupBy("kind", "fold").count().collect()]
    assert max(sizes) - min(sizes) < 40 and len(sizes) == 15


def test_context_window(spark):
    toks = spark.range(3000).select((F.col("id") % 2).alias("call_id"), F.floor(F.col("id") / 2).alias("pos"), F.col("id").cast("string").alias("tok"))
    hits = toks.where("pos % 97 = 0").select("call_id", F.col("pos").alias("start"), F.lit(2).alias("n"))
    got = extraction.context_window(hits, toks, 25)
    want = hits.join(toks, "call_id").where("pos between start - 25 and start + n + 24")
    same(got, want, ["call_id", "start", "pos"])


def test_nested_chunks_hold_everything(spark):
    kids = spark.range(2500).select(F.lit(1).alias("call_id"), F.col("id").alias("pos"), F.col("id").alias("v"))
    calls = spark.createDataFrame([(1,), (2,)], "call_id int")
    lists = relational.nest_children(kids, "call_id", "pos", ["v"], "kids", 1000)
    got = {(r.call_id, r.chunk): r.kids for r in relational.call_nested(calls, [lists]).collect()}
    assert {k: len(v or []) for k, v in got.items()} == {(1, 0): 1000, (1, 1): 1000, (1, 2): 500, (2, 0): 0}
    assert [k.v for k in got[(1, 2)]] == list(range(2000, 2500))


def test_top_k_limits_before_the_shuffle(rows):
    from plan_text import plan_of

    top = topics.top_k_per_call(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)
    assert plan_of(top).count("WindowGroupLimit") == 2
    assert top.count() == 3 * rows.select("user_id").distinct().count()


def test_moving_sentiment(spark):
    turns = spark.createDataFrame(
        [(1, 1, "great"), (1, 2, "expensive"), (1, 3, "plain"), (1, 6, "great")], "call_id int, turn int, text string"
    )
    got = {r.turn: (r.sentiment, r.moving_sentiment) for r in conversation.sentiment_progression(turns, V31).collect()}
    # the mean runs over turns, whatever their numbers
    assert got == {1: (1.0, 1.0), 2: (-1.0, 0.0), 3: (0.0, 0.0), 6: (1.0, 0.0)}
    assert set(got) == {1, 2, 3, 6}


def test_speaker_shares_sum_to_hundred(spark):
    turns = spark.createDataFrame(
        [(1, 0, "a", "one two three"), (1, 1, "b", "four. too much!"), (1, 2, "a", ""), (2, 0, "c", "x")],
        "call_id int, turn int, speaker string, text string",
    )
    got = conversation.speaker_profile(turns, V31)
    for r in got.groupBy("call_id").agg(F.sum("share_pct").alias("s")).collect():
        assert r.s == pytest.approx(100.0)
    b = got.where("speaker = 'b'").first()
    assert b.concerns == ["too much"] and b.turn_count == 1
