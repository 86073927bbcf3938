"""The batch form of request deduplication: chains of cached answers, all at once.

A request is let through when the answer let through before it for the same text has
expired.  Every request knows the first one after its own lifetime without following the
chain, so each has a pointer; doubling the pointers finds the requests on the chain of
each text's first one in about log2(chain length) joins, however the rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens.session import stored

#: Time buckets in one lifetime.
FINE = 64


def successors(times: DataFrame, ttl: int) -> DataFrame:
    """``(key, t, next)``: for each distinct time of a key the first one at least ``ttl``
    later, null if there is none.

    The time asked for is sorted among the times of its own bucket; where the bucket holds
    none as late, the first time of the next bucket that holds any answers.  Windows run
    over a bucket of a key, and over one row per bucket.
    """
    width = max(ttl // FINE, 1)
    asked = times.select("key", F.col("t").alias("from"), (F.col("t") + ttl).alias("t"))
    both = times.withColumn("from", F.lit(None).cast("bigint")).unionByName(asked)
    both = both.withColumn("bucket", F.floor(F.col("t") / width)).withColumn("real", F.when(F.col("from").isNull(), F.col("t")))
    # at equal times the real one stands behind the question, as an answer to it
    later = W.partitionBy("key", "bucket").orderBy("t", F.col("from").isNull()).rowsBetween(1, W.unboundedFollowing)
    inside = both.withColumn("next", F.min("real").over(later)).where("from IS NOT NULL")
    buckets = both.groupBy("key", "bucket").agg(F.min("real").alias("first"))
    beyond = W.partitionBy("key").orderBy("bucket").rowsBetween(1, W.unboundedFollowing)
    buckets = buckets.select("key", "bucket", F.first("first", ignorenulls=True).over(beyond).alias("after"))
    found = inside.join(buckets, ["key", "bucket"])
    return found.select("key", F.col("from").alias("t"), F.coalesce("next", "after").alias("next"))


def chain(pointers: DataFrame, first: DataFrame) -> DataFrame:
    """``(key, t)`` of all that is reached from the rows of ``first`` by the pointers.

    Tables of pointers of 1, 2, 4, ... steps are stored until none leads anywhere; then
    the reached set takes the longest steps first, which meets every distance once.
    """
    # only what a pointer leads to, or a chain begins with, can be on a chain
    ends = pointers.where("next IS NOT NULL").select("key", F.col("next").alias("t")).union(first).distinct()
    steps = [stored(pointers.where("next IS NOT NULL").join(ends, ["key", "t"], "left_semi"), "chain-steps")]
    while not (now := steps[-1]).isEmpty():
        ahead = now.select("key", F.col("t").alias("next"), F.col("next").alias("far"))
        steps.append(stored(now.join(ahead, ["key", "next"]).select("key", "t", F.col("far").alias("next")), "chain-steps"))
    reached = first
    for step in reversed(steps[:-1]):
        onward = reached.join(step, ["key", "t"]).select("key", F.col("next").alias("t"))
        reached = stored(reached.union(onward), "chain-reached")
    return reached


def dedupe_requests_batch(
    requests: DataFrame, ttl_seconds: int = 300, text: str = "text", ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """The rows that ``dedupe_requests`` lets through, of a whole table at once: all columns
    with ``text_md5`` in place of the text.

    Of requests of one text at one instant the one with the smallest ``tie`` (without it,
    by a hash of the row) counts as the first.  Missing texts are one text; requests
    without a time are left out.  A text that holds any share of the rows is spread by
    time, and equal times are reduced to one before.
    """
    rest = [c for c in requests.columns if c != text]
    order = F.col(tie) if tie else F.xxhash64(*rest)
    rows = requests.select(
        F.struct(*rest).alias("row"), F.md5(text).alias("text_md5"), F.unix_micros(ts).alias("t"), order.alias("order")
    ).where("t IS NOT NULL").withColumn("key", F.coalesce("text_md5", F.lit("")))
    firsts = stored(
        rows.groupBy("key", "t").agg(F.min_by(F.struct("row", "text_md5"), "order").alias("first")), "requests"
    )
    times = firsts.select("key", "t")
    begin = times.groupBy("key").agg(F.min("t").alias("t"))
    through = chain(stored(successors(times, ttl_seconds * 1_000_000), "request-pointers"), begin)
    return firsts.join(through, ["key", "t"], "left_semi").select("first.row.*", "first.text_md5")
