"""Full-text search in a stored index instead of the corpus.

Each arrival of transcripts becomes a segment of the index.  Its calls are dealt by hash
into blocks of about equal size, and a row of the postings table holds what one block has
of one term: the calls with the places of the term, their number, and the most places of
any call.  The table is partitioned by hash of the term and sorted, so a query reads a few
partitions, first without the places: the numbers give the weights of the terms, and the
maxima bound the scores a block can hold.  Blocks that cannot reach the page are skipped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calllens.functions.arrays import let, positions
from calllens.functions.tokens import tokens, tokens_of

#: Calls of a block, about.
BLOCK_CALLS = 1024
#: Partitions of a segment's postings by term.
BUCKETS = 32
#: Blocks that a filter of the scan may name; more are joined.
NAMED = 1000


def term_places(text: Column) -> Column:
    """``array<struct<term, places>>`` of a text: each distinct token with its positions."""

    def by_term(pairs: Column) -> Column:
        starts = F.filter(positions(pairs), lambda i: (i == 0) | (F.get(pairs, i)["t"] != F.get(pairs, i - 1)["t"]))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(pairs, p)["t"].alias("term"),
                    F.transform(
                        F.slice(pairs, p + 1, F.coalesce(F.get(st, k + 1), F.size(pairs)) - p), lambda x: x["p"]
                    ).alias("places"),
                ),
            ),
        )

    # array_sort would run its comparison as a lambda for every two elements
    pairs = F.sort_array(F.transform(tokens(text), lambda t, i: F.struct(t.alias("t"), i.alias("p"))))
    return let(pairs, by_term)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def add_segment(
    calls: DataFrame, folder: str, segment: int, key: str = "call_id", text: str = "text",
    block_calls: int = BLOCK_CALLS, buckets: int = BUCKETS,
) -> None:
    """Index an arrival of calls under the number ``segment``; doing so again replaces it.

    Calls that an earlier segment holds, and repeated rows of one call, are indexed once.
    A call without a text counts as a call without terms, and one without a key is counted but
    not found.  Every segment of an index has the same number of ``buckets``.

    Texts are shuffled once and their postings are not; a task writes what its blocks have of
    each bucket.
    """
    spark = calls.sparkSession
    rows = calls.select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    known = _docs(spark, folder, rows.schema["key"].dataType.simpleString())
    if known is not None:
        rows = rows.join(known.where(F.col("segment") < segment).select("key"), "key", "left_anti")
    rows.select("key").write.mode("overwrite").parquet(f"{folder}/docs/segment={segment}")
    indexed = spark.read.parquet(f"{folder}/docs/segment={segment}")
    blocks = max(1, -(-indexed.count() // block_calls))
    # one shuffle of the texts by block, in which repeated and known calls meet; all else stays in its task
    held = calls.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(False).alias("old"))
    if known is not None:
        before = known.where(F.col("segment") < segment).select("key", F.lit(None).cast("string").alias("text"), F.lit(True).alias("old"))
        held = held.unionByName(before)
    held = held.where("key IS NOT NULL")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition("block")
    once = dealt.groupBy("block", "key").agg(F.first("text").alias("text"), F.max("old").alias("old")).where("NOT old")
    each = once.select("block", "key", F.inline(term_places(F.col("text"))))
    # a block bounds every list, however many calls hold the term
    postings = each.groupBy("block", "term").agg(
        F.sort_array(F.collect_list(F.struct("key", "places"))).alias("calls"),
        F.count(F.lit(1)).alias("df"), F.max(F.size("places")).alias("most"),
    )
    placed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    placed.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").option("compression", "zstd").partitionBy(
        "bucket"
    ).parquet(f"{folder}/postings/segment={segment}")


def index_stream(calls: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Index the calls of a stream, one segment per micro-batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        add_segment(batch, folder, batch_id, **options)

    return calls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _docs(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"key {kind}, segment bigint").parquet(f"{folder}/docs")
    except AnalysisException:  # nothing indexed yet
        return None


def _terms(query: str, stop_words) -> list[str]:
    terms = [t for t in tokens_of(query) if t not in stop_words]
    if not terms:
        raise ValueError("the query has no searchable term")
    return terms


def _postings(spark: SparkSession, folder: str, terms: list[str], buckets: int) -> DataFrame:
    """The rows of some terms; only their partitions are read."""
    numbers = spark.range(1).select(*[bucket_of(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(terms)]).first()
    table = spark.read.parquet(f"{folder}/postings")
    return table.where(F.col("bucket").isin(*set(numbers))).where(F.col("term").isin(*terms))


def _in_blocks(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """The postings of some blocks: named in the scan's filter while they are few."""
    few = chosen.select("segment", "block").limit(NAMED + 1).collect()
    if len(few) > NAMED:
        return postings.join(chosen.select("segment", "block"), ["segment", "block"], "left_semi")
    named = {(r.segment, r.block) for r in few}
    both = F.struct(F.col("segment").cast("bigint"), F.col("block"))
    return postings.where(
        F.col("segment").isin(*{s for s, _ in named}) & F.col("block").isin(*{b for _, b in named})
    ).where(both.isin(*[F.struct(F.lit(s).cast("bigint"), F.lit(b)) for s, b in named]) if named else F.lit(False))


def _scores(postings: DataFrame, weights: DataFrame, n_terms: int) -> DataFrame:
    """``(key, score)`` of the calls that hold every term."""
    each = postings.join(F.broadcast(weights), "term")  # a row per query term
    rows = each.select("segment", "block", "term", "idf", F.inline("calls"))
    summed = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("found"), F.sum(F.size("places") * F.col("idf")).alias("score")
    )
    return summed.where(F.col("found") == n_terms).select("key", "score")


def search(
    spark: SparkSession, folder: str, query: str, k: int, stop_words, key: str = "call_id", first_blocks: int = 64,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The ``k`` calls ``(key, score)`` that ``topics.fulltext_search`` finds, read from the
    index.

    The blocks with the highest bounds, ``first_blocks`` of them, are scored first.  Their
    ``k``-th score is one that the page reaches in any case, so of the others only blocks
    whose bound is as high are read.  Raises ``ValueError`` for a query without terms.
    """
    terms = list(dict.fromkeys(_terms(query, stop_words)))
    docs = spark.read.parquet(f"{folder}/docs")
    postings = _postings(spark, folder, terms, buckets)
    n_docs = docs.count()
    weights = postings.groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", (F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    bounds = (
        postings.select("segment", "block", "term", "most").join(F.broadcast(weights), "term").groupBy("segment", "block")
        .agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("most") * F.col("idf")).alias("bound"))
        .where(F.col("found") == len(terms))
    )
    first = bounds.orderBy(F.col("bound").desc(), "segment", "block").limit(first_blocks)
    scored = _scores(_in_blocks(postings, first), weights, len(terms))
    page = scored.select(F.round("score", 9).alias("s")).orderBy(F.col("s").desc()).limit(k).collect()
    reach = page[-1].s if len(page) == k else float("-inf")
    # a rounding error of the bound may only admit more
    chosen = bounds.where(F.col("bound") + 1e-6 >= reach)
    found = _scores(_in_blocks(postings, chosen), weights, len(terms))
    return found.orderBy(F.round("score", 9).desc(), "key").limit(k).withColumnRenamed("key", key)


def phrase_search(spark: SparkSession, folder: str, phrase: str, key: str = "call_id", buckets: int = BUCKETS) -> DataFrame:
    """``(key, places)`` of every call in which the tokens of the phrase stand in a row,
    with where they begin.

    Within a block the lists of the terms meet call by call; the places of the n-th token
    are moved back by n and intersected.
    """
    terms = _terms(phrase, ())
    distinct = list(dict.fromkeys(terms))
    rows = _postings(spark, folder, distinct, buckets)
    whole = rows.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(distinct))
    each = _in_blocks(rows, whole).select("term", F.inline("calls"))
    by_call = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held"))
    by_call = by_call.where(F.size("held") == len(distinct))

    def moved(n: int) -> Column:
        return F.transform(F.element_at("held", F.lit(terms[n])), lambda p: p - n)

    begin = moved(0)
    for n in range(1, len(terms)):
        begin = F.array_intersect(begin, moved(n))
    return by_call.select(F.col("key").alias(key), F.array_sort(begin).alias("places")).where(F.size("places") > 0)
