"""Mixing sources to target weights, with DataFrame functions alone.

A source's documents are dealt by hash into blocks of about equal size, or stand alone
if they are few.  Its target
fixes how often each block is taken; each time is a slot.  A splitting tree halves the
list of output shards again and again: at each node the slots of all sources are drawn
for the left half without replacement, so the counts follow the multivariate
hypergeometric law and their sums stay exact.  A shard then takes the next slots of each
source in permuted order, which makes the draws disjoint, and shuffles them locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Blocks of a source at least, if it has as many documents.
FEWEST = 64
#: Pieces of all shards, beyond which they grow in size.
MOST_TASKS = 1 << 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(*parts) -> Column:
    """A number from 0 up to 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``(id, source, size, draw)`` of each row; ``draw`` orders the rows of a source."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), id_col, F.coalesce(text_col, F.lit(""))).alias("draw"),
    )


def source_targets(rows: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``(number, source, source_size, n_docs, target)`` per source, numbered from 0 by
    code point with null last; ``n_docs`` counts its rows that have words.

    The sources weigh ``weights`` in turn and share the size of all rows.  A target
    stops at ``cap`` times its source's size and what is over is shared by weight again.
    With the sources sorted by capped size per weight, the level of the others is the
    largest that any number of capped sources leaves.
    """
    own = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs")
    )
    # windows over one row per source
    order = W.orderBy(F.col("source").isNull(), "source")
    own = own.withColumn("number", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("number"), F.lit(len(weights))).cast("int") + 1)
    own = own.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_need = W.orderBy(F.col("most") / F.col("weight"), "number")
    before, after = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least("most", F.col("level") * F.col("weight")).cast("double").alias("target")
    return own.select("number", "source", "source_size", "n_docs", target)


def with_blocks(rows: DataFrame, targets: DataFrame, blocks: int) -> DataFrame:
    """Each row with its source's figures and its block.

    All sources together share about ``blocks`` blocks by size, so a source with a third
    of all rows has a third of them.  However many sources there are, each has ``FEWEST``
    at least, and one of no more documents than that has a block for each of them.
    """
    share = F.ceil(F.col("source_size") * blocks / F.greatest("all_size", F.lit(1)))
    # so many numbers that no two of a few documents meet under one
    fewest = F.when(F.col("n_docs") <= FEWEST, F.lit(1 << 40)).otherwise(F.lit(FEWEST)).cast("bigint")
    everything = W.partitionBy()
    dealt = targets.withColumn("all_size", F.sum("source_size").over(everything)).select(
        "number", "source", "source_size", "target",
        F.greatest(fewest, share).alias("n_blocks"),
    )
    return (
        rows.join(dealt, rows["source"].eqNullSafe(dealt["source"]))
        .drop(dealt["source"])
        .withColumn("block", F.pmod("draw", "n_blocks"))
    )


def block_copies(placed: DataFrame, cap: float, seed: int) -> DataFrame:
    """``(number, block, words, copies)``: how often the mix takes each block.

    Every block is taken as often as the target holds the whole source.  The rest is
    filled in permuted order up to the first block that is too large; three times then
    the one block is added or left out that brings the source nearest to its target.
    """
    own = W.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "number", "block"), "block")
    blocks = (
        placed.groupBy("number", "block")
        .agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        .where("words > 0")
        .withColumn("upto", F.sum("words").over(own.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("base", F.floor(F.col("target") / F.col("source_size") + 1e-9))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("extra", ((F.col("upto") <= F.col("rest") + 1e-6) & (F.col("base") + 1 <= cap)).cast("int"))
    )
    whole = W.partitionBy("number")
    for _ in range(3):
        blocks = blocks.withColumn("open", F.col("rest") - F.sum(F.col("extra") * F.col("words")).over(whole))
        # what the source gains by taking the block once more, or once less
        change = F.col("words") * (1 - 2 * F.col("extra"))
        after = F.abs(F.col("open") - change)
        gain = F.when((F.col("base") + 1 <= cap) & (after < F.abs("open")), F.struct(-after, -F.col("block")))
        blocks = blocks.withColumn("gain", gain).withColumn("best", F.max("gain").over(whole))
        blocks = blocks.withColumn("extra", F.when(F.col("gain") == F.col("best"), 1 - F.col("extra")).otherwise(F.col("extra")))
    return blocks.select("number", "block", "words", (F.col("base") + F.col("extra")).cast("int").alias("copies"))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are marked ones, by inversion of the distribution.

    The weights run over 12 standard deviations around the mean; what lies beyond has
    less than 1e-30 of the mass.
    """
    n, k, m = population.cast("double"), marked.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), m + k - n), F.least(m, k)
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    spread = 12 * F.sqrt(F.greatest(F.lit(0.0), F.when(n > 1, mean * (n - k) * (n - m) / (n * (n - 1))).otherwise(0.0))) + 2
    values = F.sequence(F.greatest(low, F.floor(mean - spread)).cast("bigint"), F.least(high, F.ceil(mean + spread)).cast("bigint"))

    def step(x: Column) -> Column:
        """Logarithm of the weight of x + 1 over that of x."""
        x = x.cast("double")
        over, under = (k - x) * (m - x), (x + 1) * (n - k - m + x + 1)
        return F.when((over > 0) & (under > 0), F.log(over) - F.log(under)).otherwise(0.0)

    zero = F.lit(0.0)
    total = F.aggregate(
        values,
        F.struct(zero.alias("log"), zero.alias("sum")),
        lambda acc, x: F.struct((acc["log"] + step(x)).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.aggregate(
        values,
        F.struct(zero.alias("log"), (u * total).alias("left"), F.lit(-1).cast("bigint").alias("pick")),
        lambda acc, x: F.struct(
            (acc["log"] + step(x)).alias("log"),
            (acc["left"] - F.exp(acc["log"])).alias("left"),
            F.when((acc["pick"] < 0) & (acc["left"] <= F.exp(acc["log"])), x).otherwise(acc["pick"]).alias("pick"),
        ),
        # rounding may leave a trace of the mass behind the last value
        lambda acc: F.when(acc["pick"] < 0, F.element_at(values, -1)).otherwise(acc["pick"]),
    )


def split_tree(slots: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(number, upto)``: per source the running count of slots after each of the
    ``2 ** depth`` shards.

    ``slots`` has ``(number, n)``.  One row per tree node carries the quotas of all
    sources; a child's quotas are drawn source by source from what is left.
    """
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("number", "n"))), lambda s: s["n"])
    names = F.array_sort(F.collect_list("number"))
    nodes = slots.agg(names.alias("names"), quotas.alias("quotas")).withColumn("node", F.lit(1).cast("bigint"))
    for _ in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
        odd = F.when(uniform(F.lit(seed), F.lit("odd"), "node") < 0.5, total % 2).otherwise(F.lit(0))
        half = (F.floor(total / 2) + odd).cast("bigint")
        start = F.struct(total.alias("pool"), half.alias("need"), F.array().cast("array<bigint>").alias("left"))

        def draw(acc: Column, q: Column) -> Column:
            u = uniform(F.lit(seed), F.lit("draw"), F.col("node"), F.size(acc["left"]))
            got = hypergeometric(acc["pool"], q, acc["need"], u)
            return F.struct(
                (acc["pool"] - q).alias("pool"), (acc["need"] - got).alias("need"), F.concat(acc["left"], F.array(got)).alias("left")
            )

        nodes = nodes.withColumn("left", F.aggregate("quotas", start, draw, lambda acc: acc["left"]))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        nodes = nodes.select(
            "names",
            F.inline(F.array(
                F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
                F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quotas")),
            )),
        )
    per_source = nodes.select("node", F.inline(F.arrays_zip(F.col("names").alias("number"), F.col("quotas").alias("n"))))
    counts = F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda s: s["n"])
    running = F.aggregate(
        "counts", F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))
    )
    return per_source.groupBy("number").agg(counts.alias("counts")).select("number", running.alias("upto"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    cap: float = 3.0,
    blocks: int = 8192,
    depth: int = 4,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The mix of all rows: its rows' figures, and its slots.

    Figures: ``(id, source, size, number, source_size, target, n_blocks, block, taken,
    shards)`` of every row, taken or not; ``shards`` has the shard of each of its copies,
    and ``taken`` counts those.  Slots: ``(number, block, copy, shard)``, one for each time
    a block is taken, dealt to ``2 ** depth`` shards.

    A null text has size 0 and is never taken, nor is any other text without words.  Null
    is a source of its own.  No row is taken more often than ``cap`` rounded down says.
    Every choice follows from hashes of id, text and ``seed``: reruns agree, and rows
    repeated in the table share their block.
    """
    rows = written(sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    placed = with_blocks(rows, source_targets(rows, weights, cap), blocks)
    plan = written(block_copies(placed, cap, seed), "mix-plan")
    slots = plan.where("copies > 0").select("number", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    upto = split_tree(slots.groupBy("number").agg(F.count("*").alias("n")), depth, seed)
    permuted = W.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), "number", "block", "copy"), "block", "copy")
    dealt = (
        slots.withColumn("place", F.row_number().over(permuted) - 1)
        .join(upto, "number")
        .select("number", "block", "copy", F.size(F.filter("upto", lambda c: c <= F.col("place"))).alias("shard"))
    )
    dealt = written(dealt, "mix-dealt")
    # what a row is taken follows from the slots dealt to its block, at most ``cap`` of them
    shards = dealt.groupBy("number", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    taken = (
        placed.join(shards, ["number", "block"], "left")
        .withColumn("shards", F.when(F.col("size") > 0, F.col("shards")))
        .withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
        .select(
            "id", "source", "size", "number", "source_size", "target", "n_blocks", "block",
            (F.size("shards") * F.col("size")).alias("taken"), "shards",
        )
    )
    return taken, dealt


def checked(small: DataFrame, most: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; else Spark joins it as it can."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
    depth: int = 4, piece_words: int = 1 << 22, **options
) -> DataFrame:
    """The mixed documents with all their columns: a row for each time one is taken,
    dealt to tasks by shard and shuffled within each shard.

    A shard's rows are dealt by hash into pieces of about ``piece_words`` words, as many
    for every shard, so the tasks grow in number with the mix and not in size, up to
    ``MOST_TASKS`` pieces.  Texts move once.  Blocks and slots are joined to them by source and block.
    """
    rows, slots = mix(docs, id_col, text_col, source_col, seed=seed, depth=depth, **options)
    # a row per source, and one per slot: about the number of blocks and of FEWEST for each source
    sources = checked(written(rows.groupBy("source").agg(F.first("number").alias("_mix_number"), F.first("n_blocks").alias("_mix_n"), F.sum("taken").alias("_mix_words")), "mix-sources"))
    words = sources.agg(F.sum("_mix_words")).first()[0] or 0
    pieces = max(1, min(-(-words // (piece_words << depth)), MOST_TASKS >> depth))
    slots = checked(written(slots.toDF("_mix_number", "_mix_block", "_mix_copy", "_mix_shard"), "mix-slots"))
    draw = F.xxhash64(F.lit(seed), id_col, F.coalesce(text_col, F.lit("")))
    sources = sources.drop("_mix_words").withColumnRenamed("source", "_mix_source")
    piece = F.pmod(F.xxhash64(F.lit(seed), F.lit("piece"), "_mix_draw", "_mix_copy"), F.lit(pieces))
    return (
        docs.where(word_count(F.col(text_col)) > 0)
        .withColumn("_mix_draw", draw)
        .join(sources, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_block", F.pmod("_mix_draw", "_mix_n"))
        .join(slots, ["_mix_number", "_mix_block"])
        .withColumn("_mix_piece", piece)
        .repartition(2 * pieces << depth, "_mix_shard", "_mix_piece")  # twice as many, so few pieces share a task
        .sortWithinPartitions("_mix_shard", F.xxhash64(F.lit(seed), F.lit("shuffle"), "_mix_draw", "_mix_copy"))
        .select(*docs.columns)
    )
