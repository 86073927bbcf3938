"""Sharding by jump consistent hashing, with DataFrame functions alone.

A key walks through the shard counts at which it would move: its generator, seeded by the
key, gives the next such count, and the last one below the number of shards names its
shard.  The walk does not depend on the number of shards, so a shard appended takes about
one key of each (shards + 1), all of them into itself, and no ring or table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from calllens.llm.store import written

#: Fixed value: the multiplier of the published generator, key * MULTIPLIER + 1 modulo 2 ** 64.
MULTIPLIER = 2862933555777941757
HALF = (1 << 32) - 1
#: Jumps taken before the rare longer walks are followed apart.
STEPS = 64


def low_product(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2 ** 32, both below 2 ** 32, without overflow."""
    upper = F.shiftleft((F.shiftright(x, 16) * factor).bitwiseAND(0xFFFF), 16)
    return (x.bitwiseAND(0xFFFF) * factor + upper).bitwiseAND(HALF)


def advanced(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The next state of the generator, as its upper and lower 32 bits."""
    c_hi, c_lo = divmod(MULTIPLIER, 1 << 32)
    upper = F.shiftright(lo, 16) * c_lo
    low = lo.bitwiseAND(0xFFFF) * c_lo + F.shiftleft(upper.bitwiseAND(HALF), 16) + 1
    carried = F.shiftright(low, 32) + F.shiftleft(F.shiftright(upper, 32), 16)
    return (carried + low_product(hi, c_lo) + low_product(lo, c_hi)).bitwiseAND(HALF), low.bitwiseAND(HALF)


def walk(key: Column, shards: int) -> Column:
    """``(shard, next)`` of a bigint key: its shard of so many, and the count of shards
    beyond which it moves again, into the last shard then."""

    def state(hi, lo, at, to) -> Column:
        return F.struct(hi.alias("hi"), lo.alias("lo"), at.alias("at"), to.alias("to"))

    def jump(s: Column, _) -> Column:
        hi, lo = advanced(s["hi"], s["lo"])
        # the upper 31 bits of the generator, as a part of 2 ** 31
        far = F.floor((s["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1)))
        return F.when(s["to"] < shards, state(hi, lo, s["to"], far)).otherwise(s)

    zero = F.lit(0).cast("bigint")
    start = state(F.shiftrightunsigned(key, 32), key.bitwiseAND(HALF), zero, zero)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, jump)
    if shards > STEPS:  # a key jumps about ln(shards) times, and ``shards`` times at most
        rest = F.aggregate(F.sequence(F.lit(STEPS + 1), F.lit(shards)), out, jump)
        out = F.when(out["to"] < shards, rest).otherwise(out)
    return F.struct(out["at"].cast("int").alias("shard"), out["to"].alias("next"))


def key_of(docs: DataFrame, column: str) -> Column:
    """Whole numbers are their own key; other types are hashed.  Null is the key 0."""
    if isinstance(docs.schema[column].dataType, IntegralType):
        return F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.xxhash64(column)).cast("bigint")


def shard_of(docs: DataFrame, shards: int, id_col: str = "doc_id") -> Column:
    """The shard, from 0, of each row of ``docs`` by its key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return walk(key_of(docs, id_col), shards)["shard"]


def exploded(rows: DataFrame, start: str, n: str, place: str, piece: int = 4096) -> DataFrame:
    """``n`` copies of each row, numbered on from ``start``; an array holds ``piece`` of
    them at most, and pieces of a row with many copies go to several tasks."""
    last = F.col(start) + F.col(n) - 1
    many = F.col(n) > piece
    few = rows.where(~many).withColumn(place, F.explode(F.sequence(start, last)))
    pieces = rows.where(many).withColumn("_at", F.explode(F.sequence(F.col(start), last, F.lit(piece).cast("bigint"))))
    pieces = pieces.repartition("_at").withColumn(
        place, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + piece - 1, F.col(start) + F.col(n) - 1)))
    )
    return few.unionByName(pieces.drop("_at"))


def assign(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_bucket: int = 500_000,
) -> DataFrame:
    """One row per document: ``(id, size, text_crc32, shard, slot, grown_shard)``.

    ``size`` is 8 more than the bytes of the text in UTF-8, ``grown_shard`` the shard with
    one shard more, ``slot`` numbers the rows of a shard from 0 without gaps.  Rows equal
    in id, size and checksum are counted as one before they are dealt, so a row repeated
    any number of times loads no task; the others are numbered in buckets of about
    ``rows_per_bucket`` rows by hash, within a bucket by id, and the buckets' counts are
    summed up shard by shard.  Slots follow from the rows alone: reruns agree.

    A null text has no bytes and checksum 0, as an empty one.  Null ids share a shard.
    An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        key_of(docs, id_col).alias("key"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    counted = rows.groupBy("id", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = counted.withColumn("w", walk(F.col("key"), shards)).select(
        "id", "size", "text_crc32", "n", F.col("w.shard").alias("shard"),
        F.when(F.col("w.next") == shards, F.lit(shards)).otherwise(F.col("w.shard")).cast("int").alias("grown_shard"),
    )
    placed = written(placed, "shard-rows")
    buckets = -(-placed.count() // (shards * rows_per_bucket)) or 1
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(buckets)))
    # one row per shard and bucket
    before = W.partitionBy("shard").orderBy("bucket")
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("all"))
    starts = starts.select("shard", "bucket", (F.sum("all").over(before) - F.col("all")).alias("first"))
    inside = W.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "size", "text_crc32")
    numbered = placed.withColumn("upto", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    numbered = numbered.join(starts, ["shard", "bucket"]).withColumn("start", F.col("first") + F.col("upto") - F.col("n"))
    return exploded(numbered, "start", "n", "slot").select("id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(
    docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", shard_col: str = "shard", tasks_per_shard: int = 8
) -> None:
    """The rows as Parquet, one subfolder per shard; a shard's rows are written by several
    tasks, dealt by hash of the whole row."""
    if shard_col in docs.columns:
        raise ValueError(f"the table has a column {shard_col} already")
    placed = docs.withColumn(shard_col, shard_of(docs, shards, id_col))
    deal = F.pmod(F.xxhash64(*docs.columns), F.lit(tasks_per_shard))
    placed.repartition(shards * tasks_per_shard, shard_col, deal).write.partitionBy(shard_col).parquet(folder)
