"""Exact deduplication by a 128-bit content hash with byte comparison.

Hashes are counted first, without the texts: a hash that one row has needs no comparison.
The texts of the others are grouped by (hash, bytes), and tasks reduce their rows to one
per text before the shuffle, so a text that fills a third of the table sends one row per
task.  Spark compares the bytes of equal keys; a hash under which more than one text was
found is a collision, and its documents are matched by their bytes.  All others are
matched by the hash, which the grouping has proved to stand for one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import few, written

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_128,
    most_sent: int = 1_000_000,
) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``.

    Null texts equal empty ones.  A group keeps its smallest id; null ids count as
    larger than any id, and a group of null ids alone keeps a null.  Rows repeated
    with the kept id are all marked as kept, since nothing tells them apart.  An
    empty table gives no rows; other columns of the table are not read.  Hashes of
    several rows are sent to the tasks, 16 bytes each, while there are at most
    ``most_sent``; beyond that the texts are shuffled to meet them.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    hashed = texts.withColumn("hash", content_hash(F.col("norm")))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    members = written(hashed.select("id", "hash", sha), "exact-hashes")
    twice = written(members.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "exact-twice")
    suspects = hashed.join(few(twice, most_sent), "hash", "left_semi")
    groups = suspects.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    # the text itself is left behind: a later collision check needs only the number of texts
    per_hash = written(
        groups.groupBy("hash").agg(
            F.count("*").alias("texts"), F.first("keep_id").alias("first_id"), F.first("group_size").alias("size")
        ),
        "exact-groups",
    )
    alone = F.col("texts").isNull()
    found = members.join(per_hash, "hash", "left").where("coalesce(texts, 1) = 1").select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256",
    )
    collided = per_hash.where("texts > 1").select("hash")
    if not collided.isEmpty():
        apart = hashed.join(collided, "hash", "left_semi")
        same = apart.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(apart.join(same, ["hash", "norm"]).select("id", "keep_id", "group_size", sha))
    return found.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows repeated with the kept id every one stays.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_keep"]), "left_semi")
