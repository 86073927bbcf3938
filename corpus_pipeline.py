"""From raw documents to token files: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calllens.llm import decontam, mixing, simhash, toxicity, wavelet
from calllens.llm.queries import END_ID, table, tokenizer_path
from calllens.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half, with all their columns.

    Null and empty texts have no hits and stay, repeated rows share their fate, and an
    empty table or one without labels of both kinds keeps or loses all alike.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies.

    Groups are documents whose fingerprints of three-word shingles differ in at most 3
    bits, directly or through others.  Texts without words are one group; null ids count
    as larger than any; rows repeated with the id that stays all stay.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window of ten words.

    Null and empty texts hold none; of rows that share an id, all go if any is hit.
    """
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken more than once has as many rows.

    Texts without words are never taken, a null source is a source of its own, and rows
    repeated in the table share their block.  Ties follow from hashes: reruns agree.
    """
    return mixing.mixture(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and where each document lies in them, in ascending id order.

    Null ids come first; rows of one id are ordered by their texts.  A null text is
    empty and keeps its end id; an empty table writes nothing.
    """
    return wavelet.token_table(docs, tokenizer_path(), end_id=END_ID).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can express neither the learned score nor the fingerprints; tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
