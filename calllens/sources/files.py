"""Reading and writing transcripts and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens import schemas
from calllens.config import Profile
from calllens.functions.text import base_name
from calllens.operators.quality import reject_reason

AUDIO = r"\.(mp3|wav|flac|m4a)$"


def transcript_text(path: Column, raw: Column, profile: Profile) -> Column:
    """Text of one file: the transcript inside a ``.json`` file, else the body.  A
    ``.json`` file that does not parse has no text; ``bad_json`` tells it apart."""
    choices = [F.get_json_object(raw, "$.results.transcripts[0].transcript")]
    if profile.json_transcript_key:
        choices.append(F.get_json_object(raw, "$.transcript"))
    found = F.when(~bad_json(path, raw), F.coalesce(*choices, raw))
    return F.when(F.endswith(path, F.lit(".json")), found).otherwise(raw)


def bad_json(path: Column, raw: Column) -> Column:
    return F.endswith(path, F.lit(".json")) & raw.isNotNull() & F.try_parse_json(raw).isNull()


def with_transcript(files: DataFrame, profile: Profile) -> DataFrame:
    """Add ``text`` and ``problem``, which is null for a file that can be analysed."""
    text = transcript_text(F.col("path"), F.col("raw"), profile)
    reason = F.when(bad_json(F.col("path"), F.col("raw")), "bad_json").otherwise(reject_reason(F.col("text")))
    return files.withColumn("text", text).withColumn("problem", reason)


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows without a problem, rows with one)``."""
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL")


def read_transcripts(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """One row per file: keyed by its full path, with base name, size and time."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            base_name(F.col("_metadata.file_path")).alias("file_name"),
            F.col("_metadata.file_modification_time").alias("uploaded_at"),
            F.col("_metadata.file_size").alias("size_bytes"),
            F.col("value").alias("raw"),
        )
    )
    return with_transcript(files, profile)


def read_results(
    spark: SparkSession, path: str, schema: str = schemas.ANALYSIS, indented: bool = False
) -> DataFrame:
    """Result documents with the size and time of their files.

    Files hold a document per line, or with ``indented`` one document each over many
    lines.  ``problem`` is null for a document that parsed and ``malformed`` else.
    """
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    docs = reader.option("recursiveFileLookup", True).option("multiLine", indented).json(path)
    # Spark refuses to read the corrupt record alone, so a second column, whose test never
    # holds, is read with it
    never = F.length(F.col(docs.columns[0]).cast("string")) < 0
    return docs.select(
        *[c for c in docs.columns if c != "_corrupt"],
        F.when(F.col("_corrupt").isNotNull() | never, "malformed").alias("problem"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ).where(~F.endswith("path", F.lit("/")))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    """Store results once, in folders by the ``partition`` column if one is named.

    Rows are then dealt by that column first, so that a folder gets few files; AQE splits
    a large folder over tasks and joins small ones.
    """
    if partition:
        df = df.hint("rebalance", partition)
    writer = df.write.mode("errorifexists").format(fmt)
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


def audio_uploads(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows that are audio files, with the media format from the extension."""
    return listing.where(F.lower(path).rlike(AUDIO)).withColumn(
        "media_format", F.lower(F.substring_index(path, ".", -1))
    )


def list_audio_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder; contents are never read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"))
    )
    return audio_uploads(listing)
