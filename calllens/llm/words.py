"""Word splitting on UTF-8 bytes, shared by the operators that run in tasks.

Both tables leave bytes of 0x80 and above alone, so multi-byte characters stay whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z, every other ASCII character that is no digit or letter to a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return data.translate(ALNUM).split()


def blank_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered."""
    return data.lower().split()


def utf8(name: str) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
