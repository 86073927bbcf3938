"""WARC archives in Zstandard: one frame per record behind a shared dictionary.

An archive begins with a skippable frame that holds the dictionary, plain or itself
compressed; every record is one frame, so that any record can be decoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.llm.store import put, read_files, scratch
from calllens.llm.words import batch, utf8

SUFFIX = ".warc.zst"
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

ARCHIVES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("problem", pa.string()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, uri, payload: bytes, refers_to, date: str = EPOCH) -> bytes:
    """One record: the HTTP response, or for a revisit its header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    # a line break inside a value would end the header early
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {record_uri(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
            f"WARC-Profile: {REVISIT_PROFILE}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_head(dictionary: bytes, compressed: bool = True) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary) if compressed and dictionary else dictionary
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; too few or too small ones give none."""
    if len(samples) < 8 or sum(map(len, samples)) < 10 * size:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = EPOCH,
    archive_bytes: int = 8 << 20,
    dictionary_bytes: int = 64 << 10,
    dictionary_records: int = 500,
    salts: int = 16,
) -> DataFrame:
    """Write every page as a record and return the manifest ``(path, records, bytes)``.

    Of pages with equal payloads that of the largest id is the response and the others
    revisit it; rows repeated with that id are all responses, and so are those of a
    group without any id.  A null payload is empty and a null address is
    ``about:blank``.  Each archive carries a dictionary trained on the first
    ``dictionary_records`` records of its partition.  An archive is closed once its
    records reach ``archive_bytes``.  Nothing is written for an empty table.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("data")
    ).withColumn("digest", F.unhex(F.sha1("data")))
    # one payload may fill a third of the table: its rows meet their response in `salts` groups
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    twins = (
        rows.groupBy("digest")
        .agg(F.max("id").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "response", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    todo = salted.join(twins, ["digest", "salt"], "left").select(
        "id", "url", "data", F.when(F.col("id") < F.col("response"), F.col("response")).when(
            F.col("id").isNull(), F.col("response")).alias("refers_to")
    ).sortWithinPartitions(F.col("id").asc_nulls_first(), "url", "data")  # a task that runs again writes the same files

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first: list[bytes] = []
        state = {"seq": 0, "codec": None}

        def close(frames: list[bytes]) -> pa.RecordBatch:
            data = b"".join(frames)
            path = put(folder, f"part-{part:06d}-{state['seq']:05d}{SUFFIX}", data)
            state["seq"] += 1
            return batch(ARCHIVES, [path], [len(frames) - 1], [len(data)])

        def begin() -> list[bytes]:
            if state["codec"] is None:
                words = train(first, dictionary_bytes)
                state["head"] = archive_head(words)
                state["codec"] = zstandard.ZstdCompressor(
                    level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True
                )
            return [state["head"]]

        frames, size = None, 0
        for table in batches:
            rows = zip(*(table.column(c).to_pylist() for c in ("id", "url", "data", "refers_to")))
            records = [record(i, u, d, r, date) for i, u, d, r in rows]
            first = first or records[:dictionary_records]
            for raw in records:
                frames = frames or begin()
                frames.append(state["codec"].compress(raw))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield close(frames)
                    frames, size = None, 0
        if frames:
            yield close(frames)

    return todo.mapInArrow(write, "path string, records bigint, bytes bigint")


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, by its block headers; the content is not decoded."""
    if data[at : at + 4] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    params = zstandard.get_frame_parameters(data[at : at + 18])
    place, last = at + zstandard.frame_header_size(data[at : at + 18]), False
    while not last:
        if place + 3 > len(data):
            raise ValueError(f"frame at byte {at} is cut off")
        block = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError(f"frame at byte {at} has a reserved block")
        place += 3 + (1 if kind == 1 else size)
    place += 4 * params.has_checksum
    if place > len(data):
        raise ValueError(f"frame at byte {at} is cut off")
    return place


def leading_dictionary(data: bytes) -> tuple[bytes, int]:
    """The dictionary in the leading skippable frame, and where the records begin."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        return b"", 0
    size = int.from_bytes(data[4:8], "little")
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    body = data[8 : 8 + size]
    return (zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME_MAGIC else body), 8 + size


def frames(data: bytes, most: int = 1 << 31) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded records of an archive, one per frame, or what is wrong with one.

    A frame that claims more than ``most`` bytes is reported and not decoded.  After
    a broken frame header nothing more can be located, so the archive ends there.
    """
    try:
        words, at = leading_dictionary(data)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    except (ValueError, zstandard.ZstdError) as error:
        yield None, f"dictionary: {error}"
        return
    while at < len(data):
        try:
            if at + 8 <= len(data) and int.from_bytes(data[at : at + 4], "little") in SKIPPABLE:
                at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                continue
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as error:
            yield None, str(error)
            return
        try:
            said = zstandard.get_frame_parameters(data[at : at + 18]).content_size
            known = said not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
            if known and said > most:
                yield None, f"record of {said} bytes"
            else:
                body = codec.decompressobj().decompress(data[at:end])
                yield body, f"frame says {said} bytes, holds {len(body)}" if known and said != len(body) else None
        except zstandard.ZstdError as error:
            yield None, f"frame at byte {at}: {error}"
        at = end


def parse(raw: bytes) -> dict:
    """The fields of one record, checked; ``problem`` names the first fault."""
    out = dict.fromkeys(RECORDS.names)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        return out | {"problem": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return out | {"problem": f"bad header line {line[:40]!r}"}
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [n for n in REQUIRED if n not in fields]:
        return out | {"problem": f"missing {', '.join(missing)}"}
    if not fields["content-length"].isdecimal():
        return out | {"problem": "Content-Length is no number"}
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    out |= {
        "record_id": fields["warc-record-id"],
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    for name, key in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id")):
        if key in fields:
            if not re.fullmatch(r"-?\d+", fields[key]):
                return out | {"problem": f"{key} is no number"}
            out[name] = int(fields[key])
    if len(block) != size:
        return out | {"problem": f"block of {len(block)} bytes, Content-Length {size}"}
    if tail != b"\r\n\r\n":
        return out | {"problem": "record does not end with two line breaks"}
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        return out | {"problem": "block digest differs"}
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if fields["warc-type"] == "response":
        if not gap or not http.startswith(b"HTTP/"):
            return out | {"problem": "response without HTTP header"}
        if said and int(said[1]) != len(payload):
            return out | {"problem": f"payload of {len(payload)} bytes, HTTP says {int(said[1])}"}
        if out["payload_digest"] and out["payload_digest"] != sha1_base32(payload):
            return out | {"problem": "payload digest differs"}
        return out | {"payload": payload, "payload_bytes": len(payload)}
    return out | {"payload_bytes": int(said[1]) if said else None}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of every archive below ``folder``, in the fields of ``RECORDS``.

    ``problem`` is null for a sound record.  A revisit has no payload of its own;
    ``payload_bytes`` is the length that its HTTP header states.  A folder without
    archives gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for i in range(table.num_rows):
                held, size = [], 0
                for raw, fault in frames(table.column("content")[i].as_py()):
                    got = parse(raw) if raw is not None else dict.fromkeys(RECORDS.names)
                    held.append(got | {"problem": got["problem"] or fault})
                    size += len(raw or b"")
                    if size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=RECORDS)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=RECORDS)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in RECORDS)
    return read_files(spark, folder, SUFFIX).mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages as archives, then read them back from the files."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    manifest = write_archives(pages, f"{folder}/archives", **options)
    manifest.write.parquet(f"{folder}/manifest")
    if spark.read.schema(manifest.schema).parquet(f"{folder}/manifest").isEmpty():
        kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
        return spark.createDataFrame([], ", ".join(f"{f.name} {kinds[f.type]}" for f in RECORDS))
    return read_archives(spark, f"{folder}/archives")
