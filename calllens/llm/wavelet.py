"""Token ids in wavelet-matrix files: one compressed file per shard of documents.

Level ``l`` of the matrix holds bit ``l`` (from the top) of every id, in the order that
puts ids with a 0 in the level above before those with a 1.  Ids are first replaced by
their rank by frequency in the file, so the upper levels are almost all zeros and
compress well.  Each level is cut into chunks, compressed one by one, with the number
of ones before each chunk; access, counting and occurrence lookup therefore decode a
few chunks per level.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calllens.llm.store import put, read_files, remembered, scratch, written
from calllens.llm.words import batch, id_and_text

SUFFIX = ".wvm"
MAGIC = b"WVMX0001"
CHUNK_BITS = 1 << 16

SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64())])
DOCS = pa.schema(
    [
        ("part", pa.int32()),
        ("seq", pa.int32()),
        ("id", pa.int64()),
        ("local_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def levels_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def split_levels(ids: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """The bits of each level, as booleans in the order of that level."""
    order = ids
    for level in range(levels):
        ones = (order & ids.dtype.type(1 << (levels - 1 - level))).astype(bool)
        yield ones
        order = np.concatenate((np.compress(~ones, order), np.compress(ones, order)))


def join_levels(planes: list[np.ndarray], dtype) -> np.ndarray:
    """The ids again: the levels are undone from the last to the first."""
    levels = len(planes)
    low = np.zeros(len(planes[0]), dtype)
    for level in reversed(range(levels)):
        ones = planes[level]
        zeros = np.flatnonzero(~ones)
        back = np.empty_like(low)
        back[zeros] = low[: len(zeros)]
        back[np.flatnonzero(ones)] = low[len(zeros) :] | dtype(1 << (levels - 1 - level))
        low = back
    return low


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """One file: header, tables of documents and of ids by rank, then the levels in chunks."""
    codec, counts = zstandard.ZstdCompressor(level=1), np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    ranks = np.zeros(len(counts), ids.dtype)
    ranks[alphabet] = np.arange(len(alphabet), dtype=ids.dtype)
    levels, order = levels_of(len(alphabet)), ranks[ids]
    docs = codec.compress(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.array(lengths, "<i8").tobytes()
        + alphabet.astype("<u4").tobytes()
    )
    body, starts, ones_before, at = [], [], [], 0
    for ones in split_levels(order, levels):
        total = 0
        for i in range(0, max(len(ids), 1), CHUNK_BITS):
            chunk = ones[i : i + CHUNK_BITS]
            starts.append(at)
            ones_before.append(total)
            total += int(np.count_nonzero(chunk))
            body.append(codec.compress(np.packbits(chunk, bitorder="little").tobytes()))
            at += len(body[-1])
        starts.append(at)
        ones_before.append(total)
    head = json.dumps(
        {"n": len(ids), "levels": levels, "documents": len(doc_ids), "docs_bytes": len(docs),
         "alphabet": len(alphabet), "chunk_bits": CHUNK_BITS}
    ).encode()
    tables = np.array([starts, ones_before], "<i8").tobytes()
    return MAGIC + struct.pack("<I", len(head)) + head + docs + tables + b"".join(body)


class WaveletFile:
    """Reads one file; positions and counts refer to the ids of that file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.n, self.levels, self.chunk_bits = head["n"], head["levels"], head["chunk_bits"]
        at, m = 12 + size, head["documents"]
        self.codec = zstandard.ZstdDecompressor()
        docs = self.codec.decompress(data[at : at + head["docs_bytes"]])
        missing = np.frombuffer(docs, "u1", m, 8 * m)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(docs, "<i8", m), missing)]
        self.lengths = np.frombuffer(docs, "<i8", m, 9 * m)
        self.alphabet = np.frombuffer(docs, "<u4", head["alphabet"], 17 * m)
        at += head["docs_bytes"]
        per_level = max(1, -(-self.n // self.chunk_bits)) + 1
        tables = np.frombuffer(data, "<i8", 2 * self.levels * per_level, at)
        self.starts, self.ones = tables.reshape(2, self.levels, per_level)
        self.body = memoryview(data)[at + tables.nbytes :]
        self.dtype = np.uint16 if self.levels <= 16 else np.uint32
        self.ranks = {token: rank for rank, token in enumerate(self.alphabet.tolist())}

    def chunk(self, level: int, i: int) -> np.ndarray:
        raw = self.codec.decompress(self.body[self.starts[level, i] : self.starts[level, i + 1]])
        bits = min(self.chunk_bits, self.n - i * self.chunk_bits)
        return np.unpackbits(np.frombuffer(raw, "u1"), count=max(bits, 0), bitorder="little")

    def plane(self, level: int) -> np.ndarray:
        return np.concatenate([self.chunk(level, i) for i in range(self.starts.shape[1] - 1)]).view(bool)

    def zeros(self, level: int) -> int:
        return self.n - int(self.ones[level, -1])

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of the level."""
        c, rest = divmod(i, self.chunk_bits)
        return int(self.ones[level, c]) + (int(np.count_nonzero(self.chunk(level, c)[:rest])) if rest else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit of that value."""
        before = self.ones[level, :-1]
        if not bit:
            before = np.arange(len(before)) * self.chunk_bits - before
        c = int(np.searchsorted(before, k, side="right")) - 1
        return c * self.chunk_bits + int(np.flatnonzero(self.chunk(level, c) == bit)[k - int(before[c])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0  # by rank
        for level in range(self.levels):
            c, rest = divmod(i, self.chunk_bits)
            bit, ones = int(self.chunk(level, c)[rest]), self.rank1(level, i)
            token = token << 1 | bit
            i = self.zeros(level) + ones if bit else i - ones
        return int(self.alphabet[token])

    def span(self, rank: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if rank >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros(level) + a, self.zeros(level) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the id at positions ``lo`` up to, not including, ``hi``."""
        if token not in self.ranks:
            return 0
        lo, hi = self.span(self.ranks[token], lo, self.n if hi is None else hi)
        return hi - lo

    def find(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of the id."""
        rank = self.ranks.get(token)
        first, end = (0, 0) if rank is None else self.span(rank, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        at = first + k
        for level in reversed(range(self.levels)):
            bit = rank >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros(level) if bit else at)
        return at

    def ids(self) -> np.ndarray:
        order = join_levels([self.plane(level) for level in range(self.levels)], self.dtype)
        return self.alphabet[order] if len(order) else order


# A word in UTF-8 with A-Z lowered: letters a-z and U+00C0 to U+00FF, whose lower case is one
# letter, that no normalisation changes, and that the tokenizer's word pattern takes
# together; then ASCII signs (no apostrophe, which may begin a contraction), a word of their own to it.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
# In such a word the second bytes of capital letters, moved to those of the small ones.
SMALL = bytes(b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies use for each byte: printable bytes
    stand for themselves, the others follow from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts by an installed tokenizer that lowers case and drops blanks.

    No token spans white space, so the ids of a text are those of its blank-separated
    words in order, and each new word is encoded once.  Signs behind plain letters are
    looked up apart.  A word of plain letters is one word to the tokenizer and goes
    straight to its merge model; any other goes through the whole tokenizer, and so do
    words that hold a special token's string, whose case the tokenizer tells apart.  Words
    are remembered in two halves: when the newer one (this dict) reaches ``most`` entries it
    becomes the older one, whose rare words are then forgotten.
    """

    def __init__(self, path: str, end_id: int | None, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        letters = byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = b"" if end_id is None else self.dtype(end_id).tobytes()
        self.packed = packed = [self.dtype(i).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        merge = self.tokenizer.model.tokenize
        self.plain = lambda letters: b"".join([packed[t.id] for t in merge(letters)])

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            # ASCII letters, lowered before, are the most common case
            got = self.plain(word.decode("ascii")) if word.isalpha() else self.other(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got

    def other(self, word: bytes) -> bytes:
        if word[-1:] in b".," and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        if found := PLAIN.fullmatch(word):
            letters, signs = found.groups()
            if signs:
                return self[letters] + self[signs]
            return self.plain(charmap_decode(letters.translate(SMALL), "strict", self.letters)[0])
        text = word.decode("utf-8", "replace")
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def words(self, data: bytes) -> list[bytes]:
        low = data.lower()
        for special in self.special:
            if special in low:
                held = self.special
                return [w if any(s in w.lower() for s in held) else w.lower() for w in data.split()]
        return low.split()

    def text(self, data: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.words(data))) + self.end, self.dtype)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = 2 << 20,
) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest
    ``(part, seq, tokens, documents)`` of the files.

    Rows are dealt to tasks by ranges of the id (nulls first), rows of one id in the
    order of their texts.  A file is closed at the document with which it reaches
    ``shard_tokens``.  A null text is empty and keeps its end id.  Nothing is written
    for an empty table.  ``tokenizer`` must lie at the same path on every executor.
    """
    ordered = (
        id_and_text(docs, id_col, text_col)
        .withColumn("id", F.col("id").cast("bigint"))
        .withColumn("tie", F.xxhash64("data"))
        .repartitionByRange(F.col("id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "data")
        .select("id", "data")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = remembered(("tokens", tokenizer, end_id), lambda: Encoder(tokenizer, end_id))
        held, names, lengths, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            put(folder, f"part-{part:06d}-{seq:06d}{SUFFIX}", pack(np.concatenate(held), names, lengths))
            return batch(SHARDS, [part], [seq], [size], [len(names)])

        for table in batches:
            for name, data in zip(table.column("id").to_pylist(), table.column("data")):
                held.append(encoder.text(data.as_py()))
                names.append(name)
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= shard_tokens:
                    yield close()
                    seq += 1
                    held, names, lengths, size = [], [], [], 0
        if names:
            yield close()

    return ordered.mapInArrow(write, "part int, seq int, tokens bigint, documents bigint")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of every file, with its place inside the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for i in range(table.num_rows):
                part, seq = map(int, table.column("path")[i].as_py().rpartition("/")[2].split(".")[0].split("-")[1:])
                held = WaveletFile(table.column("content")[i].as_py())
                raw = held.ids().astype("<u4", copy=False).view("u1")
                ends = np.cumsum(held.lengths)
                starts = ends - held.lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                m = len(sums)
                yield batch(DOCS, [part] * m, [seq] * m, held.doc_ids, starts, held.lengths, sums)

    return read_files(spark, folder, SUFFIX).mapInArrow(
        read, "part int, seq int, id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """How often, and where first and last, each of a few ids stands in each file."""
    wanted = list(tokens)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            rows = []
            for path, data in zip(table.column("path").to_pylist(), table.column("content")):
                held = WaveletFile(data.as_py())
                for token in wanted:
                    if n := held.count(token):
                        rows.append((path, token, n, held.find(token, 0), held.find(token, n - 1)))
            schema = pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in ("token", "n", "first", "last")])
            yield batch(schema, *(list(c) for c in zip(*rows)) if rows else [[]] * 5)

    return read_files(spark, folder, SUFFIX).mapInArrow(look, "path string, token bigint, n bigint, first bigint, last bigint")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Where each file begins among all ids.

    Files count within their task first; the window over everything sees one row per
    task.
    """
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("part_start"))
    inside = F.sum("tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return manifest.withColumn("inside", inside).join(parts, "part").select(
        "part", "seq", (F.col("part_start") + F.col("inside")).alias("file_start")
    )


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files, read them back and return per document
    ``(id, start, n_tokens, ids_crc32)``; ``start`` counts the ids of all documents before."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    manifest = written(write_tokens(docs, f"{folder}/shards", tokenizer, **options), "token-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, f"{folder}/shards").join(shard_starts(manifest), ["part", "seq"]).select(
        "id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
