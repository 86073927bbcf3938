"""Alignment of two tokenizers over a corpus.

Texts are deduplicated first: a shuffle by the full text leaves each distinct one once,
with its multiplicity.  It is encoded by both tokenizers and cut at the byte offsets where
tokens of both end; two tokens that end together are linked.  How often the corpus links a
pair of ids is counted over the distinct texts by their multiplicities, and what a text's
links measure against these counts is joined to the documents that hold the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calllens.llm.store import remembered, written
from calllens.llm.words import batch

#: Rows of the table of pair counts that tasks may be sent, 12 bytes each.
MOST_SENT = 4_000_000
#: Pairs a task holds before it passes its counts on.
HELD = 2_000_000


class ByteLevel:
    """A byte-level BPE vocabulary of the ``tokenizers`` library: ids and their bytes.

    Where a vocabulary's ids follow its merges, ``tiktoken`` gives the same ids several
    times faster; it serves texts of characters whose classes all Unicode versions share
    and without very long blanks, on which it fails.  All others go through the library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RARE = re.compile("[^\x00-\u036f\u2000-\u206f]")
    BLANKS = re.compile(r"\s{1000}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        size = max([*ids.values(), *added.values()]) + 1
        self.pieces = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = token
        self.quick = self.faster(spec, ids) if self.plain(spec, ids, byte_of) else None

    @staticmethod
    def plain(spec: dict, ids: dict[bytes, int], byte_of: dict[str, int]) -> bool:
        """Whether the ids of single bytes come first and those of merges follow in order."""
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return False
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        return all(ids.get(bytes(byte_of[c] for c in token)) == 256 + i for i, token in enumerate(joined))

    def faster(self, spec: dict, ids: dict[bytes, int]):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.quick and (text.isascii() or not self.RARE.search(text)) and not self.BLANKS.search(text):
            return self.quick(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A ``sentencepiece`` vocabulary: ids and their bytes.  It puts a space in front."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.encode = lambda text: model.encode(text, num_threads=1)
        self.pieces = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("\u2581", " ").encode())


class Aligner:
    """Encodes a text with both tokenizers and cuts it where tokens of both end."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(p) for p in t.pieces]) for t in (self.a, self.b))
        # decimal ids before a comma, A's before a bar, B's before a semicolon
        na, nb = len(self.a.pieces), len(self.b.pieces)
        self.shown = [b"%d%s" % (i, sign) for n, last in ((na, b"|"), (nb, b";")) for sign in (b",", last) for i in range(n)]

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray] | None:
        """``(n_a, n_b, n_groups, groups, linked)``: the hash of the groups and the pairs
        ``a * (size of B) + b`` in order; None where a tokenizer does not keep the text."""
        if not text:
            return None
        spaced = " " + text
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(text)
        whole = spaced.encode()
        if b"".join(map(self.a.pieces.__getitem__, ids_a)) != whole or b"".join(map(self.b.pieces.__getitem__, ids_b)) != whole:
            return None
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        in_a, in_b = (np.zeros(len(whole) + 1, bool) for _ in "ab")
        in_a[ends_a], in_b[ends_b] = True, True
        last_a, last_b = in_b[ends_a], in_a[ends_b]
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        na, nb, group_a, group_b = len(self.a.pieces), len(self.b.pieces), np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # the ids in the order of the text: a group's A tokens, then its B tokens
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = a + na * last_a
        order[np.arange(len(b)) + upto_a[group_b]] = 2 * na + b + nb * last_b
        groups = b"".join(map(self.shown.__getitem__, order.tolist()))[:-1]
        linked = a[last_a] * np.int64(nb) + b[last_b]
        return len(a), len(b), len(upto_a), hashlib.sha256(groups).hexdigest(), linked


def text_key(text: Column) -> Column:
    """256 bits of a text, by which its measures find its documents."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


ALIGNED = pa.schema(
    [("key", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)
ALIGNED_SQL = "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary, times binary"


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text that both tokenizers keep: its key, multiplicity, numbers
    of tokens and groups, hash of the groups, and its linked pairs with how often each is
    linked in it (packed 64- and 32-bit numbers)."""
    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''")
    distinct = texts.groupBy("text").agg(F.count("*").alias("copies")).select(text_key(F.col("text")).alias("key"), "text", "copies")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = remembered(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for table in batches:
            rows = []
            for key, text, copies in zip(*(table.column(c) for c in ("key", "text", "copies"))):
                if found := aligner.align(text.as_py()):
                    pairs, times = np.unique(found[4], return_counts=True)
                    rows.append((key.as_py(), copies.as_py(), *found[:4], pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
                if len(rows) == 256:
                    yield batch(ALIGNED, *zip(*rows))
                    rows = []
            if rows:
                yield batch(ALIGNED, *zip(*rows))

    return distinct.mapInArrow(align, ALIGNED_SQL)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n, best)``: how many links of the corpus each pair has, and whether no pair
    of its B id has more.  Tasks add up their texts' pairs before the shuffle."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, np.concatenate([t for _, t in held]))
            return pairs, n

        for table in batches:
            for copies, pairs, times in zip(*(table.column(c) for c in ("copies", "pairs", "times"))):
                held.append((np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "<i4") * np.int64(copies.as_py())))
                size += len(held[-1][0])
                if size >= 2 * HELD:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= HELD:
                        yield batch(schema, *held[0])
                        held, size = [], 0
        if held:
            yield batch(schema, *summed())

    parts = aligned.select("copies", "pairs", "times").mapInArrow(count, "pair bigint, n bigint")
    sums = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    top = sums.groupBy(F.pmod("pair", F.lit(n_b)).alias("b")).agg(F.max("n").alias("top"))
    return sums.withColumn("b", F.pmod("pair", F.lit(n_b))).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def measures(aligned: DataFrame, counts: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``(key, n_a, n_b, n_groups, groups_sha256, n_best, count_sum)`` of each text, the
    last two over its links.

    A table of at most ``most_sent`` counts is sent to the tasks; a longer one is joined
    to the texts' pairs, one row each.
    """
    spark = aligned.sparkSession
    if counts.limit(most_sent + 1).count() > most_sent:
        return joined_measures(aligned, counts)
    table = counts.toArrow().sort_by("pair")
    pairs, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast((pairs, n, np.packbits(best.astype(bool), bitorder="little")))
    own = ["key", "n_a", "n_b", "n_groups", "groups_sha256"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_pairs, n, best = sent.value
        for table in batches:
            sums = []
            for pairs, times in zip(table.column("pairs"), table.column("times")):
                at = np.searchsorted(all_pairs, np.frombuffer(pairs.as_buffer(), "<i8"))
                times = np.frombuffer(times.as_buffer(), "<i4").astype(np.int64)
                is_best = best[at >> 3] >> (at & 7).astype(np.uint8) & 1
                sums.append((int(times @ is_best), int(times @ n[at])))
            added = (pa.array([row[i] for row in sums], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([*(table.column(c) for c in own), *added], [*own, "n_best", "count_sum"])

    sql = "key binary, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return aligned.select(*own, "pairs", "times").mapInArrow(measure, sql)


def joined_measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: a row per text and pair meets the counts, and a text's rows are
    added up again."""
    schema = pa.schema([("key", pa.binary()), ("pair", pa.int64()), ("times", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for key, own, times in zip(*(table.column(c) for c in ("key", "pairs", "times"))):
                own, times = np.frombuffer(own.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "<i4")
                for i in range(0, len(own), 1 << 16):
                    piece = own[i : i + (1 << 16)]
                    yield batch(schema, [key.as_py()] * len(piece), piece, times[i : i + (1 << 16)])

    links = aligned.select("key", "pairs", "times").mapInArrow(unpack, "key binary, pair bigint, times bigint")
    sums = (
        links.join(counts, "pair")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    return aligned.drop("copies", "pairs", "times").join(sums, "key")


def alignment(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT
) -> DataFrame:
    """One row per document: ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256)``, alike for equal texts.

    A text that is null, empty, or not kept byte for byte by a tokenizer has no tokens:
    zeros, and an empty hash.  Rows repeated in the table count each time.  An empty table
    gives no rows; other columns are not read.  Both files must lie at the same path on
    every executor.
    """
    aligned = written(aligned_texts(docs, path_a, path_b, text_col), "aligned-texts")
    counts = written(pair_counts(aligned, len(Pieces(path_b).pieces)), "pair-counts")
    found = measures(aligned, counts, most_sent)
    ids = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    rows = ids.join(found, "key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "id", number("n_a"), number("n_b"), number("n_groups"), F.coalesce("n_groups", F.lit(0)).cast("bigint").alias("n_links"),
        number("n_best"), number("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
