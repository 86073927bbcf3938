"""Alignment of two tokenizers against a plain version that encodes every text by itself."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from calllens.llm import align
from calllens.llm.queries import QUERIES, table, tokenizer_path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_letters():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    """Both libraries on whole texts, and groups by the sets of ends."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def tokens(self, text):
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def groups(self, text):
        """``[(ids of A, ids of B)]`` in order, or None."""
        if not text:
            return None
        a, b = self.tokens(text)
        whole = (" " + text).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            return None

        def ends(tokens):
            at, out = 0, {}
            for i, t in tokens:
                at += len(t)
                out[at] = i
            return out

        ends_a, ends_b = ends(a), ends(b)
        out, held = [], ([], [])
        for at in sorted({*ends_a, *ends_b}):
            if at in ends_a:
                held[0].append(ends_a[at])
            if at in ends_b:
                held[1].append(ends_b[at])
            if at in ends_a and at in ends_b:
                out.append(held)
                held = ([], [])
        return out

    def rows(self, texts):
        groups = [self.groups(t) for t in texts]
        counts = Counter((g[0][-1], g[1][-1]) for found in groups for g in found or [])
        top = defaultdict(int)
        for (_, b), n in counts.items():
            top[b] = max(top[b], n)
        for found in groups:
            if found is None:
                yield (0,) * 6 + ("",)
                continue
            links = [counts[g[0][-1], g[1][-1]] for g in found]
            best = sum(counts[g[0][-1], g[1][-1]] == top[g[1][-1]] for g in found)
            shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
            yield (
                sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(found), best, sum(links),
                hashlib.sha256(shown.encode()).hexdigest(),
            )


@pytest.fixture(scope="module")
def plain():
    return Plain()


def compare(got, docs, plain):
    expected = Counter(zip([d for d, _ in docs], plain.rows([t for _, t in docs])))
    assert Counter((r.id, tuple(r[c] for c in COLUMNS)) for r in got.collect()) == expected


@pytest.mark.parametrize("most_sent", [align.MOST_SENT, 3])
def test_small_table(spark, small, plain, most_sent):
    docs = table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(align.alignment(docs, *PATHS, most_sent=most_sent), rows, plain)


@pytest.mark.parametrize("most_sent", [align.MOST_SENT, 3])
def test_odd_rows(spark, odd, none, plain, most_sent):
    more = [
        (20, "▁ is a block"), (21, "<|endoftext|> </s> <s> <unk> <0x41>"), (22, "tab\there and　there"), (23, " "),
        (24, "日本語 ไทย \U0001f600‍ é ﬁ"), (25, "a\x00b"), (25, "a\x00b"), (26, " " * 5000 + "x"),
        (27, "y" * 30_000), (28, "it's they'LL we've 12 345\r\n\r\n  end  "),
    ]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(align.alignment(docs, *PATHS, most_sent=most_sent), rows, plain)
    assert align.alignment(none, *PATHS, most_sent=most_sent).collect() == []


def test_counts_are_passed_on_in_parts(spark, small, plain, monkeypatch):
    monkeypatch.setattr(align, "HELD", 50)
    docs = table(spark, small, "documents").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(align.alignment(spark.createDataFrame(rows, "doc_id bigint, text string"), *PATHS), rows, plain)


def test_byte_level_ids_equal_the_library():
    ours, theirs = align.ByteLevel(PATHS[0]), Tokenizer.from_file(PATHS[0])
    theirs.encode_special_tokens = True
    assert ours.quick
    draw = random.Random(5)
    pool = [chr(c) for c in range(0x370)] + [chr(c) for c in range(0x2000, 0x2070)] + list(" \n\t'sdtmre.,<|endoftext|>") * 20
    pool += [chr(c) for c in draw.sample(range(0x370, 0xD800), 300)]
    texts = ["".join(draw.choices(pool, k=draw.randrange(60))) for _ in range(5000)] + [" " * 1_000_000, "\n " * 1000]
    for text in texts:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_one_text_in_a_third_of_the_rows(spark, plain):
    rows = [(i, "the same text" if i % 3 else f"text {i} here") for i in range(300)]
    compare(align.alignment(spark.createDataFrame(rows, "doc_id bigint, text string"), *PATHS), rows, plain)


def test_registered(spark, small):
    got = QUERIES["op13_token_alignment"](spark, small)
    assert got.columns == ["doc_id", *COLUMNS]
