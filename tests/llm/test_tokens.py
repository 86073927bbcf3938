"""Token ids: equality with the tokenizer, the file's operations, and the table of documents."""

import random
import zlib

import numpy as np
import pytest
from cases import TABLES
from tokenizers import Tokenizer

from calllens.llm import wavelet
from calllens.llm.queries import END_ID, tokenizer_path
from calllens.llm.store import scratch


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_word_by_word_equals_whole_texts(spark, small, tokenizer):
    encoder = wavelet.Encoder(tokenizer_path(), END_ID, most=50)
    rng = random.Random(5)
    odd = "ab'.,1é́ ‍ ΣİAs\n\t<|>$%*_ ßſ！３"
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    texts += ["<|ENDOFTEXT|>", "<|StartOfText|>", "a<|ENDoftext|>b", "<|endoftext|>", "AB<|endoftext|>CD", "É<|ENDOFTEXT|>, X. <|", "ÀÉÞ×÷ß. ÿ,"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "A", "é", " ", "É.", ",."]) for _ in range(6)) for _ in range(300)]
    texts += ["", " ", "<|endoftext|>. x<|startoftext|>,", "don't I'LL 'tis a.b,c 3.14 ... .,"]
    texts += ["".join(rng.choice(odd) for _ in range(50)) for _ in range(400)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids + [END_ID]
        assert encoder.text(text.encode()).tolist() == want, repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_wavelet_file(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint16)
    held = wavelet.WaveletFile(wavelet.pack(ids, [5, None], [n, 0]))
    assert held.ids().tolist() == ids.tolist() and held.doc_ids == [5, None] and held.lengths.tolist() == [n, 0]
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert held.access(i) == ids[i]
    for token in {*ids[:10].tolist(), 49_407}:
        places = np.flatnonzero(ids == token)
        assert held.count(token) == len(places)
        assert held.count(token, n // 3, n) == (places >= n // 3).sum()
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert held.find(token, k) == places[k]
        with pytest.raises(IndexError):
            held.find(token, len(places))
    with pytest.raises(IndexError):
        held.access(n)


def expected(rows, tokenizer):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for i, text, _ in ordered:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard", [10, 1 << 20])
def test_table_of_documents(spark, odd, tokenizer, shard):
    got = wavelet.token_table(odd, tokenizer_path(), end_id=END_ID, shard_tokens=shard).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(TABLES["rows"], tokenizer)


def test_empty_table(none):
    assert wavelet.token_table(none, tokenizer_path()).count() == 0


def test_occurrences_across_files(spark, odd, tokenizer):
    folder = scratch(spark, "tokens")
    wavelet.write_tokens(odd, folder, tokenizer_path(), shard_tokens=10).collect()
    got = {}
    for r in wavelet.occurrences(spark, folder, [END_ID, 49_000]).collect():
        got[r.token] = got.get(r.token, 0) + r.n
    assert got[END_ID] == len(TABLES["rows"])


def test_registered_query(spark, small, tokenizer):
    from calllens.llm.queries import QUERIES

    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op5_token_ids"](spark, small).collect()))
    assert got == sorted(expected(docs, tokenizer))
