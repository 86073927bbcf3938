"""The stages of the pipeline, each against a plain version over its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_near import groups
from test_llm_text import contaminated_by_hand, targets_by_hand
from test_tokens import expected
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from calllens.llm import toxicity
from calllens.llm.queries import tokenizer_path
from calllens.llm.store import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF), "steps")
        out[name] = docs, result
        docs = result
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_pass_documents_on(spark, steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(steps[n][1].columns == columns for n in names[:-1])
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry_module.oracle_sql()


def test_toxic_documents_go(spark, steps):
    docs, kept = steps["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score(docs, model).collect()
    assert ids(kept) == sorted(r.id for r in scores if r.score < 0.5) and kept.count() < docs.count()


def test_one_document_of_each_group_stays(steps):
    docs, kept = steps["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(kept) == sorted({c for _, _, c in groups(rows)})


def test_contaminated_documents_go(spark, steps):
    docs, kept = steps["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = contaminated_by_hand([(r.doc_id, r.text) for r in docs.collect()], items)
    assert ids(kept) == sorted(doc for doc, _, hit, _, _ in found if not hit)


def test_sources_come_near_their_targets(steps):
    docs, mixed = steps["mixing"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    own, taken, largest = Counter(), Counter(), Counter()
    for doc, n in size.items():
        own[source[doc]] += n
        largest[source[doc]] = max(largest[source[doc]], n)
    copies = Counter(ids(mixed))
    assert max(copies.values()) <= 3
    for doc, n in copies.items():
        taken[source[doc]] += n * size[doc]
    for name, target in targets_by_hand(own).items():
        assert abs(taken[name] - target) <= largest[name]


def test_tokens_of_the_mix(steps):
    docs, tokens = steps["token_ids"]
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    want = expected(rows, Tokenizer.from_file(tokenizer_path()))
    assert sorted(map(tuple, tokens.collect()), key=lambda r: r[1]) == want


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps["token_ids"][1].collect()))
