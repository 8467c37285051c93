"""What the stages of the pipeline leave in the memory of executors and their workers."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark import SparkContext, cloudpickle

from sessile.llm import common, exact_dedup, pieces, tokens, toxicity


@pytest.fixture
def words():
    return [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(k, k + 400)) for k in range(0, 100_000, 50)]


def test_the_index_of_toxicity_is_not_in_the_function(spark, monkeypatch):
    rng = np.random.default_rng(7)
    index = toxicity.Index([(k, k % 2, k, np.unique(rng.integers(0, 2**63, 500, np.uint64)), np.ones(500, np.int32)) for k in range(600)])
    index.calibrate([(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 600)
    sent, plain = [], common.ArrowRows.mapInArrow

    def caught(self, function, schema):
        sent.append(len(cloudpickle.dumps(function)))
        return plain(self, function, schema)

    monkeypatch.setattr(common.ArrowRows, "mapInArrow", caught)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r._score for r in toxicity.scored(docs, index).collect()}
    told = index.scores([toxicity.digest(t) for t in ("some words", None)], list(toxicity.terms_of(["some words", None])))[0]
    assert got == {1: told[0], 2: told[1]}
    assert len(cloudpickle.dumps(index)) > 2_000_000 and sent[0] < 100_000, sent


def test_exact_dedup_starts_no_python_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(3, "a b"), (1, "a  b"), (2, None)], "doc_id long, text string").localCheckpoint()

    def refused(*args, **named):
        raise AssertionError("a list from Python goes through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs).collect()) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]


def test_terms_need_little_memory(words, monkeypatch):
    now = list(toxicity.terms_of(words))
    tracemalloc.start()
    try:
        for _ in toxicity.terms_of(words[:1000]):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(tokens, "CHUNK", 1 << 20)
    before = list(toxicity.terms_of(words))
    assert len(now) == len(before) and all(np.array_equal(a, b) for x, y in zip(now, before, strict=True) for a, b in zip(x, y, strict=True))
    assert most < 12 << 20, most


def test_remembered_parts_are_plain_strings():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.MergeModel(f.read())
    texts = ["▁a ▁ b  c▁", " ", "▁", "  two  spaces, marks▁and é 漢字\n\n x", "", "tab\tand ▁▁ marks"]
    ids, back = model.encode(texts)
    for text, own, decoded in zip(texts, ids, back, strict=True):
        theirs = model.library.encode(text, add_eos=True)
        assert np.frombuffer(own, "<i4").tolist() == theirs and decoded.decode() == model.library.decode(theirs)
    assert all(p.isascii() for p in model.recent if not set(p) & set("é漢字")), list(model.recent)
