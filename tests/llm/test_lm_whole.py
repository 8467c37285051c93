"""The language model against plain loops: probabilities, updates, gradients and growth."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from sessile.llm import maxent, tokens

TEXTS = [
    (1, "the cat sat on the mat and the cat ran"),
    (2, "The dog sat on the log and THE dog ran far away"),
    (3, "the cat sat on the mat and the cat ran"),
    (4, None),
    (5, ""),
    (6, "a fog lay on the lake and the boats were still"),
    (None, "\u00fcber allen gipfeln ist ruh"),
    (7, "the boats ran far"),
]


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def numbers(lexicon, word):
    """Class, bucket, head and rank of a word, or of the end."""
    if word is None:
        return lexicon.sizes.own_classes, None, None, -1
    h, _, e = tokens.words_and_ends([word])
    c, b, head, rank = lexicon.numbers(h, (e & np.uint64(0xFFFF)).astype(np.int64))
    return int(c[0]), int(b[0]), int(head[0]), int(rank[0])


class Plain:
    """The model's class weights, and everything else from counts by plain loops."""

    def __init__(self, model, texts):
        self.model, self.sizes = model, model.lexicon.sizes
        self.count = collections.Counter(w for t in texts for w in [*words_of(t), None])
        self.members = collections.defaultdict(list)
        for w in self.count:
            self.members[numbers(model.lexicon, w)[0]].append(w)
        n, total = collections.Counter(), collections.Counter()
        for t in texts:
            head = 0
            for w in words_of(t):
                c, _, following, rank = numbers(model.lexicon, w)
                if c > self.sizes.own_classes:
                    total[head, c] += 1
                    n[head, c, w] += rank >= 0
                head = following
        n = {k: v for k, v in n.items() if v >= maxent.LEAST_SEEN}
        self.weights = {}
        for (head, c, w), k in n.items():
            bare = 1 + sum(self.count[x] + 1 for x in self.members[c])
            self.weights[head, c, w] = math.log((k + maxent.PRIOR) / (total[head, c] / bare * (self.count[w] + 1) + maxent.PRIOR))
        for _ in range(maxent.PAIR_UPDATES):
            new = {}
            for (head, c, w), k in n.items():
                expected = total[head, c] * (self.count[w] + 1) * math.exp(self.weights[head, c, w]) / self.below(head, c)
                new[head, c, w] = self.weights[head, c, w] + (k - expected - maxent.PRIOR * self.weights[head, c, w]) / (max(k, expected) + maxent.PRIOR)
            self.weights = new
        self.n, self.total = n, total

    def below(self, head, c):
        return 1 + sum((self.count[w] + 1) * math.exp(self.weights.get((head, c, w), 0.0)) for w in self.members[c])

    def by_class(self, one, two):
        s = self.sizes
        rows = maxent.context_rows(np.array([one * s.buckets + two]), s)[0]
        z = [sum(self.model.weights[r, c] for r in rows) for c in range(s.classes)]
        most = max(z)
        below = sum(math.exp(x - most) for x in z)
        return [math.exp(x - most) / below for x in z]

    def within(self, head, c, w):
        return (self.count[w] + 1) * math.exp(self.weights.get((head, c, w), 0.0)) / self.below(head, c)

    def score(self, text):
        one = two = head = 0
        out = 0.0
        for w in [*words_of(text), None]:
            c, b, following, _ = numbers(self.model.lexicon, w)
            out += math.log10(self.by_class(one, two)[c]) + math.log10(self.within(head, c, w))
            one, two, head = b, one, following
        return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.mark.parametrize("frequent", [500_000, 3, 0])
def test_scores_equal_plain_loops(docs, frequent, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT_PAIRS", frequent)
    # Few words of their own, so that groups hold several.
    monkeypatch.setattr(maxent.Sizes, "of", classmethod(lambda cls, _: cls(16, 8, 16)))
    kept = []
    fit = maxent.fit
    monkeypatch.setattr(maxent, "fit", lambda d: kept.append(fit(d)) or kept[0])
    got = maxent.score(docs, docs).collect()
    plain = Plain(kept[0][0], [t for _, t in TEXTS])
    assert len(plain.n) > 5 and len(kept[0][0].pair_keys) <= frequent
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == sorted((str(i), round(plain.score(t), 4)) for i, t in TEXTS)
    # Known words take all of each context but what is left for an unknown word of each class.
    for one, two, head in ((0, 0, 0), (1, 0, 1), (3, 2, 5)):
        p = plain.by_class(one, two)
        assert math.isclose(sum(p[c] * (sum(plain.within(head, c, w) for w in plain.members[c]) + 1 / plain.below(head, c)) for c in range(plain.sizes.classes)), 1)


def test_pair_updates_end_where_the_gradient_is_null():
    n, base, cell = np.array([5.0, 1, 9, 2]), np.array([10.0, 3, 10, 40]), np.array([0, 0, 1, 1])
    totals, bare = np.array([8.0, 12])[cell], np.array([100.0, 80])[cell]
    below = []
    for _ in range(60):
        weights = maxent.pair_weights(n, base, totals, bare, below)
        below.append(bare + np.bincount(cell, base * np.expm1(weights), 2)[cell])
    expected = totals / below[-1] * base * np.exp(weights)
    assert np.abs(n - expected - maxent.PRIOR * weights).max() < 1e-6
    assert weights[2] > 0 > weights[3]


def test_class_gradient_equals_finite_differences():
    sizes = maxent.Sizes(8, 4, 8)
    rng = np.random.default_rng(1)
    cells = [{"context": int(k), "cells": [{"class": c, "n": int(rng.integers(1, 9))} for c in range(4) if rng.random() < 0.8]} for k in (0, 9, 10, 63)]
    batch = pa.RecordBatch.from_pylist(cells, pa.schema([("context", pa.int64()), ("cells", pa.list_(pa.struct([("class", pa.int64()), ("n", pa.int64())])))]))

    def run(weights):
        out = next(maxent.gradient_batches(weights, sizes)(iter([batch])))
        return np.frombuffer(out["sums"][0].as_py(), "<f4").reshape(sizes.rows, 4).astype(float), out["likelihood"][0].as_py()

    w = rng.normal(size=(sizes.rows, 4))
    gradient = run(None)[0] - run(w)[0]
    for row in {int(r) for r in maxent.context_rows(np.array([0, 9, 63]), sizes).ravel()}:
        for c in range(4):
            step = np.zeros_like(w)
            step[row, c] = 1e-5
            assert math.isclose((run(w + step)[1] - run(w - step)[1]) / 2e-5, gradient[row, c], abs_tol=1e-3)


def test_sizes_follow_the_vocabulary_within_the_bound():
    sizes = [maxent.Sizes.of(v) for v in (0, 10**3, 10**5, 10**8, 10**9, 10**12)]
    for a, b in zip(sizes[1:3], sizes[2:4], strict=True):
        assert a.buckets < b.buckets and a.classes < b.classes and a.heads < b.heads, (a, b)
    assert all(max(s.rows, s.heads) * s.classes <= maxent.TABLE_CELLS for s in sizes)


def test_pairs_grow_with_the_text(spark):
    def pairs(n):
        rows = [(i, " ".join(f"w{(i // 2 * 7 + k * k) % (3 * n)}" for k in range(20))) for i in range(n)]
        return maxent.fit(spark.createDataFrame(rows, "doc_id long, text string"))[0].pair_keys.size

    assert pairs(200) > 1.8 * pairs(100) > 0


def test_longer_histories_raise_the_likelihood(docs):
    """A word that follows another one always is likelier after it than its count says."""
    got = {r.doc_id: r for r in maxent.score(docs, docs).collect()}
    assert got[1].score > got[1].base_score and got[1].score == got[3].score
