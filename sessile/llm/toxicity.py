"""Toxicity by the nearest labelled examples.

Examples are TF-IDF vectors over all their words and the stems of their longer
words. A term's weight is raised with how much its examples raise the share of
label 1, so that a few words that speak for the label outweigh a page of plain
ones; no term is left out. A block-max inverted index over the examples finds, for
each text, those of largest cosine exactly: example numbers are cut into blocks,
and each frequent term knows its largest weight in each block. The lists of the
other terms give every example a part of its cosine, the maxima bound the rest, and
each text looks at blocks in order of their bounds until none can beat its k-th best
(many texts at once, so that a block is read once for all that need it). The neighbours vote,
weighted by closeness, and a logistic curve fitted to the examples' own
leave-one-out votes turns the vote into a probability.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm import tokens
from sessile.llm.common import arrow_rows, fold, give_back, table
from sessile.llm.labels import labelled_texts, sample_of_labels

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: The classifier is fitted on at most so many labelled rows; all their terms are used.
EXAMPLES = 8_000
#: Words of more bytes than this give their first ones as a second term.
STEM = 6
#: A term of no lift has this weight, one that always comes with label 1 one more; SHRINK rows of the common share are added to each.
FLOOR, SHRINK = 0.02, 2.0
NEIGHBOURS = 15
BLOCK = 512
#: So many of the most frequent terms have block maxima; the lists of the others are short.
FREQUENT = 512
#: Examples whose terms are handled at once when the index is built.
PART = 500
#: Texts that are looked up at once.
AT_ONCE = 64
#: Cosines count to six digits; the number of an example stands in the lower bits of a key.
DIGITS, NUMBER_BITS = 1e6, 20
#: Neighbours shown as evidence.
SHOWN = 3


def digest(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)


def terms_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct terms as hashes in order, and how often each occurs."""
    encoded = [(t or "").lower().encode() for t in texts]
    for _, chunk in tokens.in_chunks(encoded):
        hashes, counts = tokens.letter_terms(chunk, STEM)
        for part in np.split(hashes, np.cumsum(counts)[:-1]):
            yield np.unique(part, return_counts=True)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, one after the other, and the number of the range of each."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


class Index:
    """Block-max inverted index of unit vectors, with their labels.

    Examples are (id, label, digest, term hashes, counts).
    """

    def __init__(self, examples: list[tuple[object, int, int, np.ndarray, np.ndarray]]) -> None:
        # Several arrays have an entry for each term of each example; what is wide is made in parts, as the driver's memory is small.
        sizes = [len(e[3]) for e in examples]
        owner = np.repeat(np.arange(len(examples), dtype=np.int32), sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        groups = [slice(k, k + PART) for k in range(0, len(examples), PART)]
        self.terms = np.zeros(0, np.uint64)
        for g in groups:
            self.terms = np.union1d(self.terms, np.concatenate([e[3] for e in examples[g]]))
        of, tf = np.empty(len(owner), np.int32), np.empty(len(owner), np.int32)
        labels = np.array([e[1] for e in examples], np.float64)
        self.n, self.share = len(examples), float(labels.mean()) if len(examples) else 0.0
        self.df, self.df1 = np.zeros(len(self.terms)), np.zeros(len(self.terms))
        spans = [slice(ends[g.start], ends[min(g.stop, len(examples))]) for g in groups]
        for g, at in zip(groups, spans, strict=True):
            of[at] = np.searchsorted(self.terms, np.concatenate([e[3] for e in examples[g]]))
            tf[at] = np.concatenate([e[4] for e in examples[g]])
            self.df += np.bincount(of[at], minlength=len(self.terms))
            self.df1 += np.bincount(of[at], labels[owner[at]], minlength=len(self.terms))
        # Examples with like frequent terms stand together, so that blocks differ.
        frequent = np.argsort(-self.df, kind="stable")[:16]
        place = np.full(len(self.terms), 16, np.int8)
        place[frequent] = np.arange(len(frequent))
        has = np.zeros((len(examples), 17), bool)
        has[owner, place[of]] = True
        order = np.lexsort([np.arange(len(examples)), *[~has[:, k] for k in range(15, -1, -1)]])
        number = np.empty(len(examples), np.int32)
        number[order] = np.arange(len(examples), dtype=np.int32)
        self.ids = [examples[i][0] for i in order]
        self.labels = labels[order]
        self.own = {examples[i][2]: int(number[i]) for i in range(len(examples) - 1, -1, -1)}
        by_term, weight = self.weights(self.df, self.df1).astype(np.float32), np.empty(len(owner), np.float32)
        for at in spans:
            weight[at] = (1 + np.log(tf[at].astype(np.float32))) * by_term[of[at]]
            norm = np.sqrt(np.bincount(owner[at], weight[at] ** 2, minlength=len(examples)))
            weight[at] /= np.where(norm > 0, norm, 1).astype(np.float32)[owner[at]]
        del tf
        self.blocks = -(-len(examples) // BLOCK)
        top = np.argsort(-self.df, kind="stable")[:FREQUENT]
        self.slot = np.full(len(self.terms), -1, np.int16)
        self.slot[top] = np.arange(len(top))
        # Weights of the frequent terms in all examples, with block maxima; of the others, lists in order of term and example.
        slot = self.slot[of]
        self.frequent = np.zeros((self.blocks, len(top), BLOCK), np.float32)
        for span in spans:
            at = span.start + np.flatnonzero(slot[span] >= 0)
            self.frequent[number[owner[at]] // BLOCK, slot[at], number[owner[at]] % BLOCK] = weight[at]
        self.most = np.ascontiguousarray(self.frequent.max(axis=2, initial=0).T)
        rare = slot < 0
        self.first = np.concatenate([[0], np.cumsum(np.where(self.slot < 0, self.df, 0))]).astype(np.int32)
        self.example, self.weight = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.float32)
        cuts = np.unique(np.append(np.searchsorted(self.first, np.linspace(0, self.first[-1], 9)), [0, len(self.terms)])).tolist()
        for low, high in itertools.pairwise(cuts):
            at = np.flatnonzero(rare & (of >= low) & (of < high))
            at = at[np.lexsort((number[owner[at]], of[at]))]
            here = slice(self.first[low], self.first[high])
            self.example[here], self.weight[here] = number[owner[at]], weight[at]
        empty = np.array(sizes, np.int64)[order] == 0
        # What to expect of a text that shares no term with any example.
        self.prior = (self.labels[empty].sum() + 0.5 * self.share) / (empty.sum() + 0.5)
        self.slope, self.offset, self.fitted = 1.0, 0.0, False

    def weights(self, df: np.ndarray, df1: np.ndarray) -> np.ndarray:
        """Inverse document frequency times the floor and the lift of label 1."""
        share = (df1 + SHRINK * self.share) / (df + SHRINK)
        lift = np.maximum(share - self.share, 0) / ((1 - self.share) or 1.0)
        return np.log(1 + self.n / np.maximum(df, 1)) * (FLOOR + lift)

    def vector(self, hashes: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and unit weights; for an example, as if it were not among the examples."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        at, counts = at[known], counts[known]
        df, df1 = self.df[at], self.df1[at]
        if without >= 0:
            df, df1 = df - 1, df1 - self.labels[without]
            at, counts, df, df1 = (v[df > 0] for v in (at, counts, df, df1))
        w = (1 + np.log(counts)) * self.weights(df, df1)
        return at, w / (math.sqrt(float(w @ w)) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of each text's k examples of largest cosine, the smaller number first among equals.

        Each text may leave one example out. Where fewer have a cosine above 0, the rest is 0, with number -1.
        """
        m, every = len(vectors), np.arange(len(vectors))
        query, part = np.zeros((m, self.frequent.shape[1])), np.zeros((m, self.blocks * BLOCK))
        for r, (terms, weights) in enumerate(vectors):
            slot = self.slot[terms]
            query[r, slot[slot >= 0]] = weights[slot >= 0]
            rare = terms[slot < 0]
            at, of = _spread(self.first[rare], self.first[rare + 1])
            part[r] = np.bincount(self.example[at], weights[slot < 0][of] * self.weight[at], minlength=part.shape[1])
            if without[r] >= 0:
                part[r, without[r]] = -2.0
        part = part.reshape(m, self.blocks, BLOCK)
        bound = part.max(axis=2, initial=-2) + query @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.zeros((m, k), np.int64)
        for step in range(self.blocks):
            at = order[:, step]
            here = bound[every, at]
            look = (here > 0) & (here * DIGITS + 1 >= best.min(axis=1) >> NUMBER_BITS)
            if not look.any():
                break
            for b in np.unique(at[look]).tolist():
                rows = np.flatnonzero(look & (at == b))
                cosines = np.rint((part[rows, b] + query[rows] @ self.frequent[b].astype(np.float64)) * DIGITS).astype(np.int64)
                key = (cosines << NUMBER_BITS) + ((1 << NUMBER_BITS) - 1 - b * BLOCK - np.arange(BLOCK))
                best[rows] = np.partition(np.concatenate([best[rows], np.where(cosines > 0, key, 0)], axis=1), -k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        return (best >> NUMBER_BITS) / DIGITS, np.where(best > 0, (1 << NUMBER_BITS) - 1 - (best & (1 << NUMBER_BITS) - 1), -1)

    def votes(self, cosines: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Mean labels of neighbours, weighted by 1 / (distance + 0.1); missing neighbours vote as the prior, at distance 1."""
        w = 1 / (1.1 - cosines)
        return (w * np.where(near >= 0, np.append(self.labels, 0.0)[near], self.prior)).sum(axis=1) / w.sum(axis=1)

    def looked_up(self, texts: list[tuple[np.ndarray, np.ndarray]], own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, cosines and neighbours of texts given by their terms and counts; own examples are left out."""
        out = []
        for a in range(0, len(texts), AT_ONCE):
            part = own[a : a + AT_ONCE]
            out.append(self.nearest([self.vector(*t, without=i) for t, i in zip(texts[a : a + AT_ONCE], part, strict=True)], part))
        cosines, near = (np.concatenate([o[c] for o in out]) if out else np.zeros((0, NEIGHBOURS), kind) for c, kind in enumerate((np.float64, np.int64)))
        return self.votes(cosines, near), cosines, near

    def calibrate(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit the logistic curve to leave-one-out votes of the examples (by number), by Newton steps with a small ridge."""
        if not 0 < self.labels.sum() < len(self.labels):
            return
        votes = self.looked_up(texts, list(range(len(texts))))[0]
        x = np.stack([votes, np.ones(len(votes))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (self.labels - p) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        if w[0] > 0:
            self.slope, self.offset, self.fitted = float(w[0]), float(w[1]), True

    def scores(self, digests: list[int], texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of label 1, and the neighbours. A text that is an example does not meet itself, nor its own label."""
        votes, cosines, near = self.looked_up(texts, [self.own.get(d, -1) for d in digests])
        return (1 / (1 + np.exp(-self.slope * votes - self.offset)) if self.fitted else votes), cosines, near


def example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = list(terms_of(texts))
        lists = [pa.array([f[0].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([digest(t) for t in texts], pa.int64()), *lists], ["doc_id", "y", "digest", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Learn weights, examples and the curve from a bounded sample outside the held-out fold."""
    sample = sample_of_labels(labels, "toxic", FOLDS, HELD_OUT, EXAMPLES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = arrow_rows(labelled_texts(docs, sample)).mapInArrow(example_batches, f"doc_id {kind}, y int, digest long, terms array<long>, counts array<int>").toArrow()
    lists = [[x.values.to_numpy() for x in got.column(c)] for c in ("terms", "counts")]
    examples = []
    ids, ys, digests = (got.column(c).to_pylist() for c in ("doc_id", "y", "digest"))
    for k, v in enumerate(zip(ids, ys, digests, strict=True)):
        examples.append((*v, lists[0][k].view(np.uint64), lists[1][k]))
    examples.sort(key=lambda e: e[0])
    index = Index(examples)
    by_id = {e[0]: e[3:] for e in examples}
    index.calibrate([by_id[i] for i in index.ids])
    del got, lists, examples, by_id
    give_back()
    return index


def score_batches(sent: Broadcast[Index], names: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            told, cosines, near = index.scores([digest(t) for t in texts], list(terms_of(texts)))
            scores = pa.array(told, pa.float64())
            evidence = [[{"doc_id": str(index.ids[i]), "similarity": s, "label": int(index.labels[i])} for s, i in zip(c, n, strict=True) if i >= 0] for c, n in zip(cosines[:, :SHOWN].tolist(), near[:, :SHOWN].tolist(), strict=True)]
            kind = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, pa.array(evidence, kind)], [*batch.schema.names, *names])

    return run


def scored(docs: DataFrame, index: Index, score: str = "_score", evidence: str = "_evidence") -> DataFrame:
    """The documents with two more columns: the score, and the nearest examples (doc_id, similarity, label)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    # In the function itself it would be in each worker twice, as bytes and as arrays.
    sent = docs.sparkSession.sparkContext.broadcast(index)
    return arrow_rows(docs).mapInArrow(score_batches(sent, (score, evidence)), f"{fields}, `{score}` double, `{evidence}` array<struct<doc_id:string,similarity:double,label:int>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence.

    Whole texts are scored; null and empty texts, and texts without a known term, get
    the score of a text that is like no example. Labels of the held-out fold, and of
    ids without a document, are not used; of an id with several texts the least is the
    example. Without any labels, or with one class only, the score is the share of
    label 1. Rows that repeat each give a row; other columns are ignored.
    """
    index = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), index)
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
