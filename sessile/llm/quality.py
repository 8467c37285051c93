"""Quality by pairwise ranking (Bradley-Terry).

A text's score is a sum of weights, one for the quantile bin of each of its
features. The weights are learned from pairs of labelled texts, one preferred to
the other, by logistic loss on the difference of their features. A quantile of the
scores, at the share of texts that are not preferred, is the threshold; a logistic
curve around it gives values from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm import tokens
from sessile.llm.common import arrow_rows, fold, table
from sessile.llm.labels import labelled_texts, sample_of_labels

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The ranking is learned on at most so many labelled rows and so many pairs for each row of the rarer class.
EXAMPLES, PAIRS = 20_000, 20
BINS = 10

NAMES = (
    "words", "bytes", "word_length", "upper", "digit", "space", "high", "stop", "comma", "shout", "mark", "bar", "bracket", "quote", "other", "distinct_words", "top_word", "distinct_runs",
    "lines", "line_length", "distinct_lines", "ended_words", "ended_lines",
)

_CLASS = np.full(256, 10, np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", bytes(range(128, 256)), b".;:?", b",", b"!", b"#$%&*@^~", b"|_=<>/\\+-")):
    _CLASS[list(_set)] = _i
_CLASS[list(b"()[]{}")] = 11
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?#$%&*")] = True
_CLASS[list(b"\"'`")] = 12


def features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; a text without words has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for start, chunk in tokens.in_chunks(texts):
        words, counts = tokens.word_hashes(chunk)
        ends = np.cumsum(counts)
        for i, (text, n, end) in enumerate(zip(chunk, counts.tolist(), ends.tolist(), strict=True), start):
            if not n:
                continue
            raw = np.frombuffer(text, np.uint8)
            kind = _CLASS[raw]
            kinds = np.bincount(kind, minlength=13) / len(raw)
            letters = kinds[0] + kinds[1] + kinds[4] or 1.0
            own = words[end - n : end]
            _, each = np.unique(own, return_counts=True)
            runs = own[: n - 2] * np.uint64(3) ^ own[1 : n - 1] * np.uint64(5) ^ own[2:] if n > 2 else own
            lines = text.splitlines() or [text]
            space = kind == 3
            ended = np.count_nonzero(_ENDS[raw[~space & np.append(space[1:], True)]]) / n
            out[i] = (
                np.log1p(n), np.log1p(len(raw)), len(raw) / n, kinds[1] / letters, kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], kinds[11], kinds[12], kinds[10],
                len(each) / n, each.max() / n, len(np.unique(runs)) / len(runs), np.log1p(len(lines)), len(raw) / len(lines), len(set(lines)) / len(lines), ended,
                sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
            )
    return out


@dataclass
class Ranking:
    """Bin edges of each feature, the weights of its bins, and the curve from ranks to values."""

    edges: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def ranks(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the threshold."""
        z = self.slope * (self.ranks(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> Ranking:
    """Gradient steps (with momentum) on the mean logistic loss of pairs, preferred minus other."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(NAMES), BINS - 1))
    model = Ranking(edges, np.zeros((len(NAMES), BINS)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(7)
    rare, other = (good, bad) if len(good) < len(bad) else (bad, good)
    # Each row of the rarer class meets PAIRS others, and each of the others is met about as often.
    n = max(PAIRS * len(rare), len(other))
    first = np.resize(rng.permutation(rare), n)
    second = np.concatenate([rng.permutation(other) for _ in range(-(-n // len(other)))])[:n]
    win, lose = (first, second) if rare is good else (second, first)
    hot = model.bins(x) + np.arange(len(NAMES)) * BINS
    size = len(NAMES) * BINS
    w, speed = np.zeros(size), np.zeros(size)
    for _ in range(steps):
        ranks = w[hot].sum(axis=1)
        push = 1 / (1 + np.exp(ranks[win] - ranks[lose])) / n
        row = np.bincount(win, push, len(x)) - np.bincount(lose, push, len(x))
        slope = np.bincount(hot.ravel(), np.repeat(row, len(NAMES)), size) - ridge * w
        speed = 0.9 * speed + slope
        w += rate * speed
    model.weights = w.reshape(len(NAMES), BINS)
    ranks = model.ranks(x)
    model.threshold = float(np.quantile(ranks, (y == 0).mean()))
    # The slope that fits the labels best with THRESHOLD at the threshold.
    slopes = np.geomspace(0.05, 20, 60)
    z = (ranks - model.threshold)[:, None] * slopes + np.log(THRESHOLD / (1 - THRESHOLD))
    model.slope = float(slopes[np.argmin(np.logaddexp(0, np.where(y[:, None] == 1, -z, z)).mean(axis=0))])
    return model


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Learn from a bounded sample outside the held-out fold: a row of features for each labelled text."""
    sample = sample_of_labels(labels, "quality", FOLDS, HELD_OUT, EXAMPLES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow_rows(labelled_texts(docs, sample).select("doc_id", "y", "text")).mapInArrow(feature_batches, f"doc_id {kind}, y int, x array<double>").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    return learn(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows]))


def score_batches(model: Ranking) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            score, rank = (model.score(x), model.ranks(x)) if len(x) else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(rank)], ["doc_id", "score", "rank"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, rank (the ranking's own scale).

    Whole texts are scored; null and empty texts get the score of a text without
    words. Labels of the held-out fold are not read. With one class only, or none,
    all texts score alike, at the threshold. Rows that repeat each give a row; other
    columns are ignored.
    """
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_rows(docs.select("doc_id", "text")).mapInArrow(score_batches(model), f"doc_id {kind}, score double, rank double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "rank")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
