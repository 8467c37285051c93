"""Languages by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. Two recurrent layers run through a window,
one from each end; at each byte their states give a probability for each language, so
every position is labelled. A document's probabilities are the means of those of its
positions. The network is trained in numpy by backpropagation through time on windows
of a bounded sample of texts, and scores whole texts, many windows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm.common import arrow_rows, fold, give_back, hash60, table

FOLDS, HELD_OUT = 4, 2
#: The network is trained on at most so many texts, each with so many windows spread over its whole length.
EXAMPLES, WINDOWS = 4_000, 6
WINDOW, STATES = 64, 8
STEPS, BATCH, RATE = 300, 192, 0.02
#: Windows that are scored at once: their states fit a core's cache.
TOGETHER = 2_048
#: Stands for a byte beyond the end of a text.
PAD = 256
UNKNOWN = "und"


def logistic(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Layer:
    """One direction: what each byte adds to the gates (update, reset, new), what the state adds, a constant."""

    of_byte: np.ndarray
    of_state: np.ndarray
    base: np.ndarray

    def run(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """States, a window a column, after each row of x (positions x windows). keep: gets what the gradient needs."""
        n = self.of_state.shape[1]
        from_byte = np.ascontiguousarray((self.of_byte + self.base).T)
        h = np.zeros((n, x.shape[1]), from_byte.dtype)
        gate, add = np.empty((3 * n, x.shape[1]), h.dtype), np.empty((3 * n, x.shape[1]), h.dtype)
        for codes in x:
            if keep is not None:
                gate, add = np.empty_like(gate), np.empty_like(add)
            np.take(from_byte, codes, axis=1, out=gate, mode="clip")
            np.matmul(self.of_state, h, out=add)
            zr, new, inner = gate[: 2 * n], gate[2 * n :], add[2 * n :]
            zr += add[: 2 * n]
            logistic(zr)
            z, r = zr[:n], zr[n:]
            new += r * inner
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, inner, new))
            h = h - new
            h *= z
            h += new
            yield h

    def slopes(self, x: np.ndarray, kept: list, push: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of the three arrays, backwards through the rows of x. push: of the loss by each state."""
        state, carry, adds = np.zeros_like(self.of_state), 0.0, []
        for t in range(len(x) - 1, -1, -1):
            h, z, r, inner, new = kept[t]
            d = push[t] + carry
            d_new = d * (1 - z) * (1 - new * new)
            d_zr = np.concatenate([d * (h - new) * z * (1 - z), d_new * inner * r * (1 - r)])
            d_state = np.concatenate([d_zr, d_new * r])
            carry = d * z + self.of_state.T @ d_state
            state += d_state @ h.T
            adds.append(np.concatenate([d_zr, d_new]))
        codes = x[::-1].ravel()
        of_byte = np.stack([np.bincount(codes, row, len(self.of_byte)) for row in np.concatenate(adds, axis=1)], 1)
        return [of_byte, state, of_byte.sum(axis=0)]


@dataclass
class Network:
    languages: list[str]
    layers: list[Layer]
    outs: list[np.ndarray]  # from the states of each layer to languages
    base: np.ndarray

    @staticmethod
    def start(languages: list[str], kind: type = np.float64) -> Network:
        rng = np.random.default_rng(11)
        layers = [Layer(np.zeros((PAD + 1, 3 * STATES), kind), rng.normal(0, STATES**-0.5, (3 * STATES, STATES)).astype(kind), rng.normal(0, 0.3, 3 * STATES).astype(kind)) for _ in (0, 1)]
        return Network(languages, layers, [rng.normal(0, 0.3, (len(languages), STATES)).astype(kind) for _ in (0, 1)], np.zeros(len(languages), kind))

    def arrays(self) -> list[np.ndarray]:
        return [a for x in self.layers for a in (x.of_byte, x.of_state, x.base)] + [*self.outs, self.base]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the positions of windows x (positions x windows) with languages y, and its gradient by each of arrays()."""
        flipped, kept = x[::-1], ([], [])
        states = [list(layer.run(side, keep)) for layer, side, keep in zip(self.layers, (x, flipped), kept, strict=True)]
        states[1].reverse()  # by position
        inside, total = x != PAD, max(1, np.count_nonzero(x != PAD))
        cost, d_outs, d_base, push = 0.0, [np.zeros_like(o) for o in self.outs], np.zeros_like(self.base), ([], [])
        columns = np.arange(x.shape[1])
        for t in range(len(x)):
            p = self.outs[0] @ states[0][t] + self.outs[1] @ states[1][t] + self.base[:, None]
            p = np.exp(p - p.max(axis=0))
            p /= p.sum(axis=0)
            weight = inside[t] / total
            cost -= float(weight @ np.log(np.maximum(p[y, columns], 1e-30)))
            p[y, columns] -= 1
            p *= weight
            d_base += p.sum(axis=1)
            for k in (0, 1):
                d_outs[k] += p @ states[k][t].T
                push[k].append(self.outs[k].T @ p)
        push[1].reverse()
        slopes = [s for layer, side, keep, d in zip(self.layers, (x, flipped), kept, push, strict=True) for s in layer.slopes(side, keep, d)]
        return cost, [*slopes, *d_outs, d_base]

    def single(self) -> Network:
        """In single precision, for scoring."""
        layers = [Layer(*[a.astype(np.float32) for a in (x.of_byte, x.of_state, x.base)]) for x in self.layers]
        return Network(self.languages, layers, [o.astype(np.float32) for o in self.outs], self.base.astype(np.float32))

    def positions(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of x (positions x windows), the last one first: probabilities, languages x windows."""
        ahead = [self.outs[0] @ h for h in self.layers[0].run(x)]
        for t, h in zip(range(len(x) - 1, -1, -1), self.layers[1].run(x[::-1]), strict=True):
            z = self.outs[1] @ h
            z += ahead[t]
            z += self.base[:, None]
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            yield t, z

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean probabilities of its bytes, and how many bytes each language labels."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        ends = np.cumsum(counts)
        all_p, all_n = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), len(self.languages)), np.int64)
        if not counts.sum():
            return all_p, all_n
        flat = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = starts[owner] + (np.arange(len(owner)) - (ends - counts)[owner]) * WINDOW
        length = np.minimum(WINDOW, (starts + sizes)[owner] - begin)
        for k in range(0, len(owner), TOGETHER):
            part = slice(k, k + TOGETHER)
            step = np.arange(WINDOW)[:, None]
            inside = step < length[part]
            x = np.where(inside, flat[np.minimum(begin[part] + step, len(flat) - 1)].astype(np.int64), PAD)
            p_sum, n_sum = np.zeros((len(self.languages), x.shape[1]), np.float32), np.zeros((len(self.languages), x.shape[1]), np.int32)
            for t, p in self.positions(x):
                p *= inside[t]
                p_sum += p
                n_sum += (p == p.max(axis=0)) & inside[t]
            for k2 in range(len(self.languages)):
                all_p[:, k2] += np.bincount(owner[part], p_sum[k2], len(texts))
                all_n[:, k2] += np.bincount(owner[part], n_sum[k2], len(texts)).astype(np.int64)
        return all_p / np.maximum(sizes, 1)[:, None], all_n


def windows_of(text: bytes) -> list[bytes]:
    """At most WINDOWS windows of a text, spread evenly from its first byte to its last."""
    n = -(-len(text) // WINDOW)
    picked = sorted({round(k * (n - 1) / (WINDOWS - 1)) for k in range(WINDOWS)}) if n > 1 else range(n)
    return [text[k * WINDOW : (k + 1) * WINDOW] for k in picked]


def learn(windows: list[bytes], languages: list[str], steps: int = STEPS) -> Network:
    """Adam steps on shuffled batches of windows; languages: of each window. One language or none needs no steps."""
    names = sorted(set(languages))
    net = Network.start(names)
    if len(names) < 2:
        return net.single()
    padded = np.full((len(windows), WINDOW), PAD, np.int16)
    for i, w in enumerate(windows):
        padded[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.searchsorted(names, languages)
    arrays = net.arrays()
    mean, square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    rng, order = np.random.default_rng(5), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < min(BATCH, len(y)):
            order = np.concatenate([order, rng.permutation(len(y))])
        take, order = order[:BATCH], order[BATCH:]
        _, slopes = net.loss(padded[take].T.astype(np.int64), y[take])
        norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        rate = RATE * min(1.0, step / 20, 2 * (1 - (step - 1) / steps))
        for a, s, m, v in zip(arrays, slopes, mean, square, strict=True):
            s *= min(1.0, 1 / max(norm, 1e-12))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net.single()


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([windows_of(t) for t in texts], pa.list_(pa.binary()))], ["doc_id", "lang", "windows"])


def fit(docs: DataFrame) -> Network:
    """Train on windows of at most EXAMPLES texts outside the held-out fold: those whose ids have the least hashes."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter(F.col("text")) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    sample = rows.select("doc_id").distinct().orderBy(hash60(F.col("doc_id")), "doc_id").limit(EXAMPLES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = arrow_rows(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "lang", "text")).mapInArrow(window_batches, f"doc_id {kind}, lang string, windows array<binary>")
    # Of an id with several texts the least one stands, so reruns agree and the sample stays bounded.
    each = cut.groupBy("doc_id").agg(F.min(F.struct("lang", "windows")).alias("x")).select("doc_id", "x.*").collect()
    each.sort(key=lambda r: r.doc_id)
    return learn([bytes(w) for r in each for w in r.windows], [r.lang for r in each for _ in r.windows])


def score_batches(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = net.pooled([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("letters"), pa.array(list(p), pa.list_(pa.float64())), pa.array(list(n), pa.list_(pa.int64()))], ["doc_id", "letters", "pooled", "labelled"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, pooled and labelled (maps of mean probabilities and of bytes by language).

    Whole texts are scored. A text that is null or has no letter is `und` with score 0.
    Rows without a language or an id are not learned from, but are scored. If one
    language alone is known it is predicted with score 1; if none is, all rows are
    `und`. Rows that repeat each give a row; other columns are ignored; an empty table
    gives no rows.
    """
    net = fit(docs)
    give_back()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not net.languages:
        scored = docs.select("doc_id", F.lit(False).alias("letters"), F.array().cast("array<double>").alias("pooled"), F.array().cast("array<bigint>").alias("labelled"))
    else:
        rows = docs.select("doc_id", has_letter(F.col("text")).alias("letters"), "text")
        scored = arrow_rows(rows).mapInArrow(score_batches(net), f"doc_id {kind}, letters boolean, pooled array<double>, labelled array<bigint>")
    names = F.array([F.lit(x) for x in net.languages]).cast("array<string>")
    best = F.array_max("pooled")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.when(F.col("letters"), names[F.array_position("pooled", best).cast("int") - 1]).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("letters"), F.least(best, F.lit(1.0))).otherwise(F.lit(0.0)).alias("score"),
        F.map_from_arrays(names, "pooled").alias("pooled"),
        F.map_from_arrays(names, "labelled").alias("labelled"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
