"""Ridge regressions of many folds from sums by source: no fit over rows for each fold, no copies of rows.

The sums of products of a fold's training rows are the total less the sums of what is
held out. So all folds of all sources are small systems that come from one pass over
the rows, and are solved many at a time by Cholesky factors. Totals are the sums of the
sources' sums, added without loss: with many rows the penalties' errors differ by less
than the noise of one long sum of doubles, which changes with the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessile.sources.work import materialised

#: A side of a join is broadcast only if it has at most so many rows, counted.
BROADCAST_ROWS = 100_000


@dataclass
class Moments:
    """For each of many sets of rows: their number, sums, and sums of products of the features and, last, the target."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(n, sums, upper) -> Moments:
        """From flat rows; upper: the products (i, j), i <= j, row by row."""
        sums, upper = np.asarray(sums, float), np.asarray(upper, float)
        k = sums.shape[-1]
        at = np.triu_indices(k)
        square = np.zeros((*sums.shape[:-1], k, k))
        square[..., at[0], at[1]] = upper
        square[..., at[1], at[0]] = upper
        return Moments(np.asarray(n, float), sums, square)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def fit(self, alpha: float) -> np.ndarray:
        """Intercept and weights (in the features' own units) with the penalty on standardised features; an empty set has zeros."""
        n = np.maximum(self.n, 1)[..., None]
        mean = self.sums / n
        spread = self.products - n[..., None] * mean[..., :, None] * mean[..., None, :]
        scale = np.maximum(np.sqrt(np.maximum(np.diagonal(spread, axis1=-2, axis2=-1)[..., :-1] / n, 0)), 1e-8)
        matrix = spread[..., :-1, :-1] / (scale[..., :, None] * scale[..., None, :]) + alpha * np.eye(scale.shape[-1])
        factor = np.linalg.cholesky(matrix)
        half = np.linalg.solve(factor, (spread[..., :-1, -1] / scale)[..., None])
        weights = np.linalg.solve(np.swapaxes(factor, -1, -2), half)[..., 0] / scale
        return np.concatenate([(mean[..., -1] - (weights * mean[..., :-1]).sum(axis=-1))[..., None], weights], axis=-1)

    def squared_error(self, model: np.ndarray) -> np.ndarray:
        """Sum of squared errors of models on these rows, from the sums alone; in long doubles, as large terms cancel."""
        model = model.astype(np.longdouble)
        w = np.concatenate([-model[..., 1:], np.ones((*model.shape[:-1], 1))], axis=-1)
        quadratic = np.einsum("...i,...ij,...j->...", w, self.products, w)
        return quadratic - 2 * model[..., 0] * (w * self.sums).sum(axis=-1) + self.n * model[..., 0] ** 2


def moments(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """(keys, n, sums, upper) of the rows of each key, in one aggregation."""
    z = [F.col(c).cast("double") for c in (*features, target)]
    upper = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in z]).alias("sums"), F.array(*upper).alias("upper"))


def added(own: DataFrame, key: str) -> dict:
    """The moments of each value of a key, of few, from rows of moments: added without loss in each batch, then on the driver."""

    def add(f: pd.DataFrame) -> dict:
        return {k: [math.fsum(g["n"]), *([math.fsum(x) for x in zip(*g[c], strict=True)] for c in ("sums", "upper"))] for k, g in f.groupby(key)}

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *v) for k, v in add(f).items()], columns=[key, "n", "sums", "upper"])

    kind = own.schema[key].dataType.simpleString()
    rows = own.mapInPandas(parts, f"`{key}` {kind}, n double, sums array<double>, upper array<double>").toPandas()
    return {k: Moments.of(*v) for k, v in sorted(add(rows).items())}


def _stack(frame: pd.DataFrame) -> Moments:
    return Moments.of(frame["n"].to_numpy(float), np.stack(frame["sums"]), np.stack(frame["upper"]))


def chosen(alphas: Sequence[float], train: Sequence[Moments], test: Sequence[Moments]) -> np.ndarray:
    """For each set the penalty of least mean (over inner folds that have rows) squared error; ties to the larger."""
    scores = []
    for alpha in alphas:
        some = np.stack([t.n > 0 for t in test])
        means = np.stack([np.where(t.n > 0, t.squared_error(f.fit(alpha)) / np.maximum(t.n, 1), 0.0) for f, t in zip(train, test, strict=True)])
        scores.append(np.round(means.sum(axis=0) / np.maximum(some.sum(axis=0), 1), 9))
    order = np.argsort(-np.asarray(alphas, float), kind="stable")
    return np.asarray(alphas, float)[order][np.argmin(np.stack(scores)[order], axis=0)]


def leave_one_out(rows: DataFrame, source: str, inner: str, features: Sequence[str], target: str, alphas: Sequence[float]) -> DataFrame:
    """[E4 M6] For each source (source, train_rows, alpha, model): a ridge fit on all other sources, exactly.

    The penalty comes from inner folds of whole sources (the column inner, a function
    of the source) among the others. model has the intercept and the weights. Rows
    need features and target without nulls. Fewer than three sources raise.
    """
    own = materialised(moments(rows, [source, inner], features, target), "moments")  # a row for each source
    if own.limit(3).count() < 3:
        raise ValueError("leaving one source out takes three sources at least")
    each = added(own, inner)  # a few inner folds
    total = Moments(sum(m.n for m in each.values()), sum(m.sums for m in each.values()), sum(m.products for m in each.values()))
    kind = rows.schema[source].dataType.simpleString()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            mine, rest = _stack(f), total - _stack(f)
            train, test = [], []
            for j, fold in each.items():
                here = (f[inner] == j).to_numpy()
                left = Moments(*(np.where(here.reshape(-1, *[1] * (a.ndim - 1)), a, 0.0) for a in (mine.n, mine.sums, mine.products)))
                test.append(fold - left)  # the fold without the held-out source
                train.append(rest - test[-1])
            alpha = chosen(alphas, train, test)
            models = np.stack([rest.fit(a) for a in alphas])
            model = models[np.argmax(np.asarray(alphas, float)[:, None] == alpha, axis=0), np.arange(len(f))]
            yield pd.DataFrame({source: f[source], "train_rows": rest.n.astype(np.int64), "alpha": alpha, "model": list(model)})

    return own.mapInPandas(solve, f"`{source}` {kind}, train_rows long, alpha double, model array<double>")


def fitted(rows: DataFrame, inner: str | None, features: Sequence[str], target: str, alphas: Sequence[float]) -> tuple[float, list[float]]:
    """[M6 M13] Penalty and model (intercept, weights) of all rows; inner folds choose among several penalties."""
    groups = moments(rows, [inner] if inner else [], features, target).collect()
    each = [Moments.of(r.n, r["sums"], r["upper"]) for r in groups if r.n]
    if not each:
        raise ValueError("a fit takes rows")
    total = Moments(sum(m.n for m in each), sum(m.sums for m in each), sum(m.products for m in each))
    alpha = float(alphas[0]) if len(alphas) == 1 else float(chosen(alphas, [total - m for m in each], each))
    return alpha, [float(x) for x in total.fit(alpha)]


def linear(model, features: Sequence[str]):
    """The value of a model, given as a column with an array or as numbers."""
    at = (lambda i: model[i]) if not isinstance(model, (list, tuple)) else (lambda i: F.lit(model[i]))
    return sum((at(i + 1) * F.col(c) for i, c in enumerate(features)), at(0))


def with_models(rows: DataFrame, models: DataFrame, source: str) -> DataFrame:
    """Rows beside their source's model: broadcast if there are few sources, joined by source otherwise."""
    return rows.join(F.broadcast(models) if models.count() <= BROADCAST_ROWS else models, source)
