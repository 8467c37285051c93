"""Convex fusion of any number of experts by a distributed solver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Fusion:
    weights: np.ndarray
    loss: float
    gap: float
    passes: int


def huber_pass(rows: DataFrame, experts: Sequence[str], observed: str, points: np.ndarray, delta: float, slopes: bool = True) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and for each weight vector the sums of the Huber loss, and (if asked for) of its gradient and its curvature.

    Each task gives one row of sums, so what reaches the driver grows with tasks, not rows.
    """
    k, many, points = len(experts), len(points), np.asarray(points, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, slope, bend = 0, np.zeros(many), np.zeros((many, k)), np.zeros((many, k, k))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], 1)
            y = batch.column(k).to_numpy(zero_copy_only=False)
            n += len(y)
            for i, w in enumerate(points):
                e = x @ w - y
                size = np.abs(e)
                near = size <= delta
                loss[i] += np.where(near, 0.5 * e * e, delta * (size - 0.5 * delta)).sum()
                if not slopes:
                    continue
                slope[i] += np.clip(e, -delta, delta) @ x
                bend[i] += x[near].T @ x[near]
        flat = np.concatenate([[n], loss, slope.ravel(), bend.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select(*experts, observed).na.drop().mapInArrow(run, "sums array<double>").collect()
    total = np.sum([p["sums"] for p in parts], axis=0) if parts else np.zeros(1 + many * (1 + k + k * k))
    return total[0], total[1 : 1 + many], total[1 + many : 1 + many + many * k].reshape(many, k), total[1 + many * (1 + k) :].reshape(many, k, k)


def _quadratic_on_simplex(slope: np.ndarray, bend: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least of slope (v - w) + (v - w)' bend (v - w) / 2 over the simplex, by active sets from w."""
    k = len(w)
    free = w > 1e-12
    v = w.copy()
    for _ in range(20 * k):
        f = np.flatnonzero(free)
        system = np.zeros((len(f) + 1, len(f) + 1))
        system[:-1, :-1] = bend[np.ix_(f, f)]
        system[:-1, -1] = system[-1, :-1] = 1
        right = np.append((bend @ w - slope)[f], 1.0)
        solved = np.linalg.lstsq(system, right, rcond=None)[0]
        goal = np.zeros(k)
        goal[f] = solved[:-1]
        if goal.min() >= -1e-14:
            v = np.maximum(goal, 0)
            rise = slope + bend @ (v - w)
            least = int(np.argmin(rise))
            if free[least] or rise[least] >= rise[f].max() - 1e-13 * max(1.0, np.abs(rise).max()):
                break
            free[least] = True
        else:
            step = goal - v
            down = step < -1e-300
            share = np.min(np.where(down & free, v / np.where(down, -step, 1), np.inf))
            v = np.maximum(v + min(1.0, share) * step, 0)
            free &= v > 1e-14
    return v / v.sum()


def simplex_weights(rows: DataFrame, experts: Sequence[str], observed: str, delta: float = 5.0, gap: float = 1e-7, passes: int = 40) -> Fusion:
    """[E15] Non-negative weights, summing to 1, of least mean Huber loss.

    Each pass adds up the loss, gradient and curvature at several points between the
    last weights and the solution of their quadratic model; the best point goes on.
    The duality gap of the simplex (gradient times weights, less the least gradient)
    bounds how far the loss is from the least one, and ends the passes. Rows with a
    null are left out; without rows the weights are equal.
    """
    k = len(experts)
    w = np.full(k, 1 / k)
    at, goal = np.array([w]), w
    best: tuple[float, float] | None = None
    shares = np.array([0.0])
    for step in range(1, passes + 1):
        n, loss, slope, bend = huber_pass(rows, experts, observed, at, delta)
        if not n:
            return Fusion(w, 0.0, 0.0, step)
        pick = int(np.argmin(loss))
        w, slope1, bend1 = at[pick], slope[pick] / n, bend[pick] / n
        rest = float(slope1 @ w - slope1.min())
        best = (float(loss[pick] / n), rest)
        if rest <= gap:
            return Fusion(w, *best, step)
        # Curvature beyond delta is 0: a share of the mean diagonal keeps the model's solution near.
        ridge = np.eye(k) * max(1e-12, 1e-6 * np.trace(bend1) / k)
        goal = _quadratic_on_simplex(slope1, bend1 + ridge, w)
        corner = np.eye(k)[int(np.argmin(slope1))]
        shares = np.array([1.0, 0.5, 0.25, 0.1, 0.02])
        at = np.concatenate([[w], w + shares[:, None] * (goal - w), w + np.array([0.1, 0.01, 0.001])[:, None] * (corner - w)])
    return Fusion(w, *best, passes)
