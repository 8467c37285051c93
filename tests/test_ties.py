"""Sums without loss: results where penalties tie do not depend on the order of the rows."""

import math

import numpy as np
import pytest

from sessile.operators import ridge


def test_sources_left_out_leave_sums_without_loss(spark):
    rng = np.random.default_rng(4)
    x, small = rng.uniform(0.1, 0.7, 300), np.arange(1, 301)
    y = 3 * x + rng.normal(size=300) * 0.01
    # The large source comes first: a square below 1 is lost when it is added to 1e16 (as a double) alone.
    rows = [(0, 0, 1e8, 3e8), *((int(s), int(s % 3), float(a), float(b)) for s, a, b in zip(small, x, y, strict=True))]
    frame = spark.createDataFrame(rows, "source long, inner int, x double, y double").coalesce(1)
    got = {r.source: r for r in ridge.leave_one_out(frame, "source", "inner", ("x",), "y", (1e-6,)).collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert got[0].model == pytest.approx([intercept, slope], abs=0.15)


def test_totals_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(5)
    values = rng.uniform(0, 1, 500) * 10.0 ** rng.integers(0, 9, 500)
    frame = spark.createDataFrame([(k, k % 2, float(v), float(v) / 3) for k, v in enumerate(values)], "source long, inner int, x double, y double")
    for rows in (frame.coalesce(1), frame.orderBy("x").coalesce(1), frame.orderBy("y", ascending=False).repartition(3)):
        total = ridge.added(ridge.moments(rows, ["source", "inner"], ("x",), "y"), "inner")
        assert [total[j].products[0, 0] for j in (0, 1)] == [math.fsum(values[j::2] ** 2) for j in (0, 1)]
