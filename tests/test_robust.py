"""Exact ridges, convex fusion and radix quantiles against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessile.operators import folds, fusion, neighbours, quantiles, ridge


def ridge_by_rows(x, y, alpha):
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return np.concatenate([[y.mean() - w @ mean], w])


def test_leave_one_out_ridge_equals_fits_over_rows(spark):
    rng = np.random.default_rng(1)
    names = ["a", "b", "c", "d", "e"]
    source = np.concatenate([np.zeros(150, int), rng.integers(1, 9, 200), [77]])  # a large source and one of one row
    x = rng.normal(size=(len(source), 5)) * [1, 50, 0.01, 3, 0] + source[:, None]  # the last one is constant in a source
    y = x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=len(source)) * 2
    inner, alphas = source % 3, (0.01, 1.0, 100.0, 10_000.0)
    frame = spark.createDataFrame([(int(s), int(i), float(t), *map(float, r)) for s, i, t, r in zip(source, inner, y, x, strict=True)], "source long, inner int, y double, a double, b double, c double, d double, e double")
    got = {r.source: r for r in ridge.leave_one_out(frame, "source", "inner", names, "y", alphas).collect()}
    assert set(got) == set(source.tolist())
    for k, r in got.items():
        rest = source != k
        scores = []
        for alpha in alphas:
            folds = []
            for j in range(3):
                test, train = rest & (inner == j), rest & (inner != j)
                if test.any():
                    w = ridge_by_rows(x[train], y[train], alpha)
                    folds.append(np.mean((y[test] - w[0] - x[test] @ w[1:]) ** 2))
            scores.append((round(np.mean(folds), 9), -alpha))
        assert r.alpha == -min(scores)[1] and r.train_rows == rest.sum()
        assert np.allclose(r.model, ridge_by_rows(x[rest], y[rest], r.alpha), rtol=1e-6, atol=1e-7)
    alpha, model = ridge.fitted(frame, None, names, "y", (2.0,))
    assert alpha == 2.0 and np.allclose(model, ridge_by_rows(x, y, 2.0), rtol=1e-6, atol=1e-7)
    with pytest.raises(ValueError):
        ridge.leave_one_out(frame.filter("source IN (1, 2)"), "source", "inner", names, "y", alphas)


def huber_loss(e, delta=5.0):
    return np.mean(np.where(np.abs(e) <= delta, 0.5 * e * e, delta * (np.abs(e) - 0.5 * delta)))


@pytest.mark.parametrize("k", [2, 3, 5, 8])
def test_convex_fusion_is_proven_and_beats_a_grid(spark, k):
    rng = np.random.default_rng(k)
    y = rng.uniform(0, 180, 400)
    x = y[:, None] + rng.normal(size=(400, k)) * rng.uniform(2, 30, k) + rng.normal(size=k) * 6
    names = [f"e{i}" for i in range(k)]
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], [*names, "y"])
    fit = fusion.simplex_weights(frame, names, "y")
    assert fit.gap < 1e-6 and fit.weights.min() >= 0 and abs(fit.weights.sum() - 1) < 1e-9
    assert abs(fit.loss - huber_loss(x @ fit.weights - y)) < 1e-9
    tried = rng.dirichlet(np.full(k, 0.5), 3000)
    assert fit.loss <= min(huber_loss(x @ w - y) for w in tried) + 1e-6
    if k == 3:
        grid = [(a / 20, b / 20, (20 - a - b) / 20) for a in range(21) for b in range(21 - a)]
        best = min(grid, key=lambda w: huber_loss(x @ np.array(w) - y))
        assert fit.loss <= huber_loss(x @ np.array(best) - y) + 1e-9


def test_convex_fusion_edges(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (5.0, 5.0, 4.0), (None, 1.0, 2.0)], "a double, b double, y double")
    fit = fusion.simplex_weights(rows, ["a", "b"], "y")  # two equal experts
    assert fit.gap < 1e-7 and abs(fit.loss - 0.25) < 1e-9
    assert list(fusion.simplex_weights(rows.filter("y > 9"), ["a", "b"], "y").weights) == [0.5, 0.5]
    far = spark.createDataFrame([(1e6, 2e6, 0.0)] * 3, "a double, b double, y double")  # no curvature anywhere
    assert np.allclose(fusion.simplex_weights(far, ["a", "b"], "y").weights, [1, 0], atol=1e-6)


def test_quantiles_of_any_scale(spark):
    rng = np.random.default_rng(2)
    wide = np.concatenate([10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)), np.zeros(40), [5e-324, -5e-324, 1.7e308, -1.7e308, 2.0**-1022, 1.0, 2.0, 4.0, np.nextafter(2, 0), np.nextafter(2, 3)]])
    narrow = 1 + rng.integers(0, 50, 500) * 2.0**-52
    groups = {"wide": wide, "narrow": narrow, "ties": np.full(300, 7.25), "one": np.array([3.5]), None: rng.normal(size=99), "small": rng.normal(size=2) * 1e-310}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("one", float("nan")), ("nothing", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in quantiles.quantiles(frame, ["g"], F.col("v"), shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        assert got[g].n == len(vs)
        for name, share in shares.items():
            place = share * (len(s) - 1)
            low, high, part = s[int(np.floor(place))], s[int(np.ceil(place))], place - np.floor(place)
            assert got[g][name] == (low if low == high else low * (1 - part) + high * part), (g, name)
    every = quantiles.quantiles(frame.withColumnRenamed("g", "n0"), [], F.col("v"), {"m": 0.5}).collect()
    assert len(every) == 1 and every[0].n == sum(map(len, groups.values()))
    assert quantiles.quantiles(frame.filter("g = 'nothing'"), [], F.col("v"), {"m": 0.5}).collect() == []


def test_whole_values_equal_grouped_ones(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-9, 9, 200)), np.zeros(9), np.full(50, 2.5)])
    frame = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = quantiles.whole_quantiles(frame, F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.99})
    want = quantiles.quantiles(frame, [], F.col("v"), {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert got == {k: want[k] for k in got}
    assert quantiles.whole_quantiles(frame.filter("v IS NULL"), F.col("v"), {"a": 0.1}) == {"a": None}


def test_order_values_at_ends_and_infinities(spark):
    frame = spark.createDataFrame([(float("-inf"),), (-1.0,), (-0.0,), (0.0,), (float("inf"),)], "v double")
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(7)}
    (row,) = quantiles.order_values(frame, [], F.col("v"), ranks).collect()
    assert [row[f"r{i}"] for i in range(7)] == [None, float("-inf"), -1.0, 0.0, 0.0, float("inf"), None]


def plain_nearest(train, queries, k):
    d = np.sqrt(((queries[:, None, :] - train[None, :, :]) ** 2).sum(axis=2))
    return np.sort(d, axis=1)[:, min(k, len(train)) - 1]


def vector_frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_in_clusters_compare_few_blocks(spark, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(12, 6)) * 40
    train = np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)), np.tile(centres[0], (700, 1))])  # a third are copies of one
    queries = np.concatenate([train[::9], centres[rng.integers(0, 12, 100)] + rng.normal(size=(100, 6)), rng.normal(size=(20, 6)) * 300])
    found = neighbours.search(vector_frame(spark, train), vector_frame(spark, queries), k, block=64)
    got = {r.id: r.distance for r in found.distance.collect()}
    assert np.allclose([got[i] for i in range(len(queries))], plain_nearest(train, queries, k), rtol=0, atol=1e-12)
    assert found.met < 0.2 * found.possible


def test_neighbours_edges(spark):
    x = np.array([[0.0, 0.0], [3.0, 4.0], [3.0, 4.0]])
    one = neighbours.search(vector_frame(spark, x), vector_frame(spark, x), 5)  # fewer vectors than asked for
    assert sorted(r.distance for r in one.distance.collect()) == [5.0, 5.0, 5.0]
    none = vector_frame(spark, x).filter("id < 0")
    assert neighbours.search(none, vector_frame(spark, x), 1).distance.collect() == []
    assert neighbours.search(vector_frame(spark, x), none, 1).distance.collect() == []
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(500, 48))  # nothing to prune
    found = neighbours.search(vector_frame(spark, flat), vector_frame(spark, flat[:60]), 7, block=50)
    got = {r.id: r.distance for r in found.distance.collect()}
    assert np.allclose([got[i] for i in range(60)], plain_nearest(flat, flat[:60], 7), atol=1e-12)


def bins_one_by_one(sizes, fractions):
    loads, out, whole = np.zeros(len(fractions)), [], sum(sizes)
    for n in sizes:
        out.append(int(np.argmax(np.array(fractions) * whole - loads)))
        loads[out[-1]] += n
    return out


@pytest.mark.parametrize("fractions", [(0.70, 0.15, 0.15), (0.25,) * 4, (1 / 3,) * 3, (0.5, 0.3, 0.1, 0.07, 0.03), (1.0,)])
def test_greedy_runs_place_as_one_by_one(fractions):
    rng = np.random.default_rng(len(fractions))
    for trial in range(60):
        sizes = sorted((int(x) for x in rng.choice([0, 1, 2, 3, 7, 50, 51, 400], rng.integers(1, 120), p=[0.05, 0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05])), reverse=True)
        got = []
        for size, start, length, cycle in folds.greedy_runs([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], fractions):
            got += [cycle[i % len(cycle)] for i in range(length)]
        assert got == bins_one_by_one(sizes, fractions), trial


def test_a_million_sources_of_a_hundred_sizes(spark):
    groups = spark.range(1_000_000).select(F.col("id").alias("source"), (F.col("id") * 7919 % 100 + 1).alias("n"))
    out = folds.greedy_bins(groups, "source", "n", (0.7, 0.15, 0.15))
    loads = {r.bin: r.load for r in out.join(groups, "source").groupBy("bin").agg(F.sum("n").alias("load")).collect()}
    whole = sum(loads.values())
    assert out.count() == 1_000_000 and all(abs(loads[b] - f * whole) <= 1 for b, f in enumerate((0.7, 0.15, 0.15)))
    assert folds.greedy_bins(groups.filter("n > 500"), "source", "n", (0.5, 0.5)).collect() == []


def test_order_values_read_their_rows_once_and_count_weights(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    data = [(k % 3, float(k % 40) / 7, k % 5 + 1) for k in range(200)]
    frame = spark.createDataFrame(data, "g int, v double, w int").mapInPandas(read, "g int, v double, w int")
    got = {r.g: (r.n, r.q) for r in quantiles.order_values(frame, ["g"], F.col("v"), {"q": lambda n: F.floor(n / 2) + 1}, F.col("w")).collect()}
    assert seen.value == 200
    for g in range(3):
        every = sorted(v for k, v, w in data if k == g for _ in range(w))
        assert got[g] == (len(every), every[len(every) // 2])
    n, _ = quantiles.whole_values(frame, F.col("v"), {"q": lambda n: 3})
    assert (n, seen.value) == (200, 400)


def test_bootstrap_reads_its_clusters_once_and_groups_share_draws(spark):
    import hashlib

    seen = spark.sparkContext.accumulator(0)

    def read(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    data = [(g, i, i % 4 + 1, float(g * 3 + i * i % 7), float(i % 5)) for g, c in ((1, 5), (2, 5), (3, 9)) for i in range(c)]
    kind = "g int, idx long, n long, ea double, eb double"
    got = {r.g: r for r in folds.bootstrap(spark.createDataFrame(data, kind).mapInPandas(read, kind), ["g"], 30, 5).collect()}
    assert seen.value == len(data)
    for g, c in ((1, 5), (2, 5), (3, 9)):
        own = [r[2:] for r in data if r[0] == g]
        deltas = []
        for b in range(1, 31):
            drawn = [own[int(hashlib.md5(f"5|{b}|{j}".encode()).hexdigest()[:8], 16) % c] for j in range(1, c + 1)]
            deltas.append((sum(x[1] for x in drawn) - sum(x[2] for x in drawn)) / sum(x[0] for x in drawn))
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.quantile(deltas, (0.025, 0.975))), abs=1e-6)
        assert got[g].clusters == c and got[g].p_better == pytest.approx(np.mean(np.array(deltas) < 0), abs=1e-6)
