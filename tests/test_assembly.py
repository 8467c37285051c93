"""Feature rows with masks, and permutations over a cohort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessile.operators import assembled, permute


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 4097])
def test_permutations_are_one_to_one(n):
    seen = [permute.permuted(np.arange(n), n, [7 * k + 3, 11, 12345678 + k, 99]) for k in range(4)]
    for out in seen:
        assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert len({tuple(o.tolist()) for o in seen}) == 4 and all(np.mean(o == np.arange(n)) < 0.1 for o in seen)


def test_values_are_dealt_among_all_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(i // 50), float(rng.normal())) for i in range(300)]  # the first feature is constant in each group of 50
    frame = spark.createDataFrame([(i, a, b, 90 + 5 * a + 2 * b) for i, a, b in rows], "id long, a double, b double, y double").withColumn("p", 90 + 5 * F.col("a") + 2 * F.col("b")).repartition(3)
    keys = [(f, k, [k + 1, 2 * k, 31, 5]) for f in "ab" for k in range(3)]
    got = permute.importance(frame, "id", ["a", "b"], [5.0, 2.0], "p", "y", keys).collect()
    sums = {f: round(sum(r[k] for r in rows), 4) for k, f in ((1, "a"), (2, "b"))}
    assert len(got) == 6 and all(r.n == 300 and r.dealt == pytest.approx(sums[r.feature], abs=2e-4) for r in got)
    assert all(r.increase > 4 for r in got if r.feature == "a") and all(r.increase > 0.5 for r in got if r.feature == "b")
    x = np.array([r[1] for r in rows])
    moved = x[permute.permuted(np.arange(300), 300, [1, 0, 31, 5])]
    want = np.mean(np.abs(5 * (np.minimum(moved, 18) - x)))
    assert next(r.increase for r in got if r.feature == "a" and r["repeat"] == 0) == pytest.approx(want, abs=1e-6)


def test_masks_tell_a_planted_leak(spark):
    rows = [("k", f, float(v)) for f in range(3) for v in (f, f + 10)] + [("alone", 1, 4.0), ("k", 2, None)]
    frame = spark.createDataFrame(rows, "key string, fold int, value double")
    cells = assembled.cells(frame, ["key"], "fold", "value")
    d = frame.join(cells, "key").withColumn("clean", assembled.over(F.col("cells"), F.col("fold"))).withColumn("leaky", assembled.over(F.col("cells"), F.lit(None)))
    told = d.select("key", "fold", "clean", "leaky", *[assembled.guard([F.col(f"{k}.mask")], F.col("fold"), F.lit(1), F.array(F.lit(2))).alias(f"g_{k}") for k in ("clean", "leaky")]).collect()
    for r in told:
        assert r.g_clean == "disjoint" and r.g_leaky == "fold_leak"
        others = [v for k, f, v in rows if k == r.key and f != r.fold and v is not None]
        assert r.clean.n == len(others) and r.clean.mask == sum({1 << f for k, f, v in rows if k == r.key and f != r.fold and v is not None})
        if others:
            assert r.clean.mean == pytest.approx(np.mean(others)) and r.clean.spread == pytest.approx(np.std(others))
    (one,) = frame.limit(1).select(assembled.guard([F.lit(0).cast("long")], F.col("fold"), F.lit(2), F.array(F.lit(2))).alias("g")).collect()
    assert one.g == "target_leak"


def test_probes_leave_the_target_out_and_are_not_cut(spark):
    frame = spark.createDataFrame([("s", q, 10.0 * q) for q in range(1, 9)] + [("t", 1, 90.0), ("u", 1, 18.0), ("u", 2, 36.0), ("u", 2, 72.0)], "surface string, liquid int, angle double")
    got = {(r.surface, r.liquid): r for r in assembled.probe_summary(frame.filter("surface <> 's'"), ["surface"], "liquid", "angle", 6).collect()}
    assert got["t", 1].has_probes == 0 and got["t", 1].probe_liquids == []
    assert got["u", 1].probes == 2 and got["u", 1]["mean"] == pytest.approx(0.3) and got["u", 1].spread == pytest.approx(0.1) and (got["u", 1].least, got["u", 1].largest) == (0.2, 0.4)
    with pytest.raises(Exception, match="more than 6 probe liquids"):
        assembled.probe_summary(frame, ["surface"], "liquid", "angle", 6).collect()
