import math

import pytest
from pyspark.sql import functions as F

from sessile import sources
from sessile.operators import calibrate, evaluate, features, fits, folds, joins, quality
from sessile.roles import liquids


def measured(spark, d, p, names, surface=1, split="train", angles=None):
    """Measurements of a surface with known components by the forward model."""
    rows = []
    for i, (liquid, gamma, gd, gp) in enumerate(names):
        cosine = 2 * (math.sqrt(d * gd) + math.sqrt(p * gp)) / gamma - 1
        angle = float(angles[i]) if angles else math.degrees(math.acos(cosine))
        rows.append((surface, split, liquid, gamma, gd, gp, angle, "yes"))
    return spark.createDataFrame(rows, "surface_group_id long, v4_split string, liquid_id int, gamma double, gd double, gp double, angle double, target_eligible string")


WATER, DIIODO, FORMAMIDE = (1, 72.8, 21.8, 51.0), (2, 50.8, 48.5, 2.3), (3, 58.0, 39.0, 19.0)


def test_fit_recovers_components_and_leaves_the_target_out(spark):
    m = measured(spark, 25.0, 10.0, [WATER, DIIODO, FORMAMIDE])
    got = fits.solve(fits.masked(m)).collect()
    assert len(got) == 3
    for r in got:
        assert (r.fit_status, r.n_probes) == ("interior_fit", 2)
        assert (r.d, r.p) == (pytest.approx(25, abs=1e-6), pytest.approx(10, abs=1e-6))
        assert r.residual_norm == pytest.approx(0, abs=1e-5)


def test_fit_statuses(spark):
    few = fits.solve(fits.masked(measured(spark, 25.0, 10.0, [WATER, DIIODO]))).collect()
    assert {r.fit_status for r in few} == {"insufficient_probes"}
    flat = measured(spark, 25.0, 0.0, [(1, 50.8, 50.8, 0.0), (2, 44.4, 44.4, 0.0), (3, 72.8, 21.8, 51.0)], angles=[60, 50, 90])
    got = {r.target_liquid_id: r.fit_status for r in fits.solve(fits.masked(flat)).collect()}
    assert got[3] == "singular_fit"
    edge = measured(spark, 25.0, 10.0, [WATER, DIIODO, FORMAMIDE], angles=[150, 30, 60])
    assert {r.target_liquid_id: r.fit_status for r in fits.solve(fits.masked(edge)).collect()}[3] == "boundary_fit"


def test_fit_ignores_what_is_not_eligible_or_broken(spark):
    m = measured(spark, 25.0, 10.0, [WATER, DIIODO, FORMAMIDE])
    bad = m.withColumn("target_eligible", F.lit("no")).unionByName(m.withColumn("gamma", F.lit(-1.0)))
    a, b = (sorted(map(str, fits.solve(fits.masked(x)).select("target_liquid_id", "n_probes", "fit_status").collect())) for x in (m, m.unionByName(bad)))
    assert a == b


def test_forward_of_known_liquid(spark):
    m = measured(spark, 25.0, 10.0, [WATER, (4, 64.0, 34.0, 30.0), FORMAMIDE])
    r = fits.forward(fits.solve(fits.masked(m)), liquids(spark)).filter("target_liquid_id = 1").first()
    assert r.fitted_angle == pytest.approx(m.filter("liquid_id = 1").first().angle, abs=1e-4)


def test_checked_join(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"])
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b.limit(1), ["k"], complete=True)
    assert joins.checked_join(a, b.filter("v = 'x'"), ["k"]).count() == 2


def test_first_filled_and_first_rows(spark):
    d = spark.createDataFrame([(1, 2, "b", None), (1, 1, " ", None), (2, 1, None, "")], "k int, o int, a string, b string")
    got = {r.k: (r.a, r.b) for r in joins.first_filled(d, ["k"], ["a", "b"], "o").collect()}
    assert got == {1: ("b", ""), 2: ("", "")}
    assert {r.k: r.a for r in joins.first_rows(d, ["k"], ["o"]).collect()} == {1: " ", 2: None}


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(1, "A", None), (3, "c", 3.0)], "k int, n string, v double")
    keep = {r.k: (r.n, r.v) for r in joins.upsert(old, new, ["k"]).collect()}
    last = {r.k: (r.n, r.v) for r in joins.upsert(old, new, ["k"], keep_known=False).collect()}
    assert keep == {1: ("A", 1.0), 2: ("b", 2.0), 3: ("c", 3.0)}
    assert last[1] == ("A", None)


def test_insert_absent_takes_the_first_of_a_batch(spark):
    have = spark.createDataFrame([(1,)], "k int")
    staged = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "k int, o int")
    assert [tuple(r) for r in joins.insert_absent(have, staged, ["k"], ["o"]).collect()] == [(2, 1)]


def test_range_rule_is_broken_by_null(spark):
    d = spark.createDataFrame([(1, 5.0), (2, None), (3, 181.0)], "id int, x double")
    got = quality.broken_rules(d, {"range": quality.outside("x", 0, 180), "never": F.lit(False)}, "id").collect()
    assert [(r.rule, r.n, r.first_ids) for r in got] == [("range", 2, "2,3")]


def test_gate_raises(spark):
    decisions = spark.createDataFrame([(1, "pending_x"), (2, "retain"), (2, "retain"), (9, "retain")], "source int, decision string")
    active = spark.createDataFrame([(1,), (2,), (3,)], "source int")
    v = quality.decision_violations(decisions, active, active.limit(0))
    assert {(r.source, r.kind) for r in v.collect()} == {(1, "pending"), (2, "decided_twice"), (9, "unknown_source"), (3, "undecided")}
    with pytest.raises(quality.GateError):
        quality.gate(v)
    quality.gate(v.limit(0))


def test_duplicate_labels(spark):
    d = spark.createDataFrame([("a", 1.0, "s"), ("a", 1.0, "t"), ("a", 1.5, "s"), ("b", 1.0, "s"), ("c", None, "s"), ("c", None, "s")], "k string, v double, s string")
    label = lambda compat: sorted((r.k, r.label) for r in quality.duplicate_labels(d, ["k"], "v", "s", compat).collect())
    assert label(False) == [("a", "exact_duplicate"), ("a", "exact_duplicate"), ("a", "near_duplicate"), ("b", "unique"), ("c", "exact_duplicate"), ("c", "exact_duplicate")]
    assert label(True)[0] == ("a", "near_duplicate") and label(True)[-1] == ("c", "exact_duplicate")


def test_greedy_bins(spark):
    g = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 1)], "k long, n long")
    assert {r.k: r.bin for r in folds.greedy_bins(g, "k", "n", [0.5, 0.5]).collect()} == {2: 0, 1: 1, 3: 0, 4: 1}


def test_ranked_equals_row_number(spark):
    d = spark.range(200).withColumn("v", (F.col("id") * 37 % 101).cast("double"))
    got = {r.id: r["rank"] for r in folds.ranked(d, [], F.col("v"), F.floor(F.col("v") / 10), [F.col("id")]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((i * 37 % 101, i) for i in range(200)), 1)}
    assert got == want


@pytest.mark.parametrize("n", [1, 5, 20, 223])
def test_order_statistic_is_the_higher_quantile(spark, n):
    d = spark.range(n).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("score"), "id")
    k = math.ceil((n + 1) * 0.9)
    assert calibrate.order_statistic(d, ["k"], 0.9, [F.col("id")]).first().quantile == min(k + 1, n) - 1


def test_residual_means_shrink(spark):
    d = spark.createDataFrame([("water", 2.0), ("water", 2.0), ("dim", 10.0)], "liquid string, residual double")
    overall, each = calibrate.residual_means(d, "liquid", 0.0)
    assert overall.first().overall == pytest.approx(14 / 3)
    assert {r.liquid: r.group_mean for r in each.collect()} == {"water": 2.0, "dim": 10.0}


def test_nearest_distance_over_blocks(spark):
    t = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "id long, vector array<double>")
    got = {r.id: r.distance for r in calibrate.nearest_distance(t, t, 3, block=7).collect()}
    assert got[0] == 2.0 and got[15] == 1.0


def test_guard(spark):
    d = spark.createDataFrame(
        [("zero_shot", "water", [("a", 1.0)]), ("probe_assisted", "water", [("water", 1.0), ("b", 200.0)]), ("probe_assisted", "water", [("a", 1.0), ("b", 2.0)]), ("x", "y", [])],
        "mode string, target string, probes array<struct<liquid:string,angle:double>>",
    )
    assert [r.reasons for r in calibrate.guarded(d).collect()] == ["probes_in_zero_shot", "target_among_probes;angle_range", "", "unknown_mode"]


def test_scaler_and_vocabulary(spark):
    d = spark.createDataFrame([(1.0, "A"), (3.0, " a "), (None, None), (float("nan"), "b")], "x double, c string")
    s = features.fit_scaler(d, ["x"]).first()
    assert (s.center, s.scale) == (2.0, 1.0)
    v = {r.token: r.code for r in features.fit_vocabulary(d, ["c"]).collect()}
    assert v == {"<missing>": 2, "a": 3, "b": 4}
    out = features.encoded(features.scaled(d.limit(3), features.fit_scaler(d, ["x"]), ["x"]), features.fit_vocabulary(d.limit(2), ["c"]), ["c"]).collect()
    assert sorted((r.x_z, r.x_missing, r.c_code) for r in out) == [(-1.0, 0.0, 3), (0.0, 1.0, 2), (1.0, 0.0, 3)]


def test_strata_keep_null_and_drop_singles(spark):
    d = spark.createDataFrame([(None, 1.0, 1.0), (None, 2.0, 1.0), ("a", 1.0, 1.0)], "s string, observed double, predicted double")
    got = evaluate.strata(d, ["s"], []).collect()
    assert [(r.stratum, r.n) for r in got] == [(None, 2)]


def test_sources(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("﻿k, v \n1, a\n\n2,\n".encode())
    d = sources.read_table(spark, str(p))
    assert d.columns == ["k", "v"] and d.count() == 2
    with pytest.raises(ValueError, match="unknown kind"):
        sources.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError, match="missing"):
        sources.read_many([d], {}, ["k", "other"])
    both = sources.read_many([d, d.withColumnRenamed("v", "w")], {"w": "x"}, ["k"])
    assert both.columns == ["k", "v", "x"] and both.count() == 4
    sources.write_table(d, str(tmp_path / "o.csv"), ["v", "k"])
    with pytest.raises(Exception, match="(?i)exists"):
        sources.write_table(d, str(tmp_path / "o.csv"), ["v", "k"])
    sources.write_report(d, str(tmp_path / "r"))
    m = sources.file_manifest(spark, str(p)).first()
    assert m.file == "t.csv" and m.bytes == len(p.read_bytes())
    with pytest.raises(Exception, match="unknown k"):
        sources.require_key(d, spark.createDataFrame([("1", "n")], "k string, name string"), "k").collect()


def test_fingerprint_ignores_order(spark):
    d = spark.range(20).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    a, b = (x.agg(sources.fingerprint(["id", "v"]).alias("f")).first().f for x in (d, d.orderBy(F.desc("id"))))
    assert a == b != d.limit(19).agg(sources.fingerprint(["id", "v"]).alias("f")).first().f


def test_bootstrap_of_equal_models_is_zero(spark):
    c = spark.createDataFrame([("all", i, 2, 3.0, 3.0) for i in range(5)], "scope string, idx long, n long, ea double, eb double")
    r = folds.bootstrap(c, ["scope"], 10, 1).first()
    assert (r.point, r.low, r.high, r.clusters) == (0.0, 0.0, 0.0, 5)


def test_metrics_by_equals_the_aggregates(spark):
    import random

    from sessile.functions import metrics

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), round(rng.uniform(0, 180), rng.randrange(3)), rng.choice([None, 90.0, round(rng.uniform(0, 180), 1)])) for _ in range(400)]
    rows += [("one", 0, 10.0, 12.0), ("none", 0, 10.0, None), ("flat", 0, 5.0, 5.0), ("flat", 0, 5.0, 5.0), ("level", 0, 5.0, 6.0), ("level", 0, 5.0, 7.0)]
    d = spark.createDataFrame(rows, "k string, j int, observed double, predicted double")
    for keys in (["k", "j"], ["k"], []):
        for flag in (False, True):
            want = d.groupBy(*keys).agg(*metrics.regression(one_row_r2=flag)).collect()
            got = evaluate.metrics_by(d, keys, least=0, one_row_r2=flag).collect()
            assert len(got) == len(want)
            key = lambda r, keys=keys: str([r[k] for k in keys])
            for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
                assert a.asDict().keys() == b.asDict().keys()
                for c in b.asDict():
                    assert a[c] == (pytest.approx(b[c], abs=1e-6) if isinstance(b[c], float) else b[c]), (keys, c, a, b)
    assert evaluate.metrics_by(d, ["k"], least=3).filter("n < 3").count() == 0
    assert evaluate.metrics_by(d.limit(0), ["k"]).count() == 0
    rough = d.groupBy("k").agg(*metrics.regression(accuracy=1000)).filter("k = 'a'").first()
    assert rough.median_ae == pytest.approx(d.filter("k = 'a'").groupBy("k").agg(*metrics.regression()).first().median_ae, rel=0.1)
