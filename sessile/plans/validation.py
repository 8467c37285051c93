"""Queries of folds, resampling, calibration and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessile.functions.clean import anchored, draw, novelty
from sessile.operators import calibrate, evaluate, folds, fusion, quantiles
from sessile.plans.predictions import METRICS
from sessile.roles import SQL, measurements, table

SHARES = (0.70, 0.15, 0.15)
PARTS = ("train", "validation", "internal_test")


def greedy_split(spark, sf_dir):
    """[Q3] Sources to splits by size, furthest below its share first; external sources are pinned."""
    m = measurements(spark, sf_dir, with_id=False)
    external = F.col("v4_split").isin("legacy_external", "prospective_open_external")
    g = m.filter(~external).groupBy("source_group_id").agg(F.count("*").alias("n"))
    own = folds.greedy_bins(g, "source_group_id", "n", SHARES).select("source_group_id", F.element_at(F.array(*map(F.lit, PARTS)), F.col("bin") + 1).alias("part"))
    return own.unionByName(m.filter(external).select("source_group_id", F.lit("external").alias("part")).distinct())


def group_kfold(spark, sf_dir):
    """[E1 E2 Q14] Outer folds of sources, and inner folds within each outer training set."""
    g = measurements(spark, sf_dir, with_id=False).groupBy("source_group_id").agg(F.count("*").alias("n")).cache()
    outer = folds.greedy_bins(g, "source_group_id", "n", [1 / 4] * 4).withColumnRenamed("bin", "outer_fold")
    placed = g.join(outer, "source_group_id")
    out = None
    for k in range(4):
        inner = folds.greedy_bins(placed.filter(F.col("outer_fold") != k), "source_group_id", "n", [1 / 3] * 3).select("source_group_id", F.lit(k).alias("held_out"), F.col("bin").alias("inner_fold"))
        out = inner if out is None else out.unionByName(inner)
    return out.join(placed.select("source_group_id", "outer_fold"), "source_group_id")


def loso_index(spark, sf_dir):
    """[E3] Each source left out once: rows, sources and mean angle of the rest, from totals and not from a cross join."""
    m = measurements(spark, sf_dir, with_id=False)
    g = m.groupBy("source_group_id").agg(F.count("*").alias("test_rows"), F.sum("angle").alias("s"))
    t = g.agg(F.sum("test_rows").alias("rows"), F.count("*").alias("sources"), F.sum("s").alias("total"))
    return g.crossJoin(F.broadcast(t)).select("source_group_id", "test_rows", (F.col("rows") - F.col("test_rows")).alias("train_rows"), (F.col("sources") - 1).alias("train_sources"), F.round((F.col("total") - F.col("s")) / (F.col("rows") - F.col("test_rows")), 6).alias("train_mean"))


def leave_one_liquid(spark, sf_dir):
    """[E6] Metrics of a left-out liquid; training rows are those of surfaces' other liquids; folds may be infeasible."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("observed", F.col("angle")).withColumn("predicted", F.col("pred_a"))
    n = evaluate.metrics_by(m, ["liquid_name"])
    own = m.groupBy("liquid_name").agg(F.count("*").alias("own"))
    total = m.agg(F.count("*").alias("rows"))
    f = own.crossJoin(F.broadcast(total)).select("liquid_name", (F.col("rows") - F.col("own")).alias("train_rows"), F.when(F.col("rows") - F.col("own") >= 20, "yes").otherwise("no").alias("feasible"))
    return n.join(f, "liquid_name")


def leave_one_group(spark, sf_dir):
    """[E7 A16] The same by family: a group's rows are predicted by the mean residual of the others."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("r", F.col("angle") - F.col("pred_a"))
    g = m.groupBy("solid_family").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    t = g.agg(F.sum("n").alias("rows"), F.sum("s").alias("total"))
    shift = g.crossJoin(F.broadcast(t)).filter(F.col("rows") - F.col("n") >= 20).select("solid_family", ((F.col("total") - F.col("s")) / (F.col("rows") - F.col("n"))).alias("shift"))
    d = m.join(F.broadcast(shift), "solid_family").select("solid_family", F.col("angle").alias("observed"), anchored("pred_a", "shift").alias("predicted"))
    return evaluate.metrics_by(d, ["solid_family"])


def seeded_split(spark, sf_dir):
    """[W9] Orders in the order of a seeded draw, cut 60 / 20 / 20."""
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return folds.seeded_split(o, "o_orderkey", 42, (("train", 0.6), ("validation", 0.2), ("test", 0.2))).select("o_orderkey", "part")


def _clusters(m, keys, cluster):
    g = m.groupBy(*keys, F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("angle") - F.col("pred_b"))).alias("ea"), F.sum(F.abs(F.col("angle") - F.col("pred_a"))).alias("eb"))
    return folds.ranked(g, keys, F.col("cluster"), F.floor(F.col("cluster") / 4096), [], "idx").withColumn("idx", (F.col("idx") - 1).cast("long"))


def cluster_bootstrap(spark, sf_dir):
    """[E9] pred_b less pred_a over source clusters, 200 resamples."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("scope", F.lit("all"))
    return folds.bootstrap(_clusters(m, ["scope"], "source_group_id"), ["scope"], 200, 7)


def bootstrap_grid(spark, sf_dir):
    """[E9a] By split and kind of cluster, 40 resamples."""
    m = measurements(spark, sf_dir, with_id=False)
    out = None
    for kind in ("source_group_id", "surface_group_id"):
        c = _clusters(m, ["v4_split"], kind).withColumn("kind", F.lit(kind))
        out = c if out is None else out.unionByName(c)
    return folds.bootstrap(out, ["v4_split", "kind"], 40, 11)


def balanced_resample(spark, sf_dir):
    """[M10] 10,000 draws: a source, evenly, then one of its rows, evenly."""
    m = measurements(spark, sf_dir)
    rows = folds.ranked(m.select("measurement_id", "source_group_id"), ["source_group_id"], F.col("measurement_id"), F.shiftright("measurement_id", 20), [], "row").withColumn("row", (F.col("row") - 1).cast("long"))
    g = m.groupBy("source_group_id").agg(F.count("*").alias("n"))
    s = folds.ranked(g, [], F.col("source_group_id"), F.floor(F.col("source_group_id") / 4096), [], "idx").withColumn("idx", (F.col("idx") - 1).cast("long"))
    k = g.count()
    d = spark.range(1, 10001).select(F.col("id").alias("draw"), (draw(F.lit("s"), "id") % k).alias("idx"), draw(F.lit("r"), "id").alias("u"))
    return d.join(s, "idx").withColumn("row", F.col("u") % F.col("n")).join(rows, ["source_group_id", "row"]).select("draw", "measurement_id", "source_group_id")


def learning_curve(spark, sf_dir):
    """[E5 A13] Train on drawn subsets of sources (5 for each size), test on all others: the mean residual as the model."""
    m = measurements(spark, sf_dir, with_id=False).select("source_group_id", "angle", "pred_a")
    s = m.select("source_group_id").distinct()
    sub = s.crossJoin(spark.range(1, 4).select(F.col("id").alias("size"))).crossJoin(spark.range(1, 6).select(F.col("id").alias("subset")))
    w = Window.partitionBy("size", "subset").orderBy(draw("size", "subset", "source_group_id"), "source_group_id")
    chosen = sub.withColumn("rn", F.row_number().over(w)).filter("rn <= size").select("size", "subset", "source_group_id", F.lit(True).alias("in_train"))
    pool = chosen.select("size", "subset").distinct()
    r = m.join(chosen, "source_group_id").groupBy("size", "subset").agg(F.avg(F.col("angle") - F.col("pred_a")).alias("shift"))
    test = m.crossJoin(F.broadcast(pool)).join(F.broadcast(chosen), ["size", "subset", "source_group_id"], "left_anti").join(F.broadcast(r), ["size", "subset"])
    return test.groupBy("size", "subset").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("angle") - anchored("pred_a", "shift"))), 6).alias("mae"))


def residual_baselines(spark, sf_dir):
    """[E10 J12 P22] Mean residual of the training split, overall and by liquid (drawn to it), on the other splits."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("residual", F.col("angle") - F.col("pred_a"))
    overall, each = calibrate.residual_means(m.filter("v4_split = 'train' AND liquid_id <> 7"), "liquid_id", 50.0)
    d = m.filter("v4_split <> 'train'").join(F.broadcast(each), "liquid_id", "left").crossJoin(F.broadcast(overall))
    d = d.select("v4_split", F.col("angle").alias("observed"), anchored("pred_a", "overall").alias("global_mean"), anchored("pred_a", F.coalesce("group_mean", "overall")).alias("liquid_mean"))
    return evaluate.metrics_by(evaluate.long_form(d, ["v4_split", "observed"], ("global_mean", "liquid_mean")), ["v4_split", "model"])


def _conformal(spark, sf_dir):
    m = measurements(spark, sf_dir, with_id=False).withColumn("fold", (draw(F.lit("fold"), "source_group_id") % 5).cast("int"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), c.alias("scale")) for k, c in (("constant", F.lit(1.0)), ("uncertainty", F.col("score")), ("root", F.sqrt("score")))]))
    d = m.select("fold", "angle", "pred_a", kinds.alias("k")).select("*", "k.*").drop("k")
    return d.withColumn("score", F.round(F.abs(F.col("angle") - F.col("pred_a")) / F.col("scale"), 9))


def conformal_cv(spark, sf_dir):
    """[E11 W8 O3 A9] Intervals of each fold by the order statistic of the other folds; the narrowest valid method is chosen."""
    d = _conformal(spark, sf_dir)
    counts = d.groupBy("method", "fold", "score").agg(F.count("*").alias("times"))  # before it is dealt to the other folds
    other = counts.withColumn("target", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda x: x != F.col("fold")))).select("method", "target", "score", "times")
    q = calibrate.order_statistic(other, ["method", "target"], 0.9, weight=F.col("times")).select("method", F.col("target").alias("fold"), "quantile")
    half = F.col("quantile") * F.col("scale")
    out = d.join(F.broadcast(q), ["method", "fold"]).withColumn("lower", F.greatest(F.col("pred_a") - half, F.lit(0.0))).withColumn("upper", F.least(F.col("pred_a") + half, F.lit(180.0)))
    inside = ((F.col("angle") >= F.col("lower")) & (F.col("angle") <= F.col("upper"))).cast("double")
    g = out.groupBy("method").agg(F.round(F.avg(inside), 6).alias("coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 6).alias("width"))
    valid = F.col("coverage").between(0.85, 0.95)
    rank = F.row_number().over(Window.orderBy(F.when(valid, 0).otherwise(1), F.when(valid, F.col("width")).otherwise(F.abs(F.col("coverage") - 0.9)), "method"))
    return g.withColumn("chosen", F.when(rank == 1, "yes").otherwise("no"))


def conformal_apply(spark, sf_dir):
    """[E12 E14 P16] Intervals with a given quantile, abstention above the 80th percentile of uncertainty, and risk tiers."""
    m = measurements(spark, sf_dir)
    d = m.withColumn("cut", F.lit(quantiles.whole_quantiles(m, F.col("score"), {"cut": 0.8})["cut"]))
    abstain = F.col("score") > F.col("cut")
    risk = F.when(abstain, "high").when((F.col("score") > 0.75 * F.col("cut")) | (F.col("solid_family") == "PROMO"), "medium").otherwise("low")
    half = 2.5 * F.col("score")
    return d.select("measurement_id", F.round(F.greatest(F.col("pred_a") - half, F.lit(0.0)), 6).alias("lower"), F.round(F.least(F.col("pred_a") + half, F.lit(180.0)), 6).alias("upper"), F.when(abstain, "yes").otherwise("no").alias("abstain"), risk.alias("risk"))


def knn_ood(spark, sf_dir):
    """[E13] Distance to the 5th nearest training vector over the 95th percentile of the training vectors' own."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    train = e.filter("label % 2 = 0").select("id", "vector")
    d = calibrate.nearest_distance(train, e.select("id", "vector"), 5).join(e.select("id", "label"), "id").cache()
    cut = max(quantiles.whole_quantiles(d.filter("label % 2 = 0"), F.col("distance"), {"cut": 0.95})["cut"] or 0.0, 1e-8)
    return d.withColumn("cut", F.lit(cut)).select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"), F.round(F.col("distance") / F.col("cut"), 5).alias("ratio"))


def _weights(step: int, near: tuple[int, int] | None = None, unit: int = 20):
    """Weights (a, b, rest) on a grid of units, all or those near a pair."""
    return [(a, b) for a in range(0, unit + 1, step) for b in range(0, unit + 1 - a, step) if near is None or (abs(a - near[0]) <= 4 and abs(b - near[1]) <= 4)]


def simplex_fusion(spark, sf_dir):
    """[E15] Weights of three experts on the simplex of least mean Huber loss: a coarse grid, then a finer one round its best, each in one pass. convex_fusion has the solver for any number of experts."""
    return fused(measurements(spark, sf_dir, with_id=False))


def fused(m):
    """[E15] simplex_fusion of rows that have been read."""
    spark, m = m.sparkSession, m.select("angle", "pred_a", "pred_b", F.lit(90.0).alias("mean"))

    def best(grid):
        points = np.array([(a / 20, b / 20, (20 - a - b) / 20) for a, b in grid])
        n, loss, *_ = fusion.huber_pass(m, ("pred_a", "pred_b", "mean"), "angle", points, 5.0, slopes=False)
        return min((round(x / max(n, 1), 6), a, b) for x, (a, b) in zip(loss.tolist(), grid, strict=True))

    _, a, b = best(_weights(4))
    huber, a, b = best(_weights(1, (a, b)))
    return spark.createDataFrame([(a / 20, b / 20, (20 - a - b) / 20, float(huber))], "w_a double, w_b double, w_mean double, huber double")


def drop_expert(spark, sf_dir):
    """[E16] Equal weights over all experts, and over all but one."""
    m = measurements(spark, sf_dir, with_id=False)
    e = {"pred_a": F.col("pred_a"), "pred_b": F.col("pred_b"), "mean": F.lit(90.0)}
    d = m.select("v4_split", F.col("angle").alias("observed"), *[(sum((v for k, v in e.items() if k != out), F.lit(0.0)) / (3 - (out is not None))).alias(f"without_{out}" if out else "all") for out in (None, *e)])
    return evaluate.metrics_by(evaluate.long_form(d, ["v4_split", "observed"], ("all", *[f"without_{k}" for k in e])), ["v4_split", "model"])


def novelty_strata(spark, sf_dir):
    """[E17 P13 A13] Metrics by whether the training sources of a row's fold know its material and liquid."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("fold", (draw(F.lit("n"), "source_group_id") % 4).cast("int")).withColumn("material", F.concat_ws("/", "solid_name", F.col("surface_group_id") % 100))
    m = m.filter(F.col("target_eligible") == "yes")
    other = m.select("material", "liquid_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x != F.col("fold"))).alias("fold"))
    mats = other.select("fold", "material").distinct().withColumn("km", F.lit(True))
    liqs = other.filter("fold <> liquid_id % 4").select("fold", "liquid_id").distinct().withColumn("kl", F.lit(True))
    d = m.join(mats, ["fold", "material"], "left").join(F.broadcast(liqs), ["fold", "liquid_id"], "left")
    d = d.select(F.col("angle").alias("observed"), F.col("pred_a").alias("predicted"), novelty(F.coalesce("km", F.lit(False)), F.coalesce("kl", F.lit(False))).alias("stratum"))
    return evaluate.metrics_by(d, ["stratum"])


def case_selection(spark, sf_dir):
    """[W5 W6] The rows nearest to three ranks of error, each on another surface."""
    m = measurements(spark, sf_dir).select("measurement_id", "surface_group_id", F.round(F.abs(F.col("angle") - F.col("pred_a")), 6).alias("error"))
    n = m.count()
    counts = m.groupBy("error").agg(F.count("*").alias("ties"))
    # Values are counted by bucket first, so that no task has them all.
    counts = counts.withColumn("bucket", F.floor(F.col("error") * 64))
    before = counts.groupBy("bucket").agg(F.sum("ties").alias("here")).withColumn("before", F.sum("here").over(Window.orderBy("bucket")) - F.col("here")).drop("here")
    below = counts.join(before, "bucket").withColumn("upto", F.col("before") + F.sum("ties").over(Window.partitionBy("bucket").orderBy("error"))).drop("bucket", "before")
    d = m.join(below, "error").select("*", F.round((F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2) / n, 9).alias("rank"))
    out, used = None, None
    for target in (0.1, 0.5, 0.9):
        free = d if used is None else d.join(F.broadcast(used), "surface_group_id", "left_anti")
        top = free.withColumn("distance", F.round(F.abs(F.col("rank") - target), 9)).orderBy("distance", "measurement_id").limit(1).select(F.lit(target).alias("target"), "measurement_id", "surface_group_id", "rank")
        one = spark.createDataFrame(top.collect(), "target double, measurement_id long, surface_group_id long, rank double")
        out = one if out is None else out.unionByName(one)
        used = out.select("surface_group_id")
    return out


def select_config(spark, sf_dir):
    """[O1 O2 O4 J17 A19] A grid of settings scored on each split: best within a tolerance, then simplest; the choice of most splits."""
    m = measurements(spark, sf_dir, with_id=False)
    grid = spark.createDataFrame([(2,), (3,), (4,)], "depth int").crossJoin(spark.createDataFrame([(0.1,), (1.0,)], "alpha double"))
    g = m.groupBy("v4_split").agg(F.avg(F.abs(F.col("angle") - F.col("pred_a"))).alias("a"), F.avg(F.abs(F.col("angle") - F.col("pred_b"))).alias("b"))
    s = g.crossJoin(F.broadcast(grid)).select("v4_split", "depth", "alpha", F.round(F.col("a") / F.col("depth") + F.col("b") * F.col("alpha") / 10, 6).alias("score"))
    w = Window.partitionBy("v4_split")
    near = s.withColumn("best", F.min("score").over(w)).filter(F.col("score") <= F.col("best") + 0.8)
    chosen = near.withColumn("rn", F.row_number().over(w.orderBy("depth", F.desc("alpha"), "score"))).filter("rn = 1")
    mode = chosen.groupBy("depth", "alpha").agg(F.count("*").alias("votes"), F.round(F.avg("score"), 6).alias("mean_score"))
    return mode.withColumn("place", F.row_number().over(Window.orderBy(F.desc("votes"), "mean_score", "depth", "alpha")))


def source_weights(spark, sf_dir):
    """[W1] Weights 1 / sqrt(rows of the source), scaled to mean 1."""
    g = measurements(spark, sf_dir, with_id=False).groupBy("source_group_id").agg(F.count("*").alias("n"))
    t = g.agg((F.sum(F.sqrt("n")) / F.sum("n")).alias("mean"))
    return g.crossJoin(F.broadcast(t)).select("source_group_id", "n", F.round(1 / F.sqrt("n") / F.col("mean"), 6).alias("weight"))


GATES = (("mae", 18.0, "max"), ("rmse", 22.0, "max"), ("r2", 0.5, "min"), ("p90_ae", 12.0, "max"))


def acceptance_gates(spark, sf_dir):
    """[Q13 Q14 Q18] Each split's metrics against thresholds, with its status."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("observed", F.col("angle")).withColumn("predicted", F.col("pred_a"))
    d = evaluate.metrics_by(m, ["v4_split"]).unpivot(["v4_split"], [k for k, _, _ in GATES], "metric", "value")
    t = spark.createDataFrame(list(GATES), "metric string, threshold double, kind string")
    d = d.join(F.broadcast(t), "metric").withColumn("pass", F.when(F.col("kind") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")))
    s = d.groupBy("v4_split").agg(F.when(F.bool_and("pass"), "accepted").otherwise("conditional").alias("status"))
    return d.join(s, "v4_split").select("v4_split", "metric", "value", "threshold", "pass", "status")


_OWN = "greedy_split group_kfold loso_index leave_one_liquid leave_one_group seeded_split cluster_bootstrap bootstrap_grid balanced_resample learning_curve residual_baselines conformal_cv conformal_apply knn_ood simplex_fusion drop_expert novelty_strata case_selection select_config source_weights acceptance_gates"
QUERIES = {k: globals()[k] for k in _OWN.split()}


def _greedy(source: str, name: str, shares: str, extra: str = "") -> str:
    """Recursive CTE: one group at a time to the bin furthest below its share."""
    return f"""{name}_g AS (SELECT source_group_id, n, {extra or '0'} AS x, row_number() OVER ({'PARTITION BY ' + extra if extra else ''} ORDER BY n DESC, source_group_id DESC) AS i, sum(n) OVER ({'PARTITION BY ' + extra if extra else ''}) AS total FROM {source}),
{name}_r(x, i, source_group_id, loads, bin) AS (
  SELECT DISTINCT x, 0::BIGINT, NULL::BIGINT, list_transform({shares}, lambda f: 0.0::DOUBLE), NULL::INT FROM {name}_g
  UNION ALL SELECT x, i, source_group_id, list_transform(loads, lambda l, k: CASE WHEN k = best THEN l + n ELSE l END), (best - 1)::INT FROM (
    SELECT g.x, g.i, g.source_group_id, g.n, r.loads, list_position(list_transform(r.loads, lambda l, k: {shares}[k] * g.total - l), list_max(list_transform(r.loads, lambda l, k: {shares}[k] * g.total - l))) AS best
    FROM {name}_r r JOIN {name}_g g ON g.x = r.x AND g.i = r.i + 1))"""


_D = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"
_REC = SQL.replace("WITH liq", "WITH RECURSIVE liq", 1)
_E = "abs(angle - {})"


def _metrics(observed: str, predicted: str) -> str:
    return METRICS.replace("angle", observed).replace("predicted", predicted)


def _boot(keys: str, b: int, seed: int, clusters: str) -> str:
    on = " AND ".join(f"d.{k} = c.{k}" for k in keys.split(", "))
    return f"""{clusters}, i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cluster) - 1 AS idx FROM c0), z AS (SELECT {keys}, count(*) AS c FROM i GROUP BY ALL),
d AS (SELECT {keys}, b, {_D.format(f"{seed}, b, j")} % c AS idx FROM z, range(1, {b + 1}) r(b), LATERAL (SELECT unnest(range(1, c + 1)) AS j)),
e AS (SELECT {', '.join('d.' + k for k in keys.split(', '))}, b, (sum(ea) - sum(eb)) / sum(n) AS d FROM d JOIN i c ON {on} AND d.idx = c.idx GROUP BY ALL),
p AS (SELECT {keys}, round((sum(ea) - sum(eb)) / sum(n), 6) AS point, count(*) AS clusters FROM i GROUP BY ALL),
q AS (SELECT {keys}, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d < 0)::INT), 6) AS p_better FROM e GROUP BY ALL)
SELECT * FROM p JOIN q USING ({keys})"""


_C0 = "SELECT {k}, {c} AS cluster, count(*) AS n, sum(abs(angle - pred_b)) AS ea, sum(abs(angle - pred_a)) AS eb FROM m GROUP BY ALL"


def _grid(step: int, near: str = "") -> str:
    return f"SELECT a, b FROM range(0, 21, {step}) x(a), range(0, 21, {step}) y(b) WHERE a + b <= 20 {near}"


_LOSS = "round(avg(CASE WHEN abs(e) <= 5 THEN 0.5 * e * e ELSE 5 * (abs(e) - 2.5) END), 6)"
_FUSE = "(SELECT a, b, angle - (a / 20::DOUBLE * pred_a + b / 20::DOUBLE * pred_b + (20 - a - b) / 20::DOUBLE * 90) AS e FROM m, {g})"
ORACLES = {
    "greedy_split": _REC + ", s AS (SELECT source_group_id, count(*) AS n FROM m WHERE v4_split NOT IN ('legacy_external', 'prospective_open_external') GROUP BY 1), " + _greedy("s", "k", "[0.70::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE]")
        + " SELECT source_group_id, ['train', 'validation', 'internal_test'][bin + 1] AS part FROM k_r WHERE i > 0 UNION ALL SELECT DISTINCT source_group_id, 'external' FROM m WHERE v4_split IN ('legacy_external', 'prospective_open_external')",
    "group_kfold": _REC + ", s AS (SELECT source_group_id, count(*) AS n FROM m GROUP BY 1), " + _greedy("s", "o", "[0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE]")
        + ", t AS (SELECT s.source_group_id, n, h, bin AS outer_fold FROM s JOIN o_r USING (source_group_id), range(0, 4) r(h) WHERE bin <> h AND i > 0), " + _greedy("t", "i", "[1/3::DOUBLE, 1/3::DOUBLE, 1/3::DOUBLE]", "h")
        + " SELECT i_r.source_group_id, i_r.x::INT AS held_out, i_r.bin AS inner_fold, o_r.bin AS outer_fold FROM i_r JOIN o_r ON i_r.source_group_id = o_r.source_group_id AND i_r.i > 0 AND o_r.i > 0",
    "loso_index": SQL + "SELECT source_group_id, count(*) AS test_rows, (SELECT count(*) FROM m) - count(*) AS train_rows, (SELECT count(DISTINCT source_group_id) FROM m) - 1 AS train_sources, round(((SELECT sum(angle) FROM m) - sum(angle)) / ((SELECT count(*) FROM m) - count(*)), 6) AS train_mean FROM m GROUP BY 1",
    "leave_one_liquid": SQL + f"SELECT liquid_name, {_metrics('angle', 'pred_a')}, (SELECT count(*) FROM m) - count(*) AS train_rows, CASE WHEN (SELECT count(*) FROM m) - count(*) >= 20 THEN 'yes' ELSE 'no' END AS feasible FROM m GROUP BY 1",
    "leave_one_group": SQL + f", x AS (SELECT *, least(greatest(pred_a + (SELECT avg(o.angle - o.pred_a) FROM m o WHERE o.solid_family <> m.solid_family), 0), 180) AS fitted FROM m) SELECT solid_family, {_metrics('angle', 'fitted')} FROM x GROUP BY 1",
    "seeded_split": f"WITH o AS (SELECT DISTINCT o_orderkey FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_D.format('42, o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM o) SELECT o_orderkey, CASE WHEN r <= round_even(0.6::DOUBLE * n, 0) THEN 'train' WHEN r <= round_even((0.6::DOUBLE + 0.2::DOUBLE) * n, 0) THEN 'validation' ELSE 'test' END AS part FROM r",
    "cluster_bootstrap": SQL + ", c0 AS (" + _C0.format(k="'all' AS scope", c="source_group_id") + ")" + _boot("scope", 200, 7, ""),
    "bootstrap_grid": SQL + ", c0 AS (" + _C0.format(k="v4_split, 'source_group_id' AS kind", c="source_group_id") + " UNION ALL " + _C0.format(k="v4_split, 'surface_group_id' AS kind", c="surface_group_id") + ")" + _boot("v4_split, kind", 40, 11, ""),
    "balanced_resample": SQL + f""", r AS (SELECT measurement_id, source_group_id, row_number() OVER (PARTITION BY source_group_id ORDER BY measurement_id) - 1 AS row FROM m), s AS (SELECT source_group_id, count(*) AS n, row_number() OVER (ORDER BY source_group_id) - 1 AS idx FROM m GROUP BY 1)
SELECT i AS draw, measurement_id, s.source_group_id FROM range(1, 10001) d(i) JOIN s ON idx = {_D.format("'s', i")} % (SELECT count(*) FROM s) JOIN r ON r.source_group_id = s.source_group_id AND r.row = {_D.format("'r', i")} % n""",
    "learning_curve": SQL + f""", s AS (SELECT DISTINCT source_group_id FROM m), c AS (SELECT size, subset, source_group_id, row_number() OVER (PARTITION BY size, subset ORDER BY {_D.format('size, subset, source_group_id')}, source_group_id) AS rn FROM s, range(1, 4) a(size), range(1, 6) b(subset)),
t AS (SELECT size, subset, source_group_id FROM c WHERE rn <= size), f AS (SELECT size, subset, avg(angle - pred_a) AS shift FROM m JOIN t USING (source_group_id) GROUP BY ALL)
SELECT size, subset, count(*) AS n, round(avg(abs(angle - least(greatest(pred_a + shift, 0), 180))), 6) AS mae FROM m JOIN c USING (source_group_id) JOIN f USING (size, subset) WHERE rn > size GROUP BY ALL""",
    "residual_baselines": SQL + f""", t AS (SELECT * FROM m WHERE v4_split = 'train' AND liquid_id <> 7), g AS (SELECT avg(angle - pred_a) AS o FROM t), l AS (SELECT liquid_id, (sum(angle - pred_a) + 50 * any_value(o)) / (count(*) + 50) AS lm FROM t, g GROUP BY 1),
x AS (SELECT v4_split, angle, least(greatest(pred_a + o, 0), 180) AS gm, least(greatest(pred_a + coalesce(lm, o), 0), 180) AS lq FROM m CROSS JOIN g LEFT JOIN l ON m.liquid_id = l.liquid_id WHERE v4_split <> 'train')
SELECT v4_split, 'global_mean' AS model, {_metrics('angle', 'gm')} FROM x GROUP BY 1 UNION ALL SELECT v4_split, 'liquid_mean', {_metrics('angle', 'lq')} FROM x GROUP BY 1""",
    "conformal_cv": SQL + f""", f AS (SELECT *, {_D.format("'fold', source_group_id")} % 5 AS fold FROM m), d AS (SELECT measurement_id, fold, angle, pred_a, method, scale, round(abs(angle - pred_a) / scale, 9) AS s FROM f, LATERAL (VALUES ('constant', 1.0::DOUBLE), ('uncertainty', score), ('root', sqrt(score))) k(method, scale)),
o AS (SELECT method, t, s, row_number() OVER (PARTITION BY method, t ORDER BY s, measurement_id) AS rn, count(*) OVER (PARTITION BY method, t) AS n FROM d, range(0, 5) r(t) WHERE t <> fold), q AS (SELECT method, t AS fold, s AS q FROM o WHERE rn = least(ceil((n + 1) * 0.9::DOUBLE) + 1, n)),
i AS (SELECT method, angle, greatest(pred_a - q * scale, 0) AS lo, least(pred_a + q * scale, 180) AS hi FROM d JOIN q USING (method, fold)), g AS (SELECT method, round(avg((angle >= lo AND angle <= hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM i GROUP BY 1)
SELECT method, coverage, width, CASE WHEN row_number() OVER (ORDER BY CASE WHEN coverage BETWEEN 0.85 AND 0.95 THEN 0 ELSE 1 END, CASE WHEN coverage BETWEEN 0.85 AND 0.95 THEN width ELSE abs(coverage - 0.9) END, method) = 1 THEN 'yes' ELSE 'no' END AS chosen FROM g""",
    "conformal_apply": SQL + """, c AS (SELECT quantile_cont(score, 0.8) AS cut FROM m) SELECT measurement_id, round(greatest(pred_a - 2.5::DOUBLE * score, 0), 6) AS lower, round(least(pred_a + 2.5::DOUBLE * score, 180), 6) AS upper, CASE WHEN score > cut THEN 'yes' ELSE 'no' END AS abstain,
  CASE WHEN score > cut THEN 'high' WHEN score > 0.75::DOUBLE * cut OR solid_family = 'PROMO' THEN 'medium' ELSE 'low' END AS risk FROM m, c""",
    "knn_ood": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT q.vec_id, q.label, list_distance(q.v, t.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v)) AS rn FROM e q, e t WHERE t.label % 2 = 0),
k AS (SELECT vec_id, label, d FROM p WHERE rn = 5), c AS (SELECT greatest(quantile_cont(d, 0.95), 1e-8) AS cut FROM k WHERE label % 2 = 0) SELECT vec_id, round(d, 5) AS distance, round(d / cut, 5) AS ratio FROM k, c""",
    "simplex_fusion": SQL + f""", g1 AS ({_grid(4)}), l1 AS (SELECT a, b, {_LOSS} AS l FROM {_FUSE.format(g='g1')} GROUP BY ALL), b1 AS (SELECT a AS a0, b AS b0 FROM l1 ORDER BY l, a, b LIMIT 1),
g2 AS (SELECT a, b FROM b1, range(0, 21) x(a), range(0, 21) y(b) WHERE a + b <= 20 AND abs(a - a0) <= 4 AND abs(b - b0) <= 4), l2 AS (SELECT a, b, {_LOSS} AS l FROM {_FUSE.format(g='g2')} GROUP BY ALL)
SELECT a / 20::DOUBLE AS w_a, b / 20::DOUBLE AS w_b, (20 - a - b) / 20::DOUBLE AS w_mean, l AS huber FROM l2 ORDER BY l, a, b LIMIT 1""",
    "drop_expert": SQL + ", x AS (SELECT v4_split, angle, model, p FROM m, LATERAL (VALUES ('all', (pred_a + pred_b + 90) / 3), ('without_pred_a', (pred_b + 90) / 2), ('without_pred_b', (pred_a + 90) / 2), ('without_mean', (pred_a + pred_b) / 2)) k(model, p)) SELECT v4_split, model, " + _metrics("angle", "p") + " FROM x GROUP BY ALL",
    "novelty_strata": SQL + f""", f AS (SELECT *, {_D.format("'n', source_group_id")} % 4 AS fold, solid_name || '/' || surface_group_id % 100 AS mat FROM m WHERE target_eligible = 'yes'),
k AS (SELECT angle, pred_a, EXISTS (SELECT 1 FROM f o WHERE o.fold <> f.fold AND o.mat = f.mat) AS km, EXISTS (SELECT 1 FROM f o WHERE o.fold <> f.fold AND o.liquid_id = f.liquid_id AND f.fold <> o.liquid_id % 4) AS kl FROM f)
SELECT CASE WHEN km AND kl THEN 'known_material_known_liquid' WHEN km THEN 'known_material_new_liquid' WHEN kl THEN 'new_material_known_liquid' ELSE 'new_material_new_liquid' END AS stratum, {_metrics('angle', 'pred_a')} FROM k GROUP BY 1""",
    "case_selection": SQL + """, e AS (SELECT measurement_id, surface_group_id, round(abs(angle - pred_a), 6) AS error FROM m), r AS (SELECT *, round((rank() OVER (ORDER BY error) + (count(*) OVER (PARTITION BY error) - 1) / 2::DOUBLE) / (count(*) OVER ()), 9) AS rank FROM e),
a AS (SELECT 0.1::DOUBLE AS target, * FROM r ORDER BY round(abs(rank - 0.1::DOUBLE), 9), measurement_id LIMIT 1), b AS (SELECT 0.5::DOUBLE AS target, * FROM r WHERE surface_group_id NOT IN (SELECT surface_group_id FROM a) ORDER BY round(abs(rank - 0.5::DOUBLE), 9), measurement_id LIMIT 1),
c AS (SELECT 0.9::DOUBLE AS target, * FROM r WHERE surface_group_id NOT IN (SELECT surface_group_id FROM a UNION ALL SELECT surface_group_id FROM b) ORDER BY round(abs(rank - 0.9::DOUBLE), 9), measurement_id LIMIT 1)
SELECT target, measurement_id, surface_group_id, rank FROM a UNION ALL SELECT target, measurement_id, surface_group_id, rank FROM b UNION ALL SELECT target, measurement_id, surface_group_id, rank FROM c""",
    "select_config": SQL + """, g AS (SELECT v4_split, avg(abs(angle - pred_a)) AS a, avg(abs(angle - pred_b)) AS b FROM m GROUP BY 1), s AS (SELECT v4_split, depth::INT AS depth, alpha, round(a / depth + b * alpha / 10, 6) AS score FROM g, (VALUES (2), (3), (4)) d(depth), (VALUES (0.1::DOUBLE), (1.0)) e(alpha)),
n AS (SELECT *, min(score) OVER (PARTITION BY v4_split) AS best FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY v4_split ORDER BY depth, alpha DESC, score) AS rn FROM n WHERE score <= best + 0.8::DOUBLE), v AS (SELECT depth, alpha, count(*) AS votes, round(avg(score), 6) AS mean_score FROM c WHERE rn = 1 GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY votes DESC, mean_score, depth, alpha) AS place FROM v""",
    "source_weights": SQL + ", g AS (SELECT source_group_id, count(*) AS n FROM m GROUP BY 1) SELECT source_group_id, n, round(1 / sqrt(n) / (SELECT sum(sqrt(n)) / sum(n) FROM g), 6) AS weight FROM g",
    "acceptance_gates": SQL + f""", k AS (SELECT v4_split, {_metrics('angle', 'pred_a')} FROM m GROUP BY 1), x AS (SELECT v4_split, metric, value, threshold, CASE WHEN kind = 'max' THEN value <= threshold ELSE value >= threshold END AS pass FROM k, LATERAL (VALUES ('mae', mae, 18.0::DOUBLE, 'max'), ('rmse', rmse, 22.0, 'max'), ('r2', r2, 0.5, 'min'), ('p90_ae', p90_ae, 12.0, 'max')) z(metric, value, threshold, kind))
SELECT *, CASE WHEN bool_and(pass) OVER (PARTITION BY v4_split) THEN 'accepted' ELSE 'conditional' END AS status FROM x""",
}
