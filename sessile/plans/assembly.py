"""Queries of assembled feature rows with their guard, and of permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.functions.clean import draw
from sessile.operators import assembled, permute, ridge
from sessile.plans.robust import _SUMS, _X, TWO, _fit, _rows
from sessile.plans.validation import _D
from sessile.roles import SQL, measurements

FOLDS, MOST_PROBES = 5, 6
SURFACE = ["surface_group_id", "v4_split"]


def _parts(spark, sf_dir):
    """Rows with their fold, and beside them the figures of the rows of all other folds; those of one family in seven are left with all folds: a planted leak."""
    m = measurements(spark, sf_dir).withColumn("residual", F.col("angle") - F.col("pred_a")).withColumn("fold", (draw(F.lit("a"), "source_group_id") % FOLDS).cast("int"))
    m = m.withColumn("gp_known", F.when(F.col("liquid_id") != 7, F.col("gp")))
    d = m
    own = F.col("fold")
    for name, value in (("f_gamma", "gamma"), ("f_gp", "gp_known"), ("f_physics", "pred_a")):
        d = d.join(F.broadcast(assembled.by_fold(assembled.cells(m, [], "fold", value), FOLDS, own).withColumnRenamed("figures", name)), "fold")
    unplanted = F.when(F.length("solid_family") % 7 != 0, own)
    for name, key, without in (("f_family", "solid_family", unplanted), ("f_liquid", "liquid_id", own)):
        # a row for each fold and each family or liquid of a fixed list
        d = d.join(F.broadcast(assembled.by_fold(assembled.cells(m, [key], "fold", "residual"), FOLDS, without).withColumnRenamed("figures", name)), [key, "fold"])
    probes = assembled.probe_summary(m, SURFACE, "liquid_id", "angle", MOST_PROBES)
    return d.join(probes, [*SURFACE, "liquid_id"])


def _x(parts):
    return [F.round(v, 6).alias(f"x{k}") for k, v in enumerate(parts)]


def _told(masks):
    return assembled.guard([F.col(f"f_{k}.mask") for k in masks], F.col("fold"), F.col("liquid_id"), F.col("probe_liquids")).alias("guard")


def assembled_probes(spark, sf_dir):
    """[M4 A23] The first version of the feature row: scaled liquid, probes of the surface, training figures of the family; with a guard that tells the planted leak."""
    d = _parts(spark, sf_dir)
    x = [assembled.scaled(F.col("gamma"), F.col("f_gamma")), assembled.scaled(F.col("gp_known"), F.col("f_gp")), F.col("gp_known").isNull().cast("double"), *[F.col(k) for k in ("probes", "has_probes", "mean", "spread", "least", "largest")], F.col("f_family.mean"), F.col("f_family.n").cast("double")]
    return d.select("measurement_id", *_x(x), F.array_join("probe_liquids", ",").alias("probe_liquids"), _told(("gamma", "gp", "family")))


def assembled_physics(spark, sf_dir):
    """[M4] The second version: scaled physics, state of the probes one by one, residuals of the liquid; its guard finds no leak."""
    d = _parts(spark, sf_dir)
    count = F.size("probe_liquids")
    x = [assembled.scaled(F.col("pred_a"), F.col("f_physics")), assembled.scaled(F.col("gamma"), F.col("f_gamma")), *[s.cast("double") for s in (count == 0, count == 1, count >= 2)], F.col("f_liquid.mean"), F.col("f_liquid.spread"), F.col("f_liquid.n").cast("double")]
    return d.select("measurement_id", *_x(x), _told(("gamma", "physics", "liquid")))


REPEATS = 10


def permutation_importance(spark, sf_dir):
    """[E18] A ridge of the training split, and for each of its features the increase of the error on validation rows when its values are dealt anew among all of them, ten times."""
    d = _rows(spark, sf_dir)
    _, model = ridge.fitted(d.filter("v4_split = 'train'"), None, TWO, "residual", (1.0,))
    test = measurements(spark, sf_dir).filter("v4_split = 'validation'").withColumn("size", (F.col("surface_group_id") % 100).cast("double"))
    test = test.withColumn("linear", F.col("pred_a") + ridge.linear(model, TWO))
    numbers = spark.createDataFrame([(f, k) for f in TWO for k in range(1, REPEATS + 1)], "feature string, repeat int")
    drawn = numbers.select("feature", "repeat", *[draw(F.lit("perm"), "feature", "repeat", F.lit(i)).alias(f"k{i}") for i in range(permute.ROUNDS)]).collect()
    keys = [(r.feature, r["repeat"], [r[f"k{i}"] for i in range(permute.ROUNDS)]) for r in drawn]
    return permute.importance(test, "measurement_id", TWO, model[1:], "linear", "angle", keys)


_OWN = "assembled_probes assembled_physics permutation_importance"
QUERIES = {k: globals()[k] for k in _OWN.split()}


_A = SQL + f""", a AS (SELECT *, angle - pred_a AS r, {_D.format("'a', source_group_id")} % 5 AS fold, CASE WHEN liquid_id <> 7 THEN gp END AS g, length(solid_family) % 7 = 0 AS planted FROM m),
k AS (SELECT h, avg(gamma) AS gm, stddev_pop(gamma) AS gs, avg(g) AS pm, stddev_pop(g) AS ps, avg(pred_a) AS fm, stddev_pop(pred_a) AS fs, bit_or(1 << fold) AS mask FROM a, range(0, 5) t(h) WHERE fold <> h GROUP BY 1),
f AS (SELECT h, solid_family, avg(r) AS m, count(*) AS n, bit_or(1 << fold) AS mask FROM a, range(0, 5) t(h) WHERE planted OR fold <> h GROUP BY ALL), l AS (SELECT h, liquid_id, avg(r) AS m, stddev_pop(r) AS s, count(*) AS n, bit_or(1 << fold) AS mask FROM a, range(0, 5) t(h) WHERE fold <> h GROUP BY ALL),
c AS (SELECT surface_group_id, v4_split, liquid_id, count(*) AS n, sum(angle / 180) AS s, sum(angle / 180 * (angle / 180)) AS q, min(angle / 180) AS lo, max(angle / 180) AS hi FROM a GROUP BY ALL),
p AS (SELECT x.surface_group_id, x.v4_split, x.liquid_id, coalesce(sum(y.n), 0) AS n, coalesce(sum(y.s) / sum(y.n), 0) AS m, coalesce(sqrt(greatest(sum(y.q) / sum(y.n) - (sum(y.s) / sum(y.n)) ** 2, 0)), 0) AS s, coalesce(min(y.lo), 0) AS lo, coalesce(max(y.hi), 0) AS hi, coalesce(string_agg(y.liquid_id::VARCHAR, ',' ORDER BY y.liquid_id), '') AS names, count(y.liquid_id) AS c
  FROM c x LEFT JOIN c y ON x.surface_group_id = y.surface_group_id AND x.v4_split = y.v4_split AND x.liquid_id <> y.liquid_id GROUP BY ALL)
"""


def _turn(left, right: int) -> str:
    """One round of the keyed permutation: the left half, changed by a function of the right one."""
    return f"xor(r{left}, (((r{right} * 40503 + k{right}) % 1048583 * 30011 % 16777259) >> 3) & ((1 << h) - 1))"


_Z = "round(coalesce(({v} - {m}) / greatest({s}, 1e-8), 0), 6)"
ORACLES = {
    "assembled_probes": _A + f"""SELECT measurement_id, {_Z.format(v='gamma', m='gm', s='gs')} AS x0, {_Z.format(v='g', m='pm', s='ps')} AS x1, (g IS NULL)::INT::DOUBLE AS x2, p.n::DOUBLE AS x3, (p.n > 0)::INT::DOUBLE AS x4, round(p.m, 6) AS x5, round(p.s, 6) AS x6, round(lo, 6) AS x7, round(hi, 6) AS x8,
  round(coalesce(f.m, 0), 6) AS x9, coalesce(f.n, 0)::DOUBLE AS x10, names AS probe_liquids, CASE WHEN (k.mask | coalesce(f.mask, 0)) & (1 << fold) <> 0 THEN 'fold_leak' ELSE 'disjoint' END AS guard
FROM a JOIN k ON k.h = fold LEFT JOIN f ON f.h = fold AND f.solid_family = a.solid_family JOIN p ON p.surface_group_id = a.surface_group_id AND p.v4_split = a.v4_split AND p.liquid_id = a.liquid_id""",
    "assembled_physics": _A + f"""SELECT measurement_id, {_Z.format(v='pred_a', m='fm', s='fs')} AS x0, {_Z.format(v='gamma', m='gm', s='gs')} AS x1, (p.c = 0)::INT::DOUBLE AS x2, (p.c = 1)::INT::DOUBLE AS x3, (p.c >= 2)::INT::DOUBLE AS x4, round(coalesce(l.m, 0), 6) AS x5, round(coalesce(l.s, 0), 6) AS x6, coalesce(l.n, 0)::DOUBLE AS x7,
  CASE WHEN (k.mask | coalesce(l.mask, 0)) & (1 << fold) <> 0 THEN 'fold_leak' ELSE 'disjoint' END AS guard
FROM a JOIN k ON k.h = fold LEFT JOIN l ON l.h = fold AND l.liquid_id = a.liquid_id JOIN p ON p.surface_group_id = a.surface_group_id AND p.v4_split = a.v4_split AND p.liquid_id = a.liquid_id""",
    "permutation_importance": _X.replace("WITH liq", "WITH RECURSIVE liq", 1) + f""", a AS (SELECT {_SUMS} FROM x WHERE v4_split = 'train'), w AS {_fit('a', 'n', '1.0::DOUBLE')},
t AS (SELECT row_number() OVER (ORDER BY measurement_id) - 1 AS i, angle, score, size, pred_a + b + wx * score + wy * size AS p, wx, wy FROM x, w WHERE v4_split = 'validation'),
z AS (SELECT count(*) AS n, greatest(ceil(length(bin(greatest(count(*) - 1, 1))) / 2.0)::INT, 1) AS h, avg(abs(angle - least(greatest(p, 0), 180))) AS base FROM t),
q AS (SELECT feature, repeat, {', '.join(f"{_D.format(chr(39) + 'perm' + chr(39) + f', feature, repeat, {i}')} AS k{i}" for i in range(4))} FROM (VALUES ('score'), ('size')) f(feature), range(1, 11) r(repeat)),
walk AS (SELECT feature, repeat, i, i AS pos, false AS done FROM t, q
  UNION ALL SELECT feature, repeat, i, (r3 << h) | r4, ((r3 << h) | r4) < n FROM (SELECT *, {_turn(2, 3)} AS r4 FROM (SELECT *, {_turn(1, 2)} AS r3 FROM (SELECT *, {_turn(0, 1)} AS r2 FROM (SELECT *, {_turn('l', 0)} AS r1 FROM (
    SELECT w.*, k0, k1, k2, k3, h, n, pos >> h AS rl, pos & ((1 << h) - 1) AS r0 FROM walk w JOIN q USING (feature, repeat), z WHERE NOT done)))))),
e AS (SELECT k.feature, k.repeat, CASE k.feature WHEN 'score' THEN o.score ELSE o.size END AS v, abs(t.angle - least(greatest(CASE k.feature WHEN 'score' THEN t.p + t.wx * (o.score - t.score) ELSE t.p + t.wy * (o.size - t.size) END, 0), 180)) AS error FROM walk k JOIN t ON t.i = k.i JOIN t o ON o.i = k.pos WHERE done)
SELECT feature, repeat::INT AS repeat, count(*) AS n, round(avg(error) - (SELECT base FROM z), 6) AS increase, round(sum(v), 4) AS dealt FROM e GROUP BY ALL""",
}
