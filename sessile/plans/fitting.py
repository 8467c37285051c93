"""Queries of the star's samples and the grouped fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.functions import physics
from sessile.operators import fits
from sessile.roles import SQL, liquids, measurements


def solved(m):
    return fits.solve(fits.masked(m))


def _fits(spark, sf_dir):
    return solved(measurements(spark, sf_dir, with_id=False))


def nnls_fit(spark, sf_dir):
    """[A14] Status, components and forward cosine for each surface, split and left-out liquid."""
    out = fits.forward(_fits(spark, sf_dir), liquids(spark))
    return out.select(*fits.KEYS, "target_liquid_id", "n_probes", "n_liquids", "fit_status", F.round("d", 4).alias("d"), F.round("p", 4).alias("p"), F.round("cosine", 5).alias("cosine"))


def ols_fit(spark, sf_dir):
    """[A15] The unconstrained fit beside it."""
    out = fits.free_fit(_fits(spark, sf_dir).filter("u1 IS NOT NULL"))
    return out.select(*fits.KEYS, "target_liquid_id", F.round("free_d", 4).alias("free_d"), F.round("free_p", 4).alias("free_p"), "negative")


def physics_forms(spark, sf_dir):
    """[P35 P36 P37] One row per measurement and model, from given components: cosine, clipped or not, error of the cosine's angle by split."""
    m = measurements(spark, sf_dir, with_id=False)
    d, p = F.lit(20.0) + F.col("surface_group_id") % 30, F.col("surface_group_id") % 7
    # A surface and a liquid have one cosine of each model: rows are grouped before they are multiplied by models.
    cosine = {k: physics.raw_cosine(k, d, p, F.col("gamma"), F.col("gd"), F.col("gp")) for k in physics.MODELS}
    told = lambda x: F.struct(F.round(F.max(x), 6).alias("cosine"), F.max(physics.was_clipped(x).cast("int")).alias("clipped"), F.round(F.avg(F.abs(F.cos(F.radians("angle")) - physics.clipped(x))), 6).alias("cosine_error"))
    one = m.withColumns({f"c_{k}": x for k, x in cosine.items()}).groupBy("surface_group_id", "liquid_id").agg(*[told(F.col(f"c_{k}")).alias(k) for k in cosine])
    return one.select("surface_group_id", "liquid_id", F.inline(F.array(*[F.struct(F.lit(k).alias("model"), *[F.col(f"{k}.{x}").alias(x) for x in ("cosine", "clipped", "cosine_error")]) for k in cosine])))


def fit_backfill(spark, sf_dir):
    """[J3 P17 P32 Q2] Fits back on the measurements: feasible or why not, components or 0."""
    return backfilled(measurements(spark, sf_dir), _fits(spark, sf_dir))


def backfilled(m, fitted):
    f = fitted.withColumnRenamed("target_liquid_id", "liquid_id").select(*fits.KEYS, "liquid_id", "fit_status", "d", "p", "n_probes")
    ok = F.col("fit_status").isin("interior_fit", "boundary_fit")
    return m.join(f, [*fits.KEYS, "liquid_id"], "left").select("measurement_id", F.when(ok, "yes").otherwise("no").alias("feasible"), F.when(ok, "").otherwise(F.coalesce("fit_status", F.lit("no_probes"))).alias("reason"), F.round(F.coalesce("d", F.lit(0.0)), 4).alias("d"), F.round(F.coalesce("p", F.lit(0.0)), 4).alias("p"), F.coalesce("n_probes", F.lit(0)).alias("n_probes"))


def masked_samples(spark, sf_dir):
    """[J2 P19 P20] Zero-shot and probe-assisted samples; probes are eligible measurements of the same surface and split with another liquid.

    Lists are built once for each (surface, split, liquid), not for each pair of rows.
    """
    return samples(measurements(spark, sf_dir))


def samples(m):
    eligible = m.filter("target_eligible = 'yes'")
    per = eligible.groupBy(*fits.KEYS, "liquid_id").agg(F.count("*").alias("n"), F.min("measurement_id").alias("first"), F.max("measurement_id").alias("last"), F.first("liquid_name").alias("name"))
    targets = m.select(*fits.KEYS, F.col("liquid_id").alias("target")).distinct()
    masked = targets.join(per, fits.KEYS).filter("liquid_id <> target").groupBy(*fits.KEYS, "target").agg(F.sum("n").alias("n_probes"), F.min("first").alias("first_probe"), F.max("last").alias("last_probe"), F.array_join(F.array_sort(F.collect_list("name")), ";").alias("liquids"))
    base = eligible.select("measurement_id", *fits.KEYS, F.col("liquid_id").alias("target"))
    zero = base.select("measurement_id", F.lit("zero_shot").alias("mode"))
    probe = base.join(masked, [*fits.KEYS, "target"]).select("measurement_id", F.lit("probe_assisted").alias("mode"), "n_probes", "first_probe", "last_probe", "liquids")
    return zero.unionByName(probe, allowMissingColumns=True)


def eligibility_reason(spark, sf_dir):
    """[P28 P29 J6] Why a sample is primary or not, in order."""
    m = measurements(spark, sf_dir)
    f = _fits(spark, sf_dir).withColumnRenamed("target_liquid_id", "liquid_id").select(*fits.KEYS, "liquid_id", "fit_status", "n_liquids", "d", "p")
    reason = (F.when(F.coalesce("n_liquids", F.lit(0)) < 3, "too_few_liquids").when(~F.col("fit_status").isin("interior_fit", "boundary_fit"), F.col("fit_status")).when(F.col("d").isNull() | F.col("p").isNull(), "not_finite").when((F.col("d") < 0) | (F.col("p") < 0), "negative").otherwise("primary"))
    return m.filter("target_eligible = 'yes'").join(f, [*fits.KEYS, "liquid_id"], "left").groupBy("v4_split", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("surface_group_id").alias("surfaces"))


def independent_gate(spark, sf_dir):
    """[P30 P31 P32] A descriptor counts only if its type is allowed and both parts are present and not negative."""
    m = measurements(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("literature_reported", "independent_probe", "inferred", "unknown"))), (F.col("surface_group_id") % 4 + 1).cast("int"))
    d = F.when(F.col("surface_group_id") % 5 != 0, 20.0 + F.col("surface_group_id") % 11)
    p = F.col("surface_group_id") % 9 - 1.0
    ok = kind.isin("literature_reported", "independent_probe") & d.isNotNull() & (d >= 0) & (p >= 0)
    grade = F.when(F.col("score") > 9, "c_low").otherwise("b")
    return m.select("measurement_id", F.when(ok, "yes").otherwise("no").alias("has_independent"), F.coalesce(F.when(ok, d), F.lit(0.0)).alias("d"), F.when(ok, p).alias("p"), F.when(grade == "c_low", "no").otherwise("yes").alias("eligible"))


QUERIES = {f.__name__: f for f in (nnls_fit, ols_fit, physics_forms, fit_backfill, masked_samples, eligibility_reason, independent_gate)}

#: Independent of the operator: sums over pairs of rows, not over partial sums.
FITS = SQL + """, t AS (SELECT DISTINCT surface_group_id, v4_split, liquid_id AS target FROM m),
pr AS (SELECT surface_group_id, v4_split, liquid_id, sqrt(gd) AS x1, sqrt(gp) AS x2, gamma * (1 + cos(radians(angle))) / 2 AS y FROM m WHERE target_eligible = 'yes'),
s AS (SELECT t.surface_group_id, t.v4_split, target, count(x1) AS n, count(DISTINCT liquid_id) AS k, sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(x1*y) AS s1y, sum(x2*y) AS s2y, sum(y*y) AS syy, max(atan2(x2, x1)) - min(atan2(x2, x1)) AS w
  FROM t LEFT JOIN pr ON t.surface_group_id = pr.surface_group_id AND t.v4_split = pr.v4_split AND pr.liquid_id <> t.target GROUP BY ALL),
u AS (SELECT *, CASE WHEN n < 2 OR k < 2 THEN 'insufficient_probes' WHEN w <= 1e-12 THEN 'singular_fit' END AS st FROM s),
v AS (SELECT *, CASE WHEN st IS NULL THEN (s1y*s22 - s2y*s12) / (s11*s22 - s12*s12) END AS u1, CASE WHEN st IS NULL THEN (s2y*s11 - s1y*s12) / (s11*s22 - s12*s12) END AS u2,
  CASE WHEN s11 > 0 THEN s1y/s11 ELSE 0 END AS e1, CASE WHEN s22 > 0 THEN s2y/s22 ELSE 0 END AS e2 FROM u),
b AS (SELECT *, CASE WHEN u1 IS NULL THEN NULL WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN syy - e1*s1y <= syy - e2*s2y THEN e1 ELSE 0 END AS b1,
  CASE WHEN u1 IS NULL THEN NULL WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN syy - e1*s1y <= syy - e2*s2y THEN 0 ELSE e2 END AS b2 FROM v),
f AS (SELECT surface_group_id, v4_split, target, n AS n_probes, k AS n_liquids, coalesce(st, CASE WHEN b1 <= 1e-10 OR b2 <= 1e-10 THEN 'boundary_fit' ELSE 'interior_fit' END) AS fit_status, b1*b1 AS d, b2*b2 AS p, u1, u2 FROM b)
"""
_COS = {
    "owens_wendt": "2 * (sqrt(d*gd) + sqrt(p*gp)) / gamma - 1",
    "harmonic_mean": "(CASE WHEN d+gd > 0 THEN 4*d*gd/(d+gd) ELSE 0 END + CASE WHEN p+gp > 0 THEN 4*p*gp/(p+gp) ELSE 0 END) / gamma - 1",
    "weighted_geometric": "2 * (0.9::DOUBLE * (sqrt(d*gd) + sqrt(p*gp)) + 0.1::DOUBLE * 2 * ((1-w) * sqrt(d*gd) + w * sqrt(p*gp))) / gamma - 1",
    "van_oss": "2 * (sqrt(d*gd) + 2 * sqrt(p/2*gp/2)) / gamma - 1",
}
ORACLES = {
    "nnls_fit": FITS + "SELECT surface_group_id, v4_split, target AS target_liquid_id, n_probes, n_liquids, fit_status, round(d, 4) AS d, round(p, 4) AS p, round(least(greatest(2 * (sqrt(d*gd) + sqrt(p*gp)) / gamma - 1, -1), 1), 5) AS cosine FROM f JOIN liq ON target = liquid_id",
    "ols_fit": FITS + "SELECT surface_group_id, v4_split, target AS target_liquid_id, round(u1*u1, 4) AS free_d, round(u2*u2, 4) AS free_p, CASE WHEN u1 < -1e-9 OR u2 < -1e-9 THEN 'yes' ELSE 'no' END AS negative FROM f WHERE u1 IS NOT NULL",
    "physics_forms": SQL + ", x AS (SELECT *, (20.0::DOUBLE + surface_group_id % 30) AS d, (surface_group_id % 7)::DOUBLE AS p FROM m), z AS (SELECT *, least(greatest((CASE WHEN d+p > 0 THEN p/(d+p) ELSE 0 END + CASE WHEN gd+gp > 0 THEN gp/(gd+gp) ELSE 0 END) / 2, 0.4::DOUBLE), 0.6::DOUBLE) AS w FROM x), l AS ("
        + " UNION ALL ".join(f"SELECT surface_group_id, liquid_id, angle, '{k}' AS model, {v} AS c FROM z" for k, v in _COS.items())
        + ") SELECT surface_group_id, liquid_id, model, round(max(c), 6) AS cosine, max((abs(c - least(greatest(c, -1), 1)) > 1e-12)::INT) AS clipped, round(avg(abs(cos(radians(angle)) - least(greatest(c, -1), 1))), 6) AS cosine_error FROM l GROUP BY ALL",
    "fit_backfill": FITS + """SELECT measurement_id, CASE WHEN fit_status IN ('interior_fit', 'boundary_fit') THEN 'yes' ELSE 'no' END AS feasible, CASE WHEN fit_status IN ('interior_fit', 'boundary_fit') THEN '' ELSE coalesce(fit_status, 'no_probes') END AS reason,
  round(coalesce(d, 0), 4) AS d, round(coalesce(p, 0), 4) AS p, coalesce(n_probes, 0) AS n_probes FROM m LEFT JOIN f ON m.surface_group_id = f.surface_group_id AND m.v4_split = f.v4_split AND m.liquid_id = f.target""",
    "masked_samples": SQL + """, e AS (SELECT * FROM m WHERE target_eligible = 'yes')
SELECT measurement_id, 'zero_shot' AS mode, NULL::BIGINT AS n_probes, NULL::BIGINT AS first_probe, NULL::BIGINT AS last_probe, NULL AS liquids FROM e UNION ALL
SELECT a.measurement_id, 'probe_assisted', count(*), min(b.measurement_id), max(b.measurement_id), string_agg(DISTINCT b.liquid_name, ';' ORDER BY b.liquid_name)
FROM e a JOIN e b ON a.surface_group_id = b.surface_group_id AND a.v4_split = b.v4_split AND a.liquid_id <> b.liquid_id GROUP BY 1""",
    "eligibility_reason": FITS + """SELECT m.v4_split, CASE WHEN coalesce(n_liquids, 0) < 3 THEN 'too_few_liquids' WHEN fit_status NOT IN ('interior_fit', 'boundary_fit') THEN fit_status WHEN d IS NULL OR p IS NULL THEN 'not_finite' WHEN d < 0 OR p < 0 THEN 'negative' ELSE 'primary' END AS reason,
  count(*) AS n, count(DISTINCT m.surface_group_id) AS surfaces FROM m LEFT JOIN f ON m.surface_group_id = f.surface_group_id AND m.v4_split = f.v4_split AND m.liquid_id = f.target WHERE target_eligible = 'yes' GROUP BY ALL""",
    "independent_gate": SQL + """, x AS (SELECT *, surface_group_id % 4 IN (0, 1) AND surface_group_id % 5 <> 0 AND surface_group_id % 9 - 1 >= 0 AS ok FROM m)
SELECT measurement_id, CASE WHEN ok THEN 'yes' ELSE 'no' END AS has_independent, CASE WHEN ok THEN 20.0::DOUBLE + surface_group_id % 11 ELSE 0.0::DOUBLE END AS d, CASE WHEN ok THEN (surface_group_id % 9 - 1)::DOUBLE END AS p, CASE WHEN score > 9 THEN 'no' ELSE 'yes' END AS eligible FROM x""",
}
