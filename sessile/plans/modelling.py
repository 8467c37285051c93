"""Queries of features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.functions import metrics
from sessile.functions.clean import draw
from sessile.operators import calibrate, features, permute, quantiles
from sessile.roles import SQL, measurements
from sessile.sources.work import materialised, new_folder

NUMERIC = ("gamma", "gp", "score")
CATEGORIES = ("solid_family", "liquid_name")


def _rows(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return m.withColumn("gp", F.when(F.col("liquid_id") != 7, F.col("gp"))).withColumn("solid_family", F.when(F.col("surface_group_id") % 10 != 0, F.col("solid_family")))


def scale_encode(spark, sf_dir):
    """[M1 M2 M3] Scaler and vocabulary of the training split applied to all rows; medians beside the means."""
    m = _rows(spark, sf_dir)
    train = m.filter("v4_split = 'train'")
    vocabulary = features.fit_vocabulary(train.filter("liquid_id <> 3"), CATEGORIES)
    out = features.encoded(features.scaled(m, features.fit_scaler(train, NUMERIC), NUMERIC), F.broadcast(vocabulary), CATEGORIES)
    median = quantiles.whole_quantiles(train, F.col("gp"), {"median": 0.5})["median"]
    return out.withColumn("median", F.lit(median)).select("measurement_id", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in NUMERIC], F.col("gp_missing").cast("int").alias("gp_missing"), *[F.col(f"{c}_code").cast("long").alias(f"{c}_code") for c in CATEGORIES], F.round(F.coalesce("gp", "median"), 6).alias("gp_filled"))


def feature_rows(spark, sf_dir):
    """[M4 A23] Probe summary of each surface and split (count, mean, spread, least, largest, as shares of 180), 0 if there are none."""
    m = _rows(spark, sf_dir)
    keys = ["surface_group_id", "v4_split"]
    own = F.col("angle") / 180
    g = m.filter("target_eligible = 'yes'").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("spread"), F.min(own).alias("least"), F.max(own).alias("most"))
    d = m.select("measurement_id", *keys).join(g, keys, "left").na.fill(0)
    return d.select("measurement_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "least", "most")])


FEATURES = ("gamma", "gd", "gp0", "score", "surface_size")


def _model_rows(spark, sf_dir, *more):
    m = measurements(spark, sf_dir, with_id=bool(more)).withColumn("gp0", F.col("gp")).withColumn("surface_size", (F.col("surface_group_id") % 100).cast("double"))
    m = m.withColumn("physics", F.col("pred_a")).withColumn("residual", F.col("angle") - F.col("physics")).withColumn("fold", (draw(F.lit("m"), "source_group_id") % 3).cast("int"))
    return m.select("source_group_id", "v4_split", "solid_family", "angle", "pred_b", "physics", "residual", "fold", *FEATURES, *more)


def _told(scored, *keys):
    return scored.withColumn("observed", F.col("angle")).groupBy(*keys, "disjoint").agg(*metrics.regression())


def ridge_cv(spark, sf_dir):
    """[M6 O4] Penalty by folds of sources (ties to the larger), then the fit on training rows, scored on the external ones."""
    d = _model_rows(spark, sf_dir).cache()
    dev = d.filter("v4_split IN ('train', 'validation')")
    n = dev.count()
    losses = []
    for alpha in (0.1, 10.0):
        parts = [features.fit_and_score(features.ridge(FEATURES, alpha, n), dev.filter(F.col("fold") != k), dev.filter(F.col("fold") == k), "source_group_id").agg(F.sum(F.abs(F.col("angle") - F.col("predicted"))).alias("s")).first().s or 0.0 for k in range(3)]
        losses.append((round(sum(parts) / max(n, 1), 9), -alpha))
    alpha = -min(losses)[1]
    out = features.fit_and_score(features.ridge(FEATURES, alpha, n), dev, d.filter("v4_split LIKE '%external'"), "source_group_id")
    return _told(out, "v4_split").withColumn("alpha", F.lit(alpha))


def residual_forest(spark, sf_dir):
    """[M7 M9]"""
    d = _model_rows(spark, sf_dir).cache()
    return _told(features.fit_and_score(features.forest(FEATURES), d.filter("v4_split = 'train'"), d.filter("v4_split <> 'train'"), "source_group_id"), "v4_split")


def residual_gbt(spark, sf_dir):
    """[M8 M9 W1] With weights that balance sources."""
    d = _model_rows(spark, sf_dir).cache()
    g = d.groupBy("source_group_id").agg((1 / F.sqrt(F.count("*"))).alias("weight"))
    d = d.join(g, "source_group_id").cache()
    return _told(features.fit_and_score(features.boosted(FEATURES, weight="weight"), d.filter("v4_split = 'train'"), d.filter("v4_split <> 'train'"), "source_group_id"), "v4_split")


def loso_run(spark, sf_dir):
    """[E4] Folds of whole sources, each scored by a ridge fit on the others, beside the physics alone."""
    d = _model_rows(spark, sf_dir).cache()
    n = d.count()
    out = None
    for k in range(3):
        one = features.fit_and_score(features.ridge(FEATURES, 1.0, n), d.filter(F.col("fold") != k), d.filter(F.col("fold") == k), "source_group_id").select("fold", "disjoint", "angle", "predicted", "physics")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("observed", F.col("angle")).unpivot(["fold", "disjoint", "observed"], ["predicted", "physics"], "model", "predicted").groupBy("fold", "disjoint", "model").agg(*metrics.regression())


def confirmation_run(spark, sf_dir):
    """[E8 U3] Fit on development rows once, score each held cohort once."""
    d = _model_rows(spark, sf_dir).cache()
    dev, held = d.filter("v4_split IN ('train', 'validation')"), d.filter("v4_split NOT IN ('train', 'validation')")
    return _told(features.fit_and_score(features.forest(FEATURES, trees=10), dev, held, "source_group_id"), "v4_split", "solid_family")


def subset_control(spark, sf_dir):
    """[M11 M13] The same fit without the surface features."""
    d = _model_rows(spark, sf_dir).cache()
    out = None
    for name, cols in (("all", FEATURES), ("without_surface", FEATURES[:-1])):
        one = _told(features.fit_and_score(features.ridge(cols, 1.0, 1000), d.filter("v4_split = 'train'"), d.filter("v4_split <> 'train'"), "source_group_id")).withColumn("features", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def perm_importance(spark, sf_dir):
    """[E18] Increase of the MAE when one feature's values are dealt anew among rows, over ten draws by the measurement's id."""
    d = materialised(_model_rows(spark, sf_dir, "measurement_id").select("measurement_id", "source_group_id", "v4_split", "angle", "physics", "residual", *FEATURES), "model-rows")
    model = features.ridge(FEATURES, 1.0, 1000).fit(d.filter("v4_split = 'train'"))
    # Values move along the order of a draw within their source, so no task sees all rows.
    test = model.transform(d.filter("v4_split = 'validation'")).withColumn("error", F.col("angle") - F.col("physics") - F.col("prediction"))
    return permute.within_sources(test, "source_group_id", "measurement_id", "error", FEATURES, [float(w) for w in model.stages[-1].coefficients], 10)


def batch_score(spark, sf_dir):
    """[M12 Q12] Requests of all surfaces: those that pass the guard are scored by an injected backend, others keep their reasons."""
    m = measurements(spark, sf_dir, with_id=False)
    g = m.groupBy("surface_group_id").agg(F.min_by("liquid_name", "liquid_id").alias("target"), F.array_sort(F.collect_set(F.struct(F.col("liquid_name").alias("liquid"), F.col("angle")))).alias("probes"))
    mode = F.when(F.col("surface_group_id") % 3 == 0, "zero_shot").when(F.col("surface_group_id") % 3 == 1, "probe_assisted").otherwise("other")
    probes = F.when(F.col("surface_group_id") % 2 == 0, F.filter("probes", lambda p: p["liquid"] != F.col("target"))).otherwise(F.col("probes"))
    probes = F.when(F.col("surface_group_id") % 6 == 0, F.slice(F.col("probes"), 1, 0)).otherwise(probes)
    asked = calibrate.guarded(g.withColumn("mode", mode).withColumn("probes", probes))

    def backend(frame):
        frame["estimate"] = [round(sum(p["angle"] for p in x) / len(x), 4) if len(x) else 90.0 for x in frame["probes"]]
        return frame[["surface_group_id", "estimate"]]

    good = calibrate.backend_scores(asked.filter("reasons = ''").select("surface_group_id", "probes"), backend, "surface_group_id long, estimate double")
    return asked.select("surface_group_id", "mode", "reasons").join(good, "surface_group_id", "left")


def preprocessor_roundtrip(spark, sf_dir):
    """[M5 S6] A fitted scaler and vocabulary, stored as tables and read again, encode as before."""
    m = _rows(spark, sf_dir)
    scaler, vocabulary = features.fit_scaler(m, NUMERIC), features.fit_vocabulary(m, CATEGORIES)
    path = new_folder(spark, "preprocessor")
    scaler.write.parquet(f"{path}/scaler")
    vocabulary.write.parquet(f"{path}/vocabulary")
    scaler, vocabulary = spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/vocabulary")
    out = features.encoded(features.scaled(m, scaler, NUMERIC), F.broadcast(vocabulary), CATEGORIES)
    return out.groupBy("solid_family_code", "liquid_name_code").agg(F.count("*").alias("n"), F.round(F.avg("gamma_z"), 6).alias("gamma_z"))


_OWN = "scale_encode feature_rows ridge_cv residual_forest residual_gbt loso_run confirmation_run subset_control perm_importance batch_score preprocessor_roundtrip"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_X = SQL + ", x AS (SELECT *, CASE WHEN liquid_id <> 7 THEN gp END AS g, CASE WHEN surface_group_id % 10 <> 0 THEN solid_family END AS f FROM m), t AS (SELECT * FROM x WHERE v4_split = 'train')"
ORACLES = {
    "scale_encode": _X + """, s AS (SELECT avg(gamma) AS c1, greatest(stddev_pop(gamma), 1e-8) AS s1, avg(g) AS c2, greatest(stddev_pop(g), 1e-8) AS s2, avg(score) AS c3, greatest(stddev_pop(score), 1e-8) AS s3, quantile_cont(g, 0.5) AS med FROM t),
vf AS (SELECT k, row_number() OVER (ORDER BY k) + 1 AS code FROM (SELECT DISTINCT coalesce(lower(trim(f)), '<missing>') AS k FROM t WHERE liquid_id <> 3 UNION SELECT '<missing>')),
vl AS (SELECT k, row_number() OVER (ORDER BY k) + 1 AS code FROM (SELECT DISTINCT lower(trim(liquid_name)) AS k FROM t WHERE liquid_id <> 3 UNION SELECT '<missing>'))
SELECT measurement_id, round((gamma - c1) / s1, 6) AS gamma_z, round(coalesce((g - c2) / s2, 0), 6) AS gp_z, round((score - c3) / s3, 6) AS score_z, (g IS NULL)::INT AS gp_missing, coalesce(vf.code, 0) AS solid_family_code, coalesce(vl.code, 0) AS liquid_name_code, round(coalesce(g, med), 6) AS gp_filled
FROM x CROSS JOIN s LEFT JOIN vf ON coalesce(lower(trim(f)), '<missing>') = vf.k LEFT JOIN vl ON lower(trim(liquid_name)) = vl.k""",
    "feature_rows": SQL + """, g AS (SELECT surface_group_id, v4_split, count(*) AS n, avg(angle / 180) AS a, stddev_pop(angle / 180) AS s, min(angle / 180) AS lo, max(angle / 180) AS hi FROM m WHERE target_eligible = 'yes' GROUP BY ALL)
SELECT measurement_id, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS mean, round(coalesce(s, 0), 6) AS spread, round(coalesce(lo, 0), 6) AS least, round(coalesce(hi, 0), 6) AS most FROM m LEFT JOIN g USING (surface_group_id, v4_split)""",
    "batch_score": SQL + """, p AS (SELECT DISTINCT surface_group_id, liquid_id, liquid_name, angle FROM m), g AS (SELECT surface_group_id AS s, arg_min(liquid_name, liquid_id) AS target FROM p GROUP BY 1),
x AS (SELECT s, target, CASE s % 3 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'probe_assisted' ELSE 'other' END AS mode, p.liquid_name, p.angle FROM g LEFT JOIN p ON p.surface_group_id = s AND s % 6 <> 0 AND (s % 2 <> 0 OR p.liquid_name <> target)),
y AS (SELECT s, any_value(mode) AS mode, count(angle) AS n, bool_or(liquid_name = any_target) AS leak, coalesce(round(avg(angle), 4), 90.0) AS estimate FROM (SELECT *, target AS any_target FROM x) GROUP BY s),
z AS (SELECT *, concat_ws(';', CASE WHEN mode = 'other' THEN 'unknown_mode' END, CASE WHEN mode = 'zero_shot' AND n > 0 THEN 'probes_in_zero_shot' END, CASE WHEN mode = 'probe_assisted' AND n < 2 THEN 'too_few_probes' END, CASE WHEN leak THEN 'target_among_probes' END) AS reasons FROM y)
SELECT s AS surface_group_id, mode, reasons, CASE WHEN reasons = '' THEN estimate END AS estimate FROM z""",
    "preprocessor_roundtrip": _X + """, s AS (SELECT avg(gamma) AS c, greatest(stddev_pop(gamma), 1e-8) AS d FROM x), vf AS (SELECT k, row_number() OVER (ORDER BY k) + 1 AS code FROM (SELECT DISTINCT coalesce(lower(trim(f)), '<missing>') AS k FROM x UNION SELECT '<missing>')),
vl AS (SELECT k, row_number() OVER (ORDER BY k) + 1 AS code FROM (SELECT DISTINCT lower(trim(liquid_name)) AS k FROM x UNION SELECT '<missing>'))
SELECT vf.code AS solid_family_code, vl.code AS liquid_name_code, count(*) AS n, round(avg((gamma - c) / d), 6) AS gamma_z FROM x CROSS JOIN s JOIN vf ON coalesce(lower(trim(f)), '<missing>') = vf.k JOIN vl ON lower(trim(liquid_name)) = vl.k GROUP BY ALL""",
}
