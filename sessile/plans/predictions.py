"""Queries over prediction frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.functions import metrics
from sessile.operators import evaluate as ev
from sessile.operators import quantiles
from sessile.roles import SQL, measurements

MODELS = ("pred_a", "pred_b")
LONG = SQL + ", long AS (SELECT *, 'pred_a' AS model, pred_a AS predicted FROM m UNION ALL SELECT *, 'pred_b', pred_b FROM m)\n"
E = "(angle - predicted)"
METRICS = f"""count(*) AS n, round(avg(abs{E}), 6) AS mae, round(sqrt(avg({E} * {E})), 6) AS rmse,
  round(CASE WHEN count(*) < 2 THEN NULL WHEN max(angle) = min(angle) THEN CASE WHEN sum({E} * {E}) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum({E} * {E}) / (count(*) * var_pop(angle)) END, 6) AS r2,
  round(quantile_cont(abs{E}, 0.5), 6) AS median_ae, round(quantile_cont(abs{E}, 0.9), 6) AS p90_ae"""


def wide(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    return measurements(spark, sf_dir, with_id).withColumn("observed", F.col("angle"))


def long(spark: SparkSession, sf_dir: str, *ids: str, with_id: bool = False) -> DataFrame:
    return ev.long_form(wide(spark, sf_dir, with_id), ["observed", *ids], MODELS)


def metrics_by_split(spark, sf_dir):
    """[A8 A11] Metrics of two models by split."""
    return ev.metrics_by(long(spark, sf_dir, "v4_split"), ["v4_split", "model"])


def interval_metrics(spark, sf_dir):
    """[A9] Intervals of 1.5 times the uncertainty; rows of low uncertainty are kept."""
    d = wide(spark, sf_dir)
    half = 1.5 * F.col("score")
    d = d.select("v4_split", "observed", F.greatest(F.col("pred_a") - half, F.lit(0.0)).alias("lower"), F.least(F.col("pred_a") + half, F.lit(180.0)).alias("upper"), (F.col("score") <= 8).alias("kept"), F.abs(F.col("observed") - F.col("pred_a")).alias("abs_error"))
    return d.groupBy("v4_split").agg(*metrics.intervals())


def within_threshold(spark, sf_dir):
    """[A10]"""
    return ev.within(long(spark, sf_dir, "v4_split"), (5, 10, 15, 20), ["v4_split", "model"])


def strata_metrics(spark, sf_dir):
    """[A12 P14 P15] By angle bin, family and liquid."""
    d = wide(spark, sf_dir).withColumn("angle_bin", ev.angle_bin("angle")).withColumn("probe_bin", F.when(F.col("liquid_id") >= 3, "3_or_more").otherwise("2"))
    keys = ["angle_bin", "probe_bin", "solid_family", "liquid_name"]
    return ev.strata(ev.long_form(d, ["observed", *keys], MODELS), keys, ["model"])


def common_subset(spark, sf_dir):
    """[E19] Both models on the rows that both predict (here: both within bounds)."""
    d = wide(spark, sf_dir)
    for m in MODELS:
        d = d.withColumn(m, F.when((F.col(m) > 0) & (F.col(m) < 180), F.col(m)))
    d = d.filter(" AND ".join(f"{m} IS NOT NULL" for m in MODELS))
    return ev.metrics_by(ev.long_form(d, ["observed", "v4_split"], MODELS), ["v4_split", "model"])


def split_and_all(spark, sf_dir):
    """[A17] Metrics by split and over all splits, with the share of predictions at the bounds."""
    d = long(spark, sf_dir, "v4_split")
    d = d.withColumn("v4_split", F.explode(F.array("v4_split", F.lit("all"))))
    clipped = F.round(F.avg(((F.col("predicted") == 0) | (F.col("predicted") == 180)).cast("double")), 6).alias("clipped")
    keys = ["model", "v4_split"]
    return ev.metrics_by(d, keys).join(d.groupBy(*keys).agg(clipped), keys)


def micro_macro(spark, sf_dir):
    """[A16] Over all rows, and the mean of the sources' metrics."""
    d = long(spark, sf_dir, "source_group_id")
    error = F.abs(F.col("observed") - F.col("predicted"))
    micro = d.groupBy("model").agg(F.round(F.avg(error), 6).alias("micro_mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("micro_rmse"), F.count("*").alias("n"))
    each = d.groupBy("model", "source_group_id").agg(F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    macro = each.groupBy("model").agg(F.round(F.avg("mae"), 6).alias("macro_mae"), F.round(F.avg("rmse"), 6).alias("macro_rmse"), F.count("*").alias("groups"))
    return micro.join(macro, "model")


def source_median(spark, sf_dir):
    """[A18 A19] Median over sources of their MAE; mean over splits of the best source's MAE."""
    d = long(spark, sf_dir, "source_group_id", "v4_split")
    each = d.groupBy("model", "v4_split", "source_group_id").agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("mae"))
    median = quantiles.quantiles(each, ["model"], F.col("mae"), {"median": 0.5}).select("model", F.round("median", 6).alias("median_mae"))
    best = each.groupBy("model", "v4_split").agg(F.min("mae").alias("best")).groupBy("model").agg(F.round(F.avg("best"), 6).alias("mean_best_mae"))
    return median.join(best, "model")


def pivot_wins(spark, sf_dir):
    """[A21] Share of surfaces' sources in which pred_b beats pred_a."""
    d = ev.metrics_by(long(spark, sf_dir, "source_group_id"), ["source_group_id", "model"])
    return ev.wins(d, "source_group_id", "mae", MODELS, "pred_a")


def shift_summary(spark, sf_dir):
    """[A20 A25] Shift from one prediction to the other, and both MAEs, by split."""
    d = wide(spark, sf_dir)
    mae = lambda c: F.avg(F.abs(F.col("observed") - F.col(c)))
    return d.groupBy("v4_split").agg(*ev.shift_summary(F.col("pred_a"), F.col("pred_b")), F.round(mae("pred_a"), 6).alias("mae_before"), F.round(mae("pred_b"), 6).alias("mae_after"), F.round(mae("pred_b") - mae("pred_a"), 6).alias("mae_change"))


def histogram(spark, sf_dir):
    """[A27] 24 bins of the shift by split."""
    return ev.histogram(wide(spark, sf_dir), F.round(F.col("pred_b") - F.col("pred_a"), 9), 24, ["v4_split"])


def findings(spark, sf_dir):
    """[A24] The best model of each split and its lead over the other."""
    d = ev.metrics_by(long(spark, sf_dir, "v4_split"), ["v4_split", "model"])
    return d.groupBy("v4_split").agg(F.min_by("model", F.struct("mae", "model")).alias("best_model"), F.min("mae").alias("best_mae"), F.round(F.max("mae") - F.min("mae"), 6).alias("lead"))


def worst_k(spark, sf_dir):
    """[O7] The 40 largest errors with their reasons."""
    d = wide(spark, sf_dir, True).withColumn("error", F.round(F.abs(F.col("observed") - F.col("pred_a")), 6))
    reasons = F.concat_ws("; ", F.when(F.col("angle") > 120, "hydrophobic"), F.when(F.col("score") > 8, "uncertain"), F.when(F.col("pred_a").isin(0.0, 180.0), "clipped"))
    top = d.select("measurement_id", "source_group_id", "error", reasons.alias("reasons")).orderBy(F.desc("error"), "measurement_id").limit(40)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("error"), "measurement_id")))


def long_predictions(spark, sf_dir):
    """[P39 P34] One row per record and model: error, whether clipped, and both predictions as JSON."""
    d = wide(spark, sf_dir, True).withColumn("both", F.to_json(F.create_map(F.lit("pred_a"), F.round("pred_a", 1).cast("string"), F.lit("pred_b"), F.round("pred_b", 1).cast("string"))))
    d = ev.long_form(d, ["measurement_id", "observed", "both"], MODELS)
    e = F.col("predicted") - F.col("observed")
    return d.select("measurement_id", "model", F.round("predicted", 6).alias("predicted"), F.round(e, 6).alias("error"), F.round(F.abs(e), 6).alias("abs_error"), F.col("predicted").isin(0.0, 180.0).alias("clipped"))


def huber_loss(spark, sf_dir):
    """[P38]"""
    d = long(spark, sf_dir, "v4_split")
    return d.groupBy("v4_split", "model").agg(F.round(F.avg(metrics.huber(F.col("observed") - F.col("predicted"))), 6).alias("huber"))


def seed_ensemble(spark, sf_dir):
    """[A22 M9] Mean and spread over five seeded members (predictions moved by a fixed draw), anchored to the bounds."""
    from sessile.functions.clean import anchored, draw

    d = wide(spark, sf_dir, True).select("measurement_id", "pred_a", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    d = d.withColumn("member", anchored("pred_a", (draw("seed", "measurement_id") % 1000) / 100.0 - 5))
    return d.groupBy("measurement_id").agg(F.round(F.avg("member"), 6).alias("mean"), F.round(F.stddev_pop("member"), 6).alias("spread"), F.count("*").alias("members"))


QUERIES = {f.__name__: f for f in (metrics_by_split, interval_metrics, within_threshold, strata_metrics, common_subset, split_and_all, micro_macro, source_median, pivot_wins, shift_summary, histogram, findings, worst_k, long_predictions, huber_loss, seed_ensemble)}

_AE = f"abs{E}"
ORACLES = {
    "metrics_by_split": LONG + f"SELECT v4_split, model, {METRICS} FROM long GROUP BY ALL",
    "interval_metrics": SQL + """, i AS (SELECT v4_split, angle, greatest(pred_a - 1.5 * score, 0) AS lo, least(pred_a + 1.5 * score, 180) AS hi, score <= 8 AS kept, abs(angle - pred_a) AS ae FROM m)
SELECT v4_split, round(avg((angle >= lo AND angle <= hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width, round(avg(kept::INT), 6) AS retained, round(avg(ae) FILTER (WHERE kept), 6) AS retained_mae FROM i GROUP BY 1""",
    "within_threshold": LONG + f"SELECT v4_split, model, 't' || t AS threshold, round(avg(({_AE} <= t)::INT), 6) AS share FROM long, (VALUES (5), (10), (15), (20)) x(t) GROUP BY ALL",
    "strata_metrics": LONG + f"""SELECT stratifier, stratum, model, {METRICS} FROM (
  SELECT *, 'angle_bin' AS stratifier, CASE WHEN angle <= 60 THEN 'low' WHEN angle <= 90 THEN 'middle' WHEN angle <= 120 THEN 'high' ELSE 'very_high' END AS stratum FROM long
  UNION ALL SELECT *, 'probe_bin', CASE WHEN liquid_id >= 3 THEN '3_or_more' ELSE '2' END FROM long
  UNION ALL SELECT *, 'solid_family', solid_family FROM long UNION ALL SELECT *, 'liquid_name', liquid_name FROM long) GROUP BY ALL HAVING count(*) >= 2""",
    "common_subset": LONG + f"SELECT v4_split, model, {METRICS} FROM long WHERE pred_a > 0 AND pred_a < 180 AND pred_b > 0 AND pred_b < 180 GROUP BY ALL",
    "split_and_all": LONG + f"SELECT model, coalesce(v4_split, 'all') AS v4_split, {METRICS}, round(avg((predicted = 0 OR predicted = 180)::INT), 6) AS clipped FROM long GROUP BY GROUPING SETS ((model, v4_split), (model))",
    "micro_macro": LONG + f""", g AS (SELECT model, source_group_id, avg({_AE}) AS a, sqrt(avg({E} * {E})) AS r FROM long GROUP BY ALL),
u AS (SELECT model, round(avg({_AE}), 6) AS micro_mae, round(sqrt(avg({E} * {E})), 6) AS micro_rmse, count(*) AS n FROM long GROUP BY 1)
SELECT u.*, round(avg(a), 6) AS macro_mae, round(avg(r), 6) AS macro_rmse, count(*) AS groups FROM u JOIN g USING (model) GROUP BY ALL""",
    "source_median": LONG + f""", g AS (SELECT model, v4_split, source_group_id, avg({_AE}) AS a FROM long GROUP BY ALL), b AS (SELECT model, v4_split, min(a) AS best FROM g GROUP BY ALL)
SELECT model, round(quantile_cont(a, 0.5), 6) AS median_mae, (SELECT round(avg(best), 6) FROM b WHERE b.model = g.model) AS mean_best_mae FROM g GROUP BY model""",
    "pivot_wins": LONG + f""", g AS (SELECT model, source_group_id, round(avg({_AE}), 6) AS a FROM long GROUP BY ALL)
SELECT count(*) AS groups, 'pred_b' AS model, round(avg((y.a < x.a)::INT), 6) AS win_fraction FROM g x JOIN g y ON x.source_group_id = y.source_group_id AND x.model = 'pred_a' AND y.model = 'pred_b'""",
    "shift_summary": SQL + """SELECT v4_split, count(*) AS n, count(*) FILTER (WHERE abs(pred_b - pred_a) > 1e-9) AS changed, round(avg(abs(pred_b - pred_a)), 6) AS mean_shift, round(max(abs(pred_b - pred_a)), 6) AS max_shift,
  round(avg(abs(angle - pred_a)), 6) AS mae_before, round(avg(abs(angle - pred_b)), 6) AS mae_after, round(avg(abs(angle - pred_b)) - avg(abs(angle - pred_a)), 6) AS mae_change FROM m GROUP BY 1""",
    "histogram": SQL + """, x AS (SELECT v4_split, round(pred_b - pred_a, 9) AS x FROM m), e AS (SELECT v4_split, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
SELECT v4_split, CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / ((hi - lo) / 24)) + 1, 24) END::INT AS bin, count(*) AS n FROM x JOIN e USING (v4_split) GROUP BY ALL""",
    "findings": LONG + f""", g AS (SELECT v4_split, model, round(avg({_AE}), 6) AS a FROM long GROUP BY ALL)
SELECT v4_split, (array_agg(model ORDER BY a, model))[1] AS best_model, min(a) AS best_mae, round(max(a) - min(a), 6) AS lead FROM g GROUP BY 1""",
    "worst_k": SQL + """SELECT measurement_id, source_group_id, round(abs(angle - pred_a), 6) AS error,
  concat_ws('; ', CASE WHEN angle > 120 THEN 'hydrophobic' END, CASE WHEN score > 8 THEN 'uncertain' END, CASE WHEN pred_a IN (0, 180) THEN 'clipped' END) AS reasons,
  row_number() OVER (ORDER BY round(abs(angle - pred_a), 6) DESC, measurement_id) AS rank FROM m ORDER BY error DESC, measurement_id LIMIT 40""",
    "long_predictions": LONG + f"SELECT measurement_id, model, round(predicted, 6) AS predicted, round(predicted - angle, 6) AS error, round({_AE}, 6) AS abs_error, predicted IN (0, 180) AS clipped FROM long",
    "huber_loss": LONG + f"SELECT v4_split, model, round(avg(CASE WHEN {_AE} <= 5 THEN 0.5 * {E} * {E} ELSE 5 * ({_AE} - 2.5) END), 6) AS huber FROM long GROUP BY ALL",
    "seed_ensemble": SQL + """, s AS (SELECT measurement_id, least(greatest(pred_a + ((('0x' || substr(md5(concat_ws('|', seed, measurement_id)), 1, 8))::BIGINT % 1000) / 100.0::DOUBLE - 5), 0), 180) AS member FROM m, range(1, 6) r(seed))
SELECT measurement_id, round(avg(member), 6) AS mean, round(stddev_pop(member), 6) AS spread, count(*) AS members FROM s GROUP BY 1""",
}
