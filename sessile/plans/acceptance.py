"""Queries of acceptance: gates over a whole evaluation, row checks by source, reports computed anew, grids of bootstraps, tree ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessile import sources as src
from sessile.functions import metrics
from sessile.operators import evaluate, features, folds, joins, quality
from sessile.plans import modelling, validation
from sessile.plans.predictions import METRICS
from sessile.plans.validation import _boot, _clusters
from sessile.roles import SQL, measurements
from sessile.sources.work import materialised, new_folder

EXTERNAL = "('legacy_external', 'prospective_open_external')"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Gates: name, threshold and, where there are two figures, the second one's.
IMPROVED, MOST_EXTERNAL, COVERED, WIDEST, RETAINED, LEAST_WEIGHT = 1.0, 16.0, (0.85, 0.95), 80.0, 0.80, 1e-3


def acceptance_report(spark, sf_dir):
    """[Q13 A9 A24 E9] Seven gates over development and external rows: improvement, its bootstrap interval, external error, coverage, width, retention, and the second expert's weight; with the status they give."""
    m = materialised(measurements(spark, sf_dir, with_id=False).select("surface_group_id", "v4_split", "angle", "pred_a", "pred_b", "score"), "accepted")  # each gate reads them
    dev = m.filter(f"v4_split NOT IN {EXTERNAL}").withColumn("scope", F.lit("all"))
    error = {c: F.abs(F.col("angle") - F.col(c)) for c in ("pred_a", "pred_b")}
    half = 2.5 * F.col("score")
    d = dev.select("angle", error["pred_a"].alias("a"), error["pred_b"].alias("b"), F.greatest(F.col("pred_a") - half, F.lit(0.0)).alias("lower"), F.least(F.col("pred_a") + half, F.lit(180.0)).alias("upper"), (F.col("score") <= 10).alias("kept"), error["pred_a"].alias("abs_error"))
    told = d.agg(F.avg("a").alias("a"), F.avg("b").alias("b"), *metrics.intervals("angle")).first()
    boot = folds.bootstrap(_clusters(dev.select("scope", "surface_group_id", "angle", F.col("pred_a").alias("pred_b"), F.col("pred_b").alias("pred_a")), ["scope"], "surface_group_id"), ["scope"], 100, 13).first()
    outside = m.filter("v4_split = 'prospective_open_external'").agg(F.avg(F.abs(F.col("angle") - (F.col("pred_a") + F.col("pred_b")) / 2)).alias("mae")).first()["mae"]
    weight = validation.fused(m).first()["w_b"]
    gates = [
        ("improves_by_1_deg", told.b - told.a, told.a <= told.b - IMPROVED), ("bootstrap_interval_below_0", boot.high, boot.high < 0), ("external_mae_at_most_16", outside, outside is not None and outside <= MOST_EXTERNAL),
        ("coverage_85_to_95_percent", told.coverage, COVERED[0] <= told.coverage <= COVERED[1]), ("width_at_most_80", told.width, told.width <= WIDEST),
        ("retains_80_percent_and_reduces_mae", told.retained, told.retained >= RETAINED and told.retained_mae is not None and told.retained_mae < round(told.a, 6)), ("second_expert_has_weight", weight, weight > LEAST_WEIGHT),
    ]
    status = "full_acceptance" if all(ok for *_, ok in gates) else "conditional"
    return spark.createDataFrame([(name, None if value is None else float(round(value, 5)), "yes" if ok else "no", status) for name, value, ok in gates], "gate string, value double, passed string, status string")


def row_qa(spark, sf_dir):
    """[Q10 A3] Checks of each source's rows: total, required cells, ranges, unique keys, conditional presence and forbidden texts."""
    m = measurements(spark, sf_dir)
    i = F.col("measurement_id")
    d = m.select(
        F.col("source_group_id").alias("source"), (i - F.when(i % 501 == 0, 1).otherwise(0)).alias("key"), F.when(i % 211 != 0, F.col("solid_name")).alias("name"), F.when(i % 307 == 0, F.lit(-1.0)).otherwise(F.col("angle")).alias("angle"),
        F.col("target_eligible").alias("eligible"), F.when(i % 11 != 0, F.col("score")).alias("spread"), F.when(i % 401 == 0, "see TODO").when(i % 403 == 0, "copied from figure").otherwise("table 1").alias("locator"),
    )
    expected = m.groupBy(F.col("source_group_id").alias("source")).agg((F.count("*") + F.when(F.col("source") % 4 == 0, 1).otherwise(0)).alias("expected"))
    return quality.row_suite(d, "source", expected, required=("name", "angle"), ranges={"angle": (0, 180)}, unique=("key",), present={"spread_where_eligible": (F.col("eligible") == "yes", F.col("spread").isNotNull())}, forbidden={"locator": ("todo", "figure")})


def report_recheck(spark, sf_dir):
    """[Q18 S7] A stored report of metrics, some of its figures changed since, read again and compared with figures computed anew."""
    m = measurements(spark, sf_dir, with_id=False).select("v4_split", "solid_family", F.col("angle").alias("observed"), F.col("pred_a").alias("predicted"))
    keys = ["v4_split", "solid_family"]
    changed = F.when((F.col("v4_split") == "validation") & (F.length("solid_family") % 5 == 0), 0.25).otherwise(0.0)
    figures = m.groupBy(*keys).agg(F.count("*").alias("n"), (F.round(F.avg(F.abs(F.col("observed") - F.col("predicted"))), 4)).alias("mae")).withColumn("mae", F.round(F.col("mae") + changed, 4))
    path = f"{new_folder(spark, 'figures')}/metrics.json"
    src.write_report(figures.filter("NOT (v4_split = 'train' AND length(solid_family) % 6 = 0)"), path)
    stored = src.read_table(spark, path, "v4_split string, solid_family string, n long, mae double").withColumnsRenamed({"n": "n_reported", "mae": "mae_reported"})
    again = evaluate.metrics_by(m, keys).select(*keys, "n", "mae")
    state = F.when(F.col("mae_reported").isNull(), "not_reported").when((F.col("n") == F.col("n_reported")) & (F.abs(F.col("mae") - F.col("mae_reported")) <= 0.0001), "agrees").otherwise("differs")
    return again.join(stored, keys, "left").select(*keys, "n", "n_reported", "mae", "mae_reported", state.alias("state"))


def bootstrap_grid_full(spark, sf_dir):
    """[E9 E9a] Each split, two comparisons, clusters of sources, 10,000 resamples."""
    m = measurements(spark, sf_dir, with_id=False)
    pairs = {"b_less_a": m, "a_less_mean": m.withColumns({"pred_b": F.col("pred_a"), "pred_a": F.lit(90.0)})}
    return folds.bootstrap(_union([_clusters(d, ["v4_split"], "source_group_id").withColumn("comparison", F.lit(k)) for k, d in pairs.items()]), ["v4_split", "comparison"], 10_000, 17)


SEEDS = (42, 43, 44)


def tree_ensembles(spark, sf_dir):
    """[M7 M8 M9 A22] Forests and boosted trees of the residual and of the angle itself, three seeds of each: the mean of seeds, and their mean spread, on rows of other splits."""
    d = materialised(modelling._model_rows(spark, sf_dir).select("v4_split", "angle", "physics", *modelling.FEATURES), "model-rows")  # fits, points and each pass of the metrics read them
    train, test = d.filter("v4_split = 'train'"), d.filter("v4_split <> 'train'")
    out = features.tree_ensembles(train, test, modelling.FEATURES, "angle", "physics", SEEDS)
    models = [c for c in out.columns if c.startswith("m_")]
    long = evaluate.long_form(out.select("v4_split", F.col("angle").alias("observed"), *models), ["v4_split", "observed"], models)
    spread = evaluate.long_form(out.select("v4_split", *[F.col(f"s{c[1:]}").alias(c) for c in models]), ["v4_split"], models).groupBy("v4_split", "model").agg(F.round(F.avg("predicted"), 6).alias("mean_spread"))
    # A row for each split and model: the checks of the join read them, not all rows again.
    return joins.checked_join(materialised(evaluate.metrics_by(long, ["v4_split", "model"]), "metrics"), materialised(spread, "spread"), ["v4_split", "model"], one_to_one=True, complete=True)


_OWN = "acceptance_report row_qa report_recheck bootstrap_grid_full tree_ensembles"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_FUSED = validation.ORACLES["simplex_fusion"].removeprefix(SQL).removeprefix(", ")
_GRID = ", c0 AS (SELECT v4_split, 'b_less_a' AS comparison, source_group_id AS cluster, count(*) AS n, sum(abs(angle - pred_b)) AS ea, sum(abs(angle - pred_a)) AS eb FROM m GROUP BY ALL UNION ALL SELECT v4_split, 'a_less_mean', source_group_id, count(*), sum(abs(angle - pred_a)), sum(abs(angle - 90)) FROM m GROUP BY ALL)"
_BOOT = _boot("scope", 100, 13, ", c0 AS (SELECT 'all' AS scope, surface_group_id AS cluster, count(*) AS n, sum(abs(angle - pred_a)) AS ea, sum(abs(angle - pred_b)) AS eb FROM m WHERE v4_split NOT IN ('legacy_external', 'prospective_open_external') GROUP BY ALL)")
_MET = METRICS.replace("predicted", "pred_a")
ORACLES = {
    "acceptance_report": SQL + f""", bo AS ({SQL}{_BOOT}), fu AS ({SQL}, {_FUSED}),
dv AS (SELECT angle, abs(angle - pred_a) AS a, abs(angle - pred_b) AS b, greatest(pred_a - 2.5::DOUBLE * score, 0) AS lo, least(pred_a + 2.5::DOUBLE * score, 180) AS hi, score <= 10 AS kept FROM m WHERE v4_split NOT IN {EXTERNAL}),
s AS (SELECT avg(a) AS a, avg(b) AS b, avg((angle BETWEEN lo AND hi)::INT) AS cov, avg(hi - lo) AS wid, avg(kept::INT) AS ret, avg(CASE WHEN kept THEN a END) AS rm FROM dv), o AS (SELECT avg(abs(angle - (pred_a + pred_b) / 2)) AS e FROM m WHERE v4_split = 'prospective_open_external'),
g AS (SELECT unnest([{{'gate': 'improves_by_1_deg', 'value': s.b - s.a, 'ok': s.a <= s.b - 1}}, {{'gate': 'bootstrap_interval_below_0', 'value': bo.high, 'ok': bo.high < 0}}, {{'gate': 'external_mae_at_most_16', 'value': e, 'ok': e <= 16}}, {{'gate': 'coverage_85_to_95_percent', 'value': cov, 'ok': round(cov, 6) BETWEEN 0.85 AND 0.95}},
  {{'gate': 'width_at_most_80', 'value': wid, 'ok': round(wid, 6) <= 80}}, {{'gate': 'retains_80_percent_and_reduces_mae', 'value': ret, 'ok': round(ret, 6) >= 0.8 AND round(rm, 6) < round(s.a, 6)}}, {{'gate': 'second_expert_has_weight', 'value': fu.w_b, 'ok': fu.w_b > 0.001}}], recursive := true) FROM s, bo, o, fu)
SELECT gate, round(value, 5) AS value, CASE WHEN ok THEN 'yes' ELSE 'no' END AS passed, CASE WHEN bool_and(ok) OVER () THEN 'full_acceptance' ELSE 'conditional' END AS status FROM g""",
    "row_qa": SQL + """, d AS (SELECT source_group_id AS s, measurement_id - (measurement_id % 501 = 0)::INT AS key, measurement_id % 211 = 0 AS bare, CASE WHEN measurement_id % 307 = 0 THEN -1 ELSE angle END AS angle, target_eligible = 'yes' AND measurement_id % 11 = 0 AS lacks, CASE WHEN measurement_id % 401 = 0 THEN 'todo' WHEN measurement_id % 403 = 0 THEN 'figure' END AS word FROM m),
k AS (SELECT s, sum(c) AS c FROM (SELECT s, key, count(*) AS c FROM d GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
g AS (SELECT d.s, count(*) AS n, count(*) FILTER (WHERE bare) AS bare, count(*) FILTER (WHERE angle < 0 OR angle > 180) AS range, count(*) FILTER (WHERE lacks) AS lacks, count(*) FILTER (WHERE word = 'todo') AS todo, count(*) FILTER (WHERE word = 'figure') AS figure, coalesce(any_value(k.c), 0) AS twice FROM d LEFT JOIN k USING (s) GROUP BY d.s)
SELECT s AS source, c AS check, v::BIGINT AS n, CASE WHEN ok THEN 'yes' ELSE 'no' END AS passed FROM g, LATERAL (VALUES ('total', n, s % 4 <> 0), ('required:name', bare, bare = 0), ('required:angle', 0, true), ('range:angle', range, range = 0), ('unique:key', twice, twice = 0), ('present:spread_where_eligible', lacks, lacks = 0), ('forbidden:locator:todo', todo, todo = 0), ('forbidden:locator:figure', figure, figure = 0)) t(c, v, ok)""",
    "report_recheck": SQL + f""", g AS (SELECT v4_split, solid_family, {_MET} FROM m GROUP BY ALL), r AS (SELECT v4_split, solid_family, n, round(round(mae, 4) + CASE WHEN v4_split = 'validation' AND length(solid_family) % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END, 4) AS mae FROM g WHERE NOT (v4_split = 'train' AND length(solid_family) % 6 = 0))
SELECT g.v4_split, g.solid_family, g.n, r.n AS n_reported, g.mae, r.mae AS mae_reported, CASE WHEN r.mae IS NULL THEN 'not_reported' WHEN g.n = r.n AND abs(g.mae - r.mae) <= 0.0001 THEN 'agrees' ELSE 'differs' END AS state FROM g LEFT JOIN r USING (v4_split, solid_family)""",
    "bootstrap_grid_full": SQL + _GRID + _boot("v4_split, comparison", 10_000, 17, ""),
}
