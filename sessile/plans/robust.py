"""Queries of held-out sources by exact ridges, of convex fusion, and of order statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessile.functions.clean import anchored, draw
from sessile.operators import curves, evaluate, fusion, ridge
from sessile.plans.predictions import METRICS
from sessile.plans.validation import _D
from sessile.roles import SQL, measurements
from sessile.sources.work import materialised

TWO = ("score", "size")
ALPHAS = (0.1, 10.0, 1000.0)
EXTERNAL = "('legacy_external', 'prospective_open_external')"


def _rows(spark, sf_dir):
    """Features, residual of the physics, and three inner folds of whole sources."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("size", (F.col("surface_group_id") % 100).cast("double"))
    return m.withColumn("residual", F.col("angle") - F.col("pred_a")).withColumn("inner", (draw(F.lit("m"), "source_group_id") % 3).cast("int"))


def _loso(spark, sf_dir):
    d = _rows(spark, sf_dir).filter(f"v4_split NOT IN {EXTERNAL}")
    models = ridge.leave_one_out(d, "source_group_id", "inner", TWO, "residual", ALPHAS)
    return ridge.with_models(d, models, "source_group_id").withColumn("ridge", anchored("pred_a", ridge.linear(F.col("model"), TWO)))


def loso_ridge(spark, sf_dir):
    """[E4 M6 O4] Each development source predicted by a ridge fit on all others, with a penalty chosen among them; one row a source."""
    error = F.abs(F.col("angle") - F.col("ridge"))
    g = _loso(spark, sf_dir).groupBy("source_group_id").agg(F.first("train_rows").alias("train_rows"), F.first("alpha").alias("alpha"), F.first("model").alias("w"), F.count("*").alias("test_rows"), F.round(F.avg(error), 6).alias("mae"))
    return g.select("source_group_id", "train_rows", "alpha", *[F.round(F.col("w")[i], 6).alias(c) for i, c in enumerate(("intercept", "w_score", "w_size"))], "test_rows", "mae")


def loso_models(spark, sf_dir):
    """[E4 A8] The held-out predictions of all folds together, beside the physics alone."""
    d = _loso(spark, sf_dir).select(F.col("angle").alias("observed"), F.col("pred_a").alias("physics"), "ridge")
    return evaluate.metrics_by(evaluate.long_form(d, ["observed"], ("physics", "ridge")), ["model"])


def confirmation_ridge(spark, sf_dir):
    """[E8 U3 M13] One fit on development sources, with its penalty by their inner folds; each held cohort is scored once. Sources on both sides raise."""
    d = _rows(spark, sf_dir)
    dev, held = d.filter("v4_split IN ('train', 'validation')"), d.filter("v4_split NOT IN ('train', 'validation')")
    both = dev.select("source_group_id").distinct().join(held.select("source_group_id").distinct(), "source_group_id", "left_semi").limit(1).count()
    if both:
        raise ValueError("a source is in development and in a held cohort")
    alpha, model = ridge.fitted(dev, "inner", TWO, "residual", ALPHAS)
    out = held.select("v4_split", F.col("angle").alias("observed"), anchored("pred_a", ridge.linear(model, TWO)).alias("predicted"))
    return evaluate.metrics_by(out, ["v4_split"]).withColumn("alpha", F.lit(alpha))


def subset_ridge(spark, sf_dir):
    """[M11 M13] The same fit with and without the surface's feature, on the rows of other splits."""
    d = _rows(spark, sf_dir)
    train, test = d.filter("v4_split = 'train'"), d.filter("v4_split <> 'train'")
    fits = {name: (ridge.fitted(train, None, cols, "residual", (1.0,))[1], cols) for name, cols in (("all", TWO), ("without_surface", TWO[:1]))}
    wide = test.select("v4_split", F.col("angle").alias("observed"), *[anchored("pred_a", ridge.linear(w, cols)).alias(k) for k, (w, cols) in fits.items()])
    return evaluate.metrics_by(evaluate.long_form(wide, ["v4_split", "observed"], tuple(fits)), ["v4_split", "model"])


def learning_curve_full(spark, sf_dir):
    """[E5 A13] Every number of development sources from one to all but one, at most 20 different draws of each, tested on all other sources."""
    m = measurements(spark, sf_dir, with_id=False).filter(f"v4_split NOT IN {EXTERNAL}")
    return curves.drawn_curve(m, "source_group_id", "angle", "pred_a", 20)


EXPERTS = ("pred_a", "pred_b", "mean", "high", "low")


def convex_fusion(spark, sf_dir):
    """[E15] Weights of three and of five experts by the convex solver, with the duality gap that bounds their loss's distance from the least."""
    m = measurements(spark, sf_dir, with_id=False).select("angle", "pred_a", "pred_b", F.lit(90.0).alias("mean"), anchored("pred_a", F.lit(12.0)).alias("high"), anchored("pred_b", F.lit(-7.0)).alias("low"))
    m = materialised(m, "experts")  # each pass reads them again
    rows = []
    for experts in (EXPERTS[:3], EXPERTS):
        fit = fusion.simplex_weights(m, experts, "angle")
        rows += [(len(experts), e, float(round(w, 6)), float(round(fit.loss, 6)), fit.gap < 1e-6) for e, w in zip(experts, fit.weights, strict=True)]
    return spark.createDataFrame(rows, "experts int, expert string, weight double, huber double, proven boolean")


_OWN = "learning_curve_full loso_ridge loso_models confirmation_ridge subset_ridge convex_fusion"
QUERIES = {k: globals()[k] for k in _OWN.split()}

_S = "sum({0}) AS {1}"
_SUMS = "count(*)::DOUBLE AS n, sum(score) AS sx, sum(size) AS sy, sum(r) AS sr, sum(score * score) AS sxx, sum(size * size) AS syy, sum(score * size) AS sxy, sum(score * r) AS sxr, sum(size * r) AS syr, sum(r * r) AS srr"
_NAMES = "n sx sy sr sxx syy sxy sxr syr srr".split()
_X = SQL + f", x AS (SELECT *, (surface_group_id % 100)::DOUBLE AS size, angle - pred_a AS r, {_D.format(chr(39) + 'm' + chr(39) + ', source_group_id')} % 3 AS inner_fold FROM m)"
_ALPHAS = "(VALUES (0.1::DOUBLE), (10.0), (1000.0)) z(alpha)"


def _fit(source: str, keys: str, alpha: str = "alpha", size: bool = True) -> str:
    """Two-feature ridge by Cramer's rule, from a table of sums."""
    zyy, zxy, by = ("cyy / (vy * vy)", "cxy / (vx * vy)", "cyr / vy") if size else ("1.0", "0.0", "0.0")
    return f"""(SELECT {keys}, {alpha} AS alpha, sr / n - wx * sx / n - wy * sy / n AS b, wx, wy FROM (
  SELECT *, (zyy * bx - zxy * by_) / (zxx * zyy - zxy * zxy) / vx AS wx, (zxx * by_ - zxy * bx) / (zxx * zyy - zxy * zxy) / vy AS wy FROM (
  SELECT *, cxx / (vx * vx) + {alpha} AS zxx, {zyy} + {alpha} AS zyy, {zxy} AS zxy, cxr / vx AS bx, {by} AS by_ FROM (
  SELECT *, greatest(sqrt(cxx / n), 1e-8) AS vx, greatest(sqrt(cyy / n), 1e-8) AS vy FROM (
  SELECT *, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy, sxr - sx * sr / n AS cxr, syr - sy * sr / n AS cyr FROM {source})))))"""


_SSE = "t.srr + t.n * b * b + wx * wx * t.sxx + wy * wy * t.syy - 2 * b * t.sr - 2 * wx * t.sxr - 2 * wy * t.syr + 2 * b * wx * t.sx + 2 * b * wy * t.sy + 2 * wx * wy * t.sxy"


def _minus(*tables: str) -> str:
    return ", ".join(f"{tables[0]}.{c}" + "".join(f" - {t}.{c}" for t in tables[1:]) + f" AS {c}" for c in _NAMES)


_LOSO = _X + f""", d AS (SELECT * FROM x WHERE v4_split NOT IN {EXTERNAL}), o AS (SELECT source_group_id, inner_fold, {_SUMS} FROM d GROUP BY ALL), f AS (SELECT inner_fold, {_SUMS} FROM d GROUP BY 1), a AS (SELECT {_SUMS} FROM d),
e AS (SELECT o.source_group_id, f.inner_fold AS j, {', '.join(f'f.{c} - CASE WHEN f.inner_fold = o.inner_fold THEN o.{c} ELSE 0 END AS {c}' for c in _NAMES)} FROM o, f),
q AS (SELECT e.source_group_id, e.j, alpha, {', '.join(f'a.{c} - o.{c} - e.{c} AS {c}' for c in _NAMES)} FROM e JOIN o USING (source_group_id), a, {_ALPHAS}),
i AS (SELECT w.source_group_id, w.alpha, round(avg(({_SSE}) / t.n), 9) AS loss FROM {_fit('q', 'source_group_id, j')} w JOIN e t ON t.source_group_id = w.source_group_id AND t.j = w.j WHERE t.n > 0 GROUP BY ALL),
p AS (SELECT source_group_id, alpha FROM (SELECT *, row_number() OVER (PARTITION BY source_group_id ORDER BY loss, alpha DESC) AS rn FROM i) WHERE rn = 1),
g AS (SELECT o.source_group_id, p.alpha, {_minus('a', 'o')} FROM o JOIN p USING (source_group_id), a), w AS {_fit('g', 'source_group_id, n')},
s AS (SELECT d.*, w.n AS train_rows, alpha, b, wx, wy, least(greatest(pred_a + b + wx * score + wy * size, 0), 180) AS ridge FROM d JOIN w USING (source_group_id))
"""


def _metrics(observed: str, predicted: str) -> str:
    return METRICS.replace("angle", observed).replace("predicted", predicted)


ORACLES = {
    "learning_curve_full": SQL + f""", d AS (SELECT source_group_id AS s, angle, pred_a FROM m WHERE v4_split NOT IN {EXTERNAL}), k AS (SELECT DISTINCT s FROM d),
c AS (SELECT size, subset, s, row_number() OVER (PARTITION BY size, subset ORDER BY {_D.format('size, subset, s')}, s) AS rn FROM k, range(1, (SELECT count(*) FROM k)) a(size), range(1, 21) b(subset)),
h AS (SELECT size, subset, md5(string_agg(s::VARCHAR, '|' ORDER BY s)) AS name FROM c WHERE rn <= size GROUP BY ALL), f AS (SELECT size, min(subset) AS subset FROM h GROUP BY size, name),
t AS (SELECT c.size, c.subset, s FROM c JOIN f ON f.size = c.size AND f.subset = c.subset WHERE rn <= c.size), g AS (SELECT size, subset, avg(angle - pred_a) AS shift FROM d JOIN t USING (s) GROUP BY ALL)
SELECT size::INT AS size, subset::INT AS subset, count(DISTINCT d.s) AS test_sources, count(*) AS test_rows, round(avg(abs(angle - least(greatest(pred_a + shift, 0), 180))), 6) AS mae FROM g JOIN c USING (size, subset) JOIN d ON d.s = c.s WHERE c.rn > size GROUP BY ALL""",
    "loso_ridge": _LOSO + "SELECT source_group_id, any_value(train_rows)::BIGINT AS train_rows, any_value(alpha) AS alpha, round(any_value(b), 6) AS intercept, round(any_value(wx), 6) AS w_score, round(any_value(wy), 6) AS w_size, count(*) AS test_rows, round(avg(abs(angle - ridge)), 6) AS mae FROM s GROUP BY 1",
    "loso_models": _LOSO + f"SELECT 'physics' AS model, {_metrics('angle', 'pred_a')} FROM s UNION ALL SELECT 'ridge', {_metrics('angle', 'ridge')} FROM s",
    "confirmation_ridge": _X + f""", d AS (SELECT * FROM x WHERE v4_split IN ('train', 'validation')), e AS (SELECT inner_fold AS j, {_SUMS} FROM d GROUP BY 1), a AS (SELECT {_SUMS} FROM d),
q AS (SELECT e.j, alpha, {_minus('a', 'e')} FROM e, a, {_ALPHAS}), i AS (SELECT w.alpha, round(avg(({_SSE}) / t.n), 9) AS loss FROM {_fit('q', 'j')} w JOIN e t USING (j) GROUP BY 1),
p AS (SELECT alpha FROM i ORDER BY loss, alpha DESC LIMIT 1), g AS (SELECT * FROM a, p), w AS {_fit('g', 'n')}, s AS (SELECT x.*, alpha, least(greatest(pred_a + b + wx * score + wy * size, 0), 180) AS ridge FROM x, w WHERE v4_split NOT IN ('train', 'validation'))
SELECT v4_split, {_metrics('angle', 'ridge')}, any_value(alpha) AS alpha FROM s GROUP BY 1""",
    "subset_ridge": _X + f""", a AS (SELECT {_SUMS} FROM x WHERE v4_split = 'train'), w AS (SELECT 'all' AS model, * FROM {_fit('a', 'n', '1.0::DOUBLE')} UNION ALL SELECT 'without_surface', * FROM {_fit('a', 'n', '1.0::DOUBLE', False)}),
s AS (SELECT x.v4_split, model, angle, least(greatest(pred_a + b + wx * score + wy * size, 0), 180) AS ridge FROM x, w WHERE v4_split <> 'train') SELECT v4_split, model, {_metrics('angle', 'ridge')} FROM s GROUP BY ALL""",
}
