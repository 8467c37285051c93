"""Queries of protocols and whole tables: held-out sources and liquids, completeness, gates, merges and migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessile import sources as src
from sessile.functions import clean as c
from sessile.functions import physics
from sessile.functions.clean import anchored, draw
from sessile.operators import calibrate, evaluate, extract, folds, joins, quantiles
from sessile.plans import fitting, predictions
from sessile.plans.predictions import METRICS
from sessile.plans.validation import _boot, _C0, _clusters, _D
from sessile.roles import SQL, measurements, table
from sessile.sources.work import materialised, new_folder

EXTERNAL = ("legacy_external", "prospective_open_external")
DEVELOPMENT = f"v4_split NOT IN {EXTERNAL}"
LEAST_TRAIN = 20


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def loso_folds(spark, sf_dir):
    """[E3] Each development source held out once: rows and sources on both sides; external rows never take part, and three sources are the least."""
    g = measurements(spark, sf_dir, with_id=False).filter(DEVELOPMENT).groupBy("source_group_id").agg(F.count("*").alias("test_rows"), F.count_if(F.col("target_eligible") == "yes").alias("eligible_rows"))
    t = g.agg(F.sum("test_rows").alias("rows"), F.count("*").alias("sources"))
    d = g.crossJoin(F.broadcast(t))
    role = F.when(F.col("sources") < 3, "too_few_sources").when(F.col("rows") - F.col("test_rows") < LEAST_TRAIN, "too_few_rows").otherwise("fold")
    return d.select("source_group_id", "test_rows", "eligible_rows", (F.col("rows") - F.col("test_rows")).alias("train_rows"), (F.col("sources") - 1).alias("train_sources"), role.alias("role"))


def loso_baselines(spark, sf_dir):
    """[E4 E10] Each development source predicted from all others: physics, mean residual, and mean residual by liquid drawn to it. From totals less a source's own."""
    m = measurements(spark, sf_dir, with_id=False).filter(DEVELOPMENT).withColumn("r", F.col("angle") - F.col("pred_a"))
    cell = m.groupBy("source_group_id", "liquid_id").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    source = cell.groupBy("source_group_id").agg(F.sum("n").alias("sn"), F.sum("s").alias("ss"))
    liquid = cell.groupBy("liquid_id").agg(F.sum("n").alias("ln"), F.sum("s").alias("ls"))
    total = source.agg(F.sum("sn").alias("tn"), F.sum("ss").alias("ts"))
    shift = cell.join(source, "source_group_id").join(F.broadcast(liquid), "liquid_id").crossJoin(F.broadcast(total))
    overall = (F.col("ts") - F.col("ss")) / (F.col("tn") - F.col("sn"))
    shift = shift.select("source_group_id", "liquid_id", overall.alias("overall"), ((F.col("ls") - F.col("s") + 50 * overall) / (F.col("ln") - F.col("n") + 50)).alias("by_liquid"))
    d = m.join(shift, ["source_group_id", "liquid_id"]).select(F.col("angle").alias("observed"), F.col("pred_a").alias("physics"), anchored("pred_a", "overall").alias("global_mean"), anchored("pred_a", "by_liquid").alias("liquid_mean"))
    return evaluate.metrics_by(evaluate.long_form(d, ["observed"], ("physics", "global_mean", "liquid_mean")), ["model"])


def strict_leave_one_liquid(spark, sf_dir):
    """[E6 J11] A liquid held out: trained on surfaces that never met it (so it is no probe either), tested on its evaluation rows; folds with too few rows stay, marked."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("r", F.col("angle") - F.col("pred_a"))
    surface = m.filter("v4_split = 'train'").groupBy("surface_group_id").agg(F.collect_set("liquid_id").alias("probes"), F.count("*").alias("n"), F.sum("r").alias("s"))
    held = m.select("liquid_id").distinct()
    liquids = held.agg(F.array_sort(F.collect_set("liquid_id")).alias("every"))
    train = surface.crossJoin(F.broadcast(liquids)).select("n", "s", F.explode(F.array_except("every", "probes")).alias("liquid_id")).groupBy("liquid_id").agg(F.sum("n").alias("train_rows"), F.sum("s").alias("s"))
    fold = held.join(train, "liquid_id", "left").na.fill(0, ["train_rows"]).withColumn("feasible", F.when(F.col("train_rows") >= LEAST_TRAIN, "yes").otherwise("no"))
    d = m.filter("v4_split <> 'train'").join(F.broadcast(fold), "liquid_id")
    error = F.when(F.col("feasible") == "yes", F.abs(F.col("angle") - anchored("pred_a", F.col("s") / F.col("train_rows"))))
    scored = d.groupBy("liquid_id").agg(F.count("*").alias("test_rows"), F.round(F.avg(error), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))
    return fold.drop("s").join(scored, "liquid_id", "left")


def bootstrap_full(spark, sf_dir):
    """[E9] pred_b less pred_a over source clusters, 10,000 resamples."""
    m = measurements(spark, sf_dir, with_id=False).withColumn("scope", F.lit("all"))
    return folds.bootstrap(_clusters(m, ["scope"], "source_group_id"), ["scope"], 10_000, 7)


def balanced_rows(spark, sf_dir):
    """[M10] As many draws as there are rows: a source, evenly, then one of its rows, evenly; draws by source and the sum of the ids drawn."""
    m = materialised(measurements(spark, sf_dir).select("measurement_id", "source_group_id"), "drawn-from")  # read for ranks and sizes
    rows = folds.ranked(m, ["source_group_id"], F.col("measurement_id"), F.shiftright("measurement_id", 20), [], "row").withColumn("row", (F.col("row") - 1).cast("long"))
    g = materialised(m.groupBy("source_group_id").agg(F.count("*").alias("n")), "drawn-sources")
    s = folds.ranked(g, [], F.col("source_group_id"), F.floor(F.col("source_group_id") / 4096), [], "idx").withColumn("idx", (F.col("idx") - 1).cast("long"))
    size = g.agg(F.count("*").alias("k"), F.sum("n").alias("all")).first()
    d = spark.range(1, (size["all"] or 0) + 1).select((draw(F.lit("s"), "id") % (size.k or 1)).alias("idx"), draw(F.lit("r"), "id").alias("u"))
    drawn = d.join(s, "idx").withColumn("row", F.col("u") % F.col("n")).join(rows, ["source_group_id", "row"])
    return drawn.groupBy("source_group_id").agg(F.count("*").alias("draws"), F.sum("measurement_id").alias("ids"))


def oof_completeness(spark, sf_dir):
    """[Q14] Out-of-fold results against the rows that should have one: by fold the count, the distinct count and the expected one."""
    m = measurements(spark, sf_dir).select("measurement_id", (draw(F.lit("fold"), "source_group_id") % 5).cast("int").alias("fold"))
    told = m.filter("fold <> 1 OR measurement_id % 97 <> 0")
    told = told.unionByName(told.filter("fold = 3 AND measurement_id % 89 = 0"))
    got = told.groupBy("fold", "measurement_id").agg(F.count("*").alias("c")).groupBy("fold").agg(F.sum("c").alias("results"), F.count("*").alias("distinct_rows"))
    want = m.groupBy("fold").agg(F.count("*").alias("expected"))
    complete = (F.col("results") == F.col("expected")) & (F.col("distinct_rows") == F.col("expected"))
    return want.join(got, "fold", "left").na.fill(0, ["results", "distinct_rows"]).withColumn("complete", F.when(complete, "yes").otherwise("no"))


def metric_recheck(spark, sf_dir):
    """[Q18] Reported figures against figures computed anew, within a tolerance."""
    m = measurements(spark, sf_dir, with_id=False)
    error = F.abs(F.col("angle") - F.col("pred_a"))
    reported = m.groupBy("v4_split").agg(F.round(F.avg(error) + F.when(F.col("v4_split") == "validation", 0.5).otherwise(0.0), 2).alias("reported"))
    again = evaluate.metrics_by(m.select("v4_split", F.col("angle").alias("observed"), F.col("pred_a").alias("predicted")), ["v4_split"]).select("v4_split", "mae")
    both = joins.checked_join(again, reported, ["v4_split"], one_to_one=True, complete=True)
    return both.select("v4_split", "reported", "mae", F.when(F.abs(F.col("mae") - F.col("reported")) <= 0.0051, "yes").otherwise("no").alias("agrees"))


def overwrite_guard(spark, sf_dir):
    """[Q17] Whether each source may be rebuilt: external rows, once merged, forbid it."""
    m = measurements(spark, sf_dir, with_id=False)
    g = m.groupBy("source_group_id").agg(F.count("*").alias("n"), F.count_if(F.col("v4_split").isin(*EXTERNAL)).alias("external_rows"))
    return g.withColumn("rebuild", F.when(F.col("external_rows") == 0, "allowed").otherwise("refused"))


def provenance_gate(spark, sf_dir):
    """[Q7] Active sources against a list of permitted states: one row for each violation."""
    s = table(spark, sf_dir, "supplier")
    states = F.element_at(F.array(*map(F.lit, ("verified", "pending", "verified", "disputed"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    review = s.filter("s_suppkey % 13 <> 0").select(F.col("s_suppkey").alias("source_group_id"), states.alias("state"), F.when(F.col("s_acctbal") < 0, F.lit(" ")).otherwise(F.lit("cc-by")).alias("license"), F.when(F.col("s_suppkey") % 9 == 0, "exclude").otherwise("retain").alias("decision"))
    active = s.select(F.col("s_suppkey").alias("source_group_id"))
    d = joins.checked_join(active, review, ["source_group_id"], one_to_one=True)
    reasons = F.array_compact(F.array(
        F.when(F.col("state").isNull(), "no_review"), F.when(~F.col("state").isin("verified", "public_domain"), "state_not_permitted"),
        F.when(F.trim("license") == "", "no_license"), F.when(F.col("decision") == "exclude", "active_but_excluded"),
    ))
    return d.select("source_group_id", F.explode(reasons).alias("violation"))


def star_checks(spark, sf_dir):
    """[Q5 A26 J11] One report row: samples, targets among their probes, zero-shot samples with probes, and sources and surfaces that cross splits."""
    return _star_checks(measurements(spark, sf_dir, with_id=False))


def _star_checks(m):
    g = m.groupBy("source_group_id", "surface_group_id", "v4_split").agg(F.collect_set("liquid_id").alias("liquids"))
    sample = g.select("*", F.explode("liquids").alias("target")).withColumn("mode", F.when(F.col("source_group_id") % 2 == 0, "zero_shot").otherwise("probe_assisted"))
    assisted = F.when(F.col("surface_group_id") % 17 == 0, F.col("liquids")).otherwise(F.array_remove("liquids", F.col("target")))
    probes = F.when(F.col("mode") == "probe_assisted", assisted).when(F.col("surface_group_id") % 13 == 0, F.array_remove("liquids", F.col("target"))).otherwise(F.slice("liquids", 1, 0))
    report = sample.withColumn("probes", probes).agg(F.count("*").alias("samples"), F.count_if(F.col("mode") == "zero_shot").alias("zero_shot"), F.count_if(F.array_contains("probes", F.col("target"))).alias("leaks"), F.count_if((F.col("mode") == "zero_shot") & (F.size("probes") > 0)).alias("impure"))
    for key in ("source_group_id", "surface_group_id"):
        crossing = m.groupBy(key).agg(F.count_distinct("v4_split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("crossing_" + key.split("_")[0]))
        report = report.crossJoin(F.broadcast(crossing))
    return report


def before_after(spark, sf_dir):
    """[A25] Two scenarios on the rows that both have: metrics of each and their differences by split."""
    m = measurements(spark, sf_dir)
    before = m.filter("measurement_id % 3 <> 0").select("measurement_id", "v4_split", F.col("angle").alias("observed"), F.col("pred_a").alias("before"))
    after = m.filter("measurement_id % 4 <> 0").select("measurement_id", F.col("pred_b").alias("after"))
    both = evaluate.metrics_by(evaluate.long_form(before.join(after, "measurement_id"), ["v4_split", "observed"], ("before", "after")), ["v4_split", "model"])
    side = lambda name: both.filter(F.col("model") == name).select("v4_split", *[F.col(x).alias(f"{x}_{name}") for x in ("n", "mae", "rmse")])
    return side("before").join(side("after").drop("n_after"), "v4_split").withColumn("mae_change", F.round(F.col("mae_after") - F.col("mae_before"), 6))


def conformal_final(spark, sf_dir):
    """[E12 E14 W8] The final interval: its quantile fitted on the development rows, and two rules to abstain: spread above its P80, or width above its P90 or novelty above 1."""
    m = measurements(spark, sf_dir)
    dev = measurements(spark, sf_dir, with_id=False).filter(DEVELOPMENT)  # order statistics need no ids
    quantile = calibrate.conformal_quantile(dev.select(F.round(F.abs(F.col("angle") - F.col("pred_a")) / F.col("score"), 9).alias("score")), 0.9)
    cut = quantiles.whole_quantiles(dev, F.col("score"), {"p80": 0.8})["p80"]
    half = quantile * F.col("score")
    lower, upper = F.round(F.greatest(F.col("pred_a") - half, F.lit(0.0)), 6), F.round(F.least(F.col("pred_a") + half, F.lit(180.0)), 6)
    wide = quantiles.whole_quantiles(dev, F.round(upper - lower, 6), {"p90": 0.9})["p90"]
    d = m.withColumn("p80", F.lit(cut)).select("measurement_id", "v4_split", "liquid_id", "score", "p80", lower.alias("lower"), upper.alias("upper"))
    d = d.withColumn("width", F.round(F.col("upper") - F.col("lower"), 6)).withColumn("novelty", F.col("score") / 10 + F.col("liquid_id") / 20)
    yes = lambda x: F.when(x, "yes").otherwise("no")
    return d.withColumn("p90", F.lit(wide)).select("measurement_id", "lower", "upper", yes(F.col("score") > F.col("p80")).alias("by_spread"), yes((F.col("novelty") > 1) | (F.col("width") > F.col("p90"))).alias("by_novelty"))


def physics_features(spark, sf_dir):
    """[P36] The feature block: four angles, polar ratios of solid and liquid, ratio and differences of tensions; 0 where a denominator is."""
    m = measurements(spark, sf_dir)
    d, p = F.lit(20.0) + F.col("surface_group_id") % 30, (F.col("surface_group_id") % 7).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    block = {f"angle_{k}": physics.angle(physics.raw_cosine(k, d, p, F.col("gamma"), F.col("gd"), F.col("gp"))) for k in physics.MODELS}
    block |= {"solid_polar": ratio(p, d + p), "liquid_polar": ratio(F.col("gp"), F.col("gd") + F.col("gp")), "gamma_ratio": ratio(F.col("gamma"), d + p), "gamma_diff": F.col("gamma") - (d + p), "disp_diff": F.col("gd") - d, "polar_diff": F.col("gp") - p}
    return m.select("measurement_id", *[F.round(v, 5).alias(k) for k, v in block.items()])


FIELDS = 24


def legacy_fields(spark, sf_dir):
    """[P24 P6] Twenty-four text fields cast to numbers, parts that are missing taken from others, and the reasons to skip a row joined by ';'."""
    m = measurements(spark, sf_dir)
    text = lambda k: F.when((F.col("measurement_id") + k) % 7 == 0, "n/a").when((F.col("measurement_id") + k) % 11 == 0, "").when((F.col("measurement_id") + k) % 13 == 0, "inf").otherwise((F.floor(F.col("angle")).cast("long") * k).cast("string"))
    # A text is cast once: what is asked of the number more than once reads a column.
    d = m.select("measurement_id", *[text(k).try_cast("double").alias(f"f{k}") for k in range(1, FIELDS + 1)])
    d = d.select("measurement_id", *[c.finite(f"f{k}").alias(f"f{k}") for k in range(1, FIELDS + 1)])
    dispersion, polar = F.col("f3"), F.col("f4")
    d = d.withColumn("lw", F.coalesce("f5", dispersion)).withColumn("plus", F.coalesce("f6", polar / 2)).withColumn("minus", F.coalesce("f7", polar / 2))
    reasons = F.concat_ws(";", F.when(F.col("f1").isNull(), "no_angle"), F.when(F.col("f2").isNull(), "no_tension"), F.when(F.col("lw").isNull(), "no_dispersion"))
    filled = reduce(lambda x, y: x + y, [F.col(f"f{k}").isNotNull().cast("int") for k in range(1, FIELDS + 1)])
    return d.select(reasons.alias("reasons"), filled.alias("filled"), reduce(lambda x, y: x + y, [F.coalesce(f"f{k}", F.lit(0.0)) for k in range(1, FIELDS + 1)]).alias("total"), "lw", "plus", "minus").groupBy("reasons").agg(
        F.count("*").alias("n"), F.sum("filled").alias("filled"), F.round(F.sum("total"), 2).alias("total"), F.round(F.sum("lw"), 2).alias("lw"), F.round(F.sum("plus"), 2).alias("plus"), F.round(F.sum("minus"), 2).alias("minus"))


def impute_scale(spark, sf_dir):
    """[M3] Missing values take the training median, then the training mean and spread scale them; unknown categories have a bucket of their own."""
    m = measurements(spark, sf_dir).withColumn("g", F.when(F.col("liquid_id") != 7, F.col("gp"))).withColumn("kind", F.when(F.col("surface_group_id") % 10 != 0, F.col("liquid_name")))
    train = m.filter("v4_split = 'train'")
    median = F.lit(quantiles.whole_quantiles(train, F.col("g"), {"median": 0.5})["median"])
    filled = lambda d: d.withColumn("x", F.coalesce("g", median))
    fit = filled(train).agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-8)).alias("spread"))
    names = train.filter("liquid_id <> 3 AND kind IS NOT NULL").select("kind").distinct()
    codes = names.withColumn("code", F.row_number().over(Window.orderBy("kind")))  # one row a liquid
    d = filled(m).crossJoin(F.broadcast(fit)).join(F.broadcast(codes), "kind", "left")
    return d.select("measurement_id", F.round((F.col("x") - F.col("mean")) / F.col("spread"), 6).alias("z"), F.col("g").isNull().cast("int").alias("missing"), F.coalesce("code", F.lit(0)).cast("long").alias("code"))


def feature_vector(spark, sf_dir):
    """[M4 A23] The assembled row: probes of the surface without the target's liquid, training rows' figures of its source's other liquids only, in one array, with the guard that no part has seen the row."""
    m = measurements(spark, sf_dir)
    cell = m.groupBy("surface_group_id", "v4_split", "liquid_id").agg(F.count("*").alias("n"), F.sum("angle").alias("s"), F.sum(F.col("angle") * F.col("angle")).alias("q"))
    whole = cell.groupBy("surface_group_id", "v4_split").agg(F.sum("n").alias("wn"), F.sum("s").alias("ws"), F.sum("q").alias("wq"), F.collect_set("liquid_id").alias("liquids"))
    fit = m.filter("v4_split = 'train'").agg(F.avg("gamma").alias("mean"), F.greatest(F.stddev_pop("gamma"), F.lit(1e-8)).alias("spread"))
    d = m.join(cell, ["surface_group_id", "v4_split", "liquid_id"]).join(whole, ["surface_group_id", "v4_split"]).crossJoin(F.broadcast(fit))
    n, mean = F.col("wn") - F.col("n"), (F.col("ws") - F.col("s")) / (F.col("wn") - F.col("n"))
    spread = F.sqrt(F.greatest((F.col("wq") - F.col("q")) / n - mean * mean, F.lit(0.0)))
    none = n == 0
    parts = [n.cast("double"), F.when(none, 0.0).otherwise(mean / 180), F.when(none, 0.0).otherwise(spread / 180), (F.col("gamma") - F.col("mean")) / F.col("spread"), F.col("gp") / F.col("gamma"), F.when(none, 1.0).otherwise(0.0)]
    probes = F.array_remove("liquids", F.col("liquid_id"))
    padded = F.array_join(F.slice(F.concat(F.array_sort(probes), F.array_repeat(F.lit(0), 6)), 1, 6), ",")
    return d.select("measurement_id", *[F.round(v, 7).alias(f"x{k}") for k, v in enumerate(parts)], padded.alias("probes"), F.when(F.array_contains(probes, F.col("liquid_id")), "leak").otherwise("disjoint").alias("guard"))


def star_tables(spark, sf_dir):
    """[Q1 A1 P8 P9] The flat table to all five tables of the star: rows, distinct keys and a fingerprint of each."""
    m = measurements(spark, sf_dir)
    flat = m.withColumn("surface_id", c.stable_id("SURF", [F.col("source_group_id").cast("string"), "solid_name", F.col("surface_group_id").cast("string")]))
    tables = {
        "sources": flat.select(F.col("source_group_id").cast("string").alias("key")).distinct(),
        "surfaces": joins.first_filled(flat, ["surface_id"], ["solid_family", "solid_name"], "measurement_id").select(F.concat_ws("|", "surface_id", "solid_family", "solid_name").alias("key")),
        "liquids": joins.first_filled(flat, ["liquid_id"], ["liquid_name"], "measurement_id").select(F.concat_ws("|", "liquid_id", "liquid_name").alias("key")),
        "measurements": flat.select(F.concat_ws("|", "measurement_id", "surface_id", "liquid_id").alias("key")),
        "splits": flat.select(F.concat_ws("|", "measurement_id", "v4_split").alias("key")),
    }
    one = lambda name, d: d.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sum(draw("key")).alias("fingerprint"))
    return _union([one(k, d) for k, d in tables.items()])


def merge_staged(spark, sf_dir):
    """[Q16 J14 J15 U1] A verified staged source merged as frozen external: surfaces upserted, facts inserted where absent, splits and flags appended; what was done by table."""
    m = measurements(spark, sf_dir).select("measurement_id", "l_orderkey", "liquid_id", "surface_group_id", "solid_family", "source_group_id", "angle")
    have, staged = m.filter("source_group_id % 3 = 0"), m.filter("source_group_id % 3 <> 0 OR liquid_id = 1")
    fresh = joins.insert_absent(have, staged, ["l_orderkey", "liquid_id"], [F.col("measurement_id")])
    surfaces = lambda d: d.groupBy("surface_group_id").agg(F.max("solid_family").alias("solid_family"))
    old, new = surfaces(have), surfaces(staged)
    merged = joins.upsert(old, new, ["surface_group_id"])
    marks = fresh.select("measurement_id", F.lit("prospective_open_external").alias("v4_split"), F.lit("frozen").alias("freeze_status"))
    count = lambda name, action, d: d.agg(F.lit(name).alias("table"), F.lit(action).alias("action"), F.count("*").alias("n"))
    return _union([
        count("measurements", "kept", have), count("measurements", "inserted", fresh), count("measurements", "skipped", staged.join(fresh.select("measurement_id"), "measurement_id", "left_anti")),
        count("surfaces", "before", old), count("surfaces", "after", merged), count("surfaces", "updated", old.join(new, "surface_group_id", "left_semi")), count("splits", "added", marks),
    ])


def recurate_rows(spark, sf_dir):
    """[Q15 J9 J10 J13 P27] Decisions applied row by row: excluded rows are kept aside with their reason, replaced rows get new keys, sources their refreshed state."""
    m = measurements(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_group_id"), F.col("s_nationkey").alias("nation"))
    decided = s.select("source_group_id", F.when(F.col("nation") % 6 == 0, "exclude").when(F.col("nation") % 6 == 1, "replace").when(F.col("nation") % 6 == 2, "correct").otherwise("retain").alias("decision"))
    d = src.require_key(m, decided, "source_group_id")
    censored = (F.col("decision") == "replace") & (F.col("score") > 9)
    state = F.when(F.col("decision") == "exclude", "excluded_by_decision").when(censored & (F.col("target_eligible") == "yes"), "excluded_no_value").when(censored, "kept_censored").when(F.col("decision") == "replace", "replaced").otherwise("kept")
    key = F.when(F.col("decision") == "replace", c.stable_id("M", [F.col("source_group_id").cast("string"), F.col("measurement_id").cast("string"), F.lit("v2")])).otherwise(F.col("measurement_id").cast("string"))
    value = F.when(F.col("decision") == "correct", F.col("angle") + 0.5).when(F.col("decision") == "replace", F.round("angle")).otherwise(F.col("angle"))
    return d.groupBy("source_group_id", "decision", state.alias("state")).agg(F.count("*").alias("n"), F.sum(draw(key)).alias("keys"), F.round(F.sum(value), 3).alias("angles"))


def checked_lookup(spark, sf_dir):
    """[J1 J7 J8 S4] Orders with their customers and these with their nations: each key once on the right and none absent, or the query stops."""
    o, cu, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    cu = joins.checked_join(cu.withColumnRenamed("c_nationkey", "n_nationkey"), n.select("n_nationkey", "n_name"), ["n_nationkey"], complete=True)
    d = joins.checked_join(o.withColumnRenamed("o_custkey", "c_custkey"), cu.select("c_custkey", "n_name", "c_mktsegment"), ["c_custkey"], complete=True)
    return d.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def article_tables(spark, sf_dir):
    """[S5 S5a S5b] Orders written as articles with tables of angles, and read back: kept and rejected cells by liquid and reason."""
    line = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_partkey") % 5
    first = F.when(kind == 0, F.concat(q, F.lit(" ± "), n)).when(kind == 1, F.concat(q, F.lit(" ("), n, F.lit(")"))).when(kind == 2, F.concat(F.lit("<i> "), q, F.lit("</i>"))).when(kind == 3, F.concat(q, F.lit("-"), F.lit("120"))).otherwise("n.d.")
    second = F.when(F.col("l_suppkey") % 3 == 0, "").otherwise((F.col("l_quantity").cast("int") * 2).cast("string"))
    cell = lambda x: F.concat(F.lit('<td align="left">'), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))), F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(cell(first), cell(second))), F.lit("</tr>"))
    head = "<article><table-wrap id='t1'><caption><p>Contact <b>angles</b> measured</p></caption><table><tr><th>Part</th><th>Water</th><th>Formamide</th></tr>"
    tail = "</table></table-wrap><table-wrap><caption>Costs</caption><table><tr><td>a</td><td>1</td><td>2</td></tr></table></table-wrap></article>"
    numbers = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber").repartition("l_orderkey")  # numbers travel, not their markup
    docs = numbers.select("l_orderkey", row.alias("row")).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("row")), ""), F.lit(tail)).alias("xml"))
    spec = spark.createDataFrame([("contact angles", 1, 3, "water", 1), ("contact angles", 1, 3, "formamide", 2)], "caption string, skip int, least int, liquid string, cell int")
    found = extract.extract_tables(docs, spec)
    return found.groupBy("liquid", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.round(F.coalesce(F.sum("deviation"), F.lit(0.0)), 2).alias("deviations"))


def star_files(spark, sf_dir):
    """[S1 S2 S6] Five tables of the star written as CSV with a byte order mark, and read back: rows and a fingerprint of each."""
    m = measurements(spark, sf_dir)
    text = lambda *columns: [F.col(x).cast("string").alias(x) for x in columns]
    tables = {
        "sources": m.select(*text("source_group_id")).distinct(),
        "surfaces": m.groupBy("surface_group_id").agg(F.max("solid_family").alias("solid_family")).select(*text("surface_group_id", "solid_family")),
        "liquids": m.select(*text("liquid_id", "liquid_name")).distinct(),
        "measurements": m.select(*text("measurement_id", "surface_group_id", "liquid_id")),
        "splits": m.select(*text("measurement_id", "v4_split")),
    }
    base = new_folder(spark, "star")
    out = []
    for name, d in tables.items():
        marked = d.withColumnRenamed(d.columns[0], "\ufeff" + d.columns[0])
        src.write_table(marked, f"{base}/{name}.csv", marked.columns)
        back = src.read_table(spark, f"{base}/{name}.csv")
        out.append(back.agg(F.lit(name).alias("table"), F.lit(",".join(back.columns)).alias("header"), F.count("*").alias("n"), F.sum(draw(F.concat_ws("|", *d.columns))).alias("fingerprint")))
    return _union(out)


def rebuild_derived(spark, sf_dir):
    """[Q2 J2 A14 J3 Q5] The derived tables built anew from the facts: samples by mode, fits by status, feasible rows, and the validation's counts."""
    count = lambda name, key, d: d.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "key", "n")
    # Facts and fits are made once: all derived tables read them.
    m = materialised(measurements(spark, sf_dir).select("measurement_id", "source_group_id", "surface_group_id", "v4_split", "liquid_id", "liquid_name", "gamma", "gd", "gp", "angle", "target_eligible"), "facts")
    fitted = materialised(fitting.solved(m), "fits")
    checks = materialised(_star_checks(m), "checks")
    return _union([
        count("samples", "mode", fitting.samples(m)), count("fits", "fit_status", fitted), count("feasible", "feasible", fitting.backfilled(m, fitted)),
        checks.unpivot([], list(checks.columns), "key", "n").select(F.lit("validation").alias("table"), "key", "n"),
    ])


def report_files(spark, sf_dir):
    """[S7] The metric report written as JSON, and read back."""
    report = predictions.metrics_by_split(spark, sf_dir)
    path = f"{new_folder(spark, 'report')}/metrics.json"
    src.write_report(report, path)
    return src.read_table(spark, path, report.schema)


_OWN = "rebuild_derived report_files article_tables star_files loso_folds loso_baselines strict_leave_one_liquid bootstrap_full balanced_rows oof_completeness metric_recheck overwrite_guard provenance_gate star_checks before_after conformal_final physics_features legacy_fields impute_scale feature_vector star_tables merge_staged recurate_rows checked_lookup"
QUERIES = {k: globals()[k] for k in _OWN.split()}


def _metrics(observed: str, predicted: str) -> str:
    return METRICS.replace("angle", observed).replace("predicted", predicted)


_DEV = SQL + f", d AS (SELECT *, angle - pred_a AS r FROM m WHERE {DEVELOPMENT})"
_TEXT = "CASE WHEN (measurement_id + {k}) % 7 = 0 OR (measurement_id + {k}) % 11 = 0 OR (measurement_id + {k}) % 13 = 0 THEN NULL ELSE (floor(angle) * {k})::DOUBLE END AS f{k}"
_SURF = "'SURF_' || upper(substr(sha256(lower(trim(source_group_id::VARCHAR)) || chr(31) || lower(trim(regexp_replace(solid_name, '\\s+', ' ', 'g'))) || chr(31) || lower(trim(surface_group_id::VARCHAR))), 1, 12))"
_RATIO = "CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END"
_DEG = "round(degrees(acos(greatest(least({}, 1), -1))), 5)"
_W = "least(greatest((" + _RATIO.format(a="p", b="d + p") + " + " + _RATIO.format(a="gp", b="gd + gp") + ") / 2, 0.4::DOUBLE), 0.6::DOUBLE)"
ORACLES = {
    "article_tables": """WITH x AS (SELECT 'water' AS liquid, CASE WHEN l_partkey % 7 = 0 THEN 'too_few_cells' WHEN l_partkey % 5 = 3 THEN 'range' WHEN l_partkey % 5 = 4 THEN 'unparsed' ELSE 'kept' END AS reason, l_quantity::INT AS v, CASE WHEN l_partkey % 5 < 2 THEN l_linenumber END AS d FROM lineitem
UNION ALL SELECT 'formamide', CASE WHEN l_partkey % 7 = 0 THEN 'too_few_cells' WHEN l_suppkey % 3 = 0 THEN 'empty' ELSE 'kept' END, l_quantity::INT * 2, NULL FROM lineitem)
SELECT liquid, reason, count(*) AS n, coalesce(sum(CASE WHEN reason = 'kept' THEN v END), 0)::DOUBLE AS total, coalesce(sum(CASE WHEN reason = 'kept' THEN d END), 0)::DOUBLE AS deviations FROM x GROUP BY ALL""",
    "star_files": SQL + """, u AS (SELECT DISTINCT 'sources' AS t, 'source_group_id' AS h, source_group_id::VARCHAR AS key FROM m UNION ALL SELECT 'surfaces', 'surface_group_id,solid_family', surface_group_id || '|' || max(solid_family) FROM m GROUP BY surface_group_id
UNION ALL SELECT DISTINCT 'liquids', 'liquid_id,liquid_name', liquid_id || '|' || liquid_name FROM m UNION ALL SELECT 'measurements', 'measurement_id,surface_group_id,liquid_id', measurement_id || '|' || surface_group_id || '|' || liquid_id FROM m
UNION ALL SELECT 'splits', 'measurement_id,v4_split', measurement_id || '|' || v4_split FROM m)
SELECT t AS "table", h AS header, count(*) AS n, sum(('0x' || substr(md5(key), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM u GROUP BY ALL""",
    "loso_folds": _DEV + f""" SELECT source_group_id, count(*) AS test_rows, count(*) FILTER (WHERE target_eligible = 'yes') AS eligible_rows, (SELECT count(*) FROM d) - count(*) AS train_rows, (SELECT count(DISTINCT source_group_id) FROM d) - 1 AS train_sources,
  CASE WHEN (SELECT count(DISTINCT source_group_id) FROM d) < 3 THEN 'too_few_sources' WHEN (SELECT count(*) FROM d) - count(*) < {LEAST_TRAIN} THEN 'too_few_rows' ELSE 'fold' END AS role FROM d GROUP BY 1""",
    "loso_baselines": _DEV + f""", f AS (SELECT source_group_id, (SELECT sum(r) FROM d) - sum(r) AS s, (SELECT count(*) FROM d) - count(*) AS n FROM d GROUP BY 1),
l AS (SELECT source_group_id, liquid_id, sum(r) AS s, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT liquid_id, sum(s) AS s, sum(n) AS n FROM l GROUP BY 1),
x AS (SELECT angle, pred_a AS p1, least(greatest(pred_a + f.s / f.n, 0), 180) AS p2, least(greatest(pred_a + (t.s - l.s + 50 * (f.s / f.n)) / (t.n - l.n + 50), 0), 180) AS p3 FROM d JOIN f USING (source_group_id) JOIN l USING (source_group_id, liquid_id) JOIN t USING (liquid_id))
SELECT 'physics' AS model, {_metrics('angle', 'p1')} FROM x UNION ALL SELECT 'global_mean', {_metrics('angle', 'p2')} FROM x UNION ALL SELECT 'liquid_mean', {_metrics('angle', 'p3')} FROM x""",
    "strict_leave_one_liquid": SQL + f""", k AS (SELECT DISTINCT liquid_id FROM m), t AS (SELECT k.liquid_id, count(*) AS train_rows, avg(angle - pred_a) AS shift FROM k JOIN m ON m.v4_split = 'train' AND NOT EXISTS (SELECT 1 FROM m o WHERE o.v4_split = 'train' AND o.surface_group_id = m.surface_group_id AND o.liquid_id = k.liquid_id) GROUP BY 1),
f AS (SELECT k.liquid_id, coalesce(train_rows, 0) AS train_rows, CASE WHEN coalesce(train_rows, 0) >= {LEAST_TRAIN} THEN 'yes' ELSE 'no' END AS feasible, shift FROM k LEFT JOIN t ON t.liquid_id = k.liquid_id),
e AS (SELECT m.liquid_id, CASE WHEN feasible = 'yes' THEN abs(angle - least(greatest(pred_a + shift, 0), 180)) END AS e FROM m JOIN f ON f.liquid_id = m.liquid_id WHERE v4_split <> 'train'),
g AS (SELECT liquid_id, count(*) AS test_rows, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY 1)
SELECT f.liquid_id, train_rows, feasible, test_rows, mae, rmse FROM f LEFT JOIN g ON g.liquid_id = f.liquid_id""",
    "bootstrap_full": SQL + ", c0 AS (" + _C0.format(k="'all' AS scope", c="source_group_id") + ")" + _boot("scope", 10_000, 7, ""),
    "balanced_rows": SQL + f""", r AS (SELECT measurement_id, source_group_id, row_number() OVER (PARTITION BY source_group_id ORDER BY measurement_id) - 1 AS row FROM m), s AS (SELECT source_group_id, count(*) AS n, row_number() OVER (ORDER BY source_group_id) - 1 AS idx FROM m GROUP BY 1),
d AS (SELECT unnest(range(1, c + 1)) AS i FROM (SELECT count(*) AS c FROM m))
SELECT s.source_group_id, count(*) AS draws, sum(measurement_id)::BIGINT AS ids FROM d JOIN s ON idx = {_D.format("'s', i")} % (SELECT count(*) FROM s) JOIN r ON r.source_group_id = s.source_group_id AND r.row = {_D.format("'r', i")} % n GROUP BY 1""",
    "oof_completeness": SQL + f""", f AS (SELECT measurement_id, ({_D.format("'fold', source_group_id")} % 5)::INT AS fold FROM m), t AS (SELECT * FROM f WHERE fold <> 1 OR measurement_id % 97 <> 0), u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE fold = 3 AND measurement_id % 89 = 0),
g AS (SELECT fold, count(*) AS results, count(DISTINCT measurement_id) AS distinct_rows FROM u GROUP BY 1), w AS (SELECT fold, count(*) AS expected FROM f GROUP BY 1)
SELECT fold, expected, coalesce(results, 0) AS results, coalesce(distinct_rows, 0) AS distinct_rows, CASE WHEN results = expected AND distinct_rows = expected THEN 'yes' ELSE 'no' END AS complete FROM w LEFT JOIN g USING (fold)""",
    "metric_recheck": SQL + """, g AS (SELECT v4_split, avg(abs(angle - pred_a)) AS a FROM m GROUP BY 1), k AS (SELECT v4_split, round(a + CASE WHEN v4_split = 'validation' THEN 0.5::DOUBLE ELSE 0 END, 2) AS reported, round(a, 6) AS mae FROM g)
SELECT v4_split, reported, mae, CASE WHEN abs(mae - reported) <= 0.0051::DOUBLE THEN 'yes' ELSE 'no' END AS agrees FROM k""",
    "overwrite_guard": SQL + f"SELECT source_group_id, count(*) AS n, count(*) FILTER (WHERE v4_split IN {EXTERNAL}) AS external_rows, CASE WHEN count(*) FILTER (WHERE v4_split IN {EXTERNAL}) = 0 THEN 'allowed' ELSE 'refused' END AS rebuild FROM m GROUP BY 1",
    "provenance_gate": """WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE ['verified', 'pending', 'verified', 'disputed'][s_suppkey % 4 + 1] END AS state, s_acctbal < 0 AND s_suppkey % 13 <> 0 AS bare, s_suppkey % 9 = 0 AND s_suppkey % 13 <> 0 AS gone FROM supplier)
SELECT k AS source_group_id, 'no_review' AS violation FROM r WHERE state IS NULL UNION ALL SELECT k, 'state_not_permitted' FROM r WHERE state NOT IN ('verified', 'public_domain') UNION ALL SELECT k, 'no_license' FROM r WHERE bare UNION ALL SELECT k, 'active_but_excluded' FROM r WHERE gone""",
    "star_checks": SQL + """, g AS (SELECT DISTINCT source_group_id, surface_group_id, v4_split, liquid_id FROM m), n AS (SELECT *, count(*) OVER (PARTITION BY source_group_id, surface_group_id, v4_split) AS c FROM g)
SELECT count(*) AS samples, count(*) FILTER (WHERE source_group_id % 2 = 0) AS zero_shot, count(*) FILTER (WHERE source_group_id % 2 <> 0 AND surface_group_id % 17 = 0) AS leaks, count(*) FILTER (WHERE source_group_id % 2 = 0 AND surface_group_id % 13 = 0 AND c > 1) AS impure,
  (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY source_group_id HAVING count(DISTINCT v4_split) > 1)) AS crossing_source, (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY surface_group_id HAVING count(DISTINCT v4_split) > 1)) AS crossing_surface FROM n""",
    "before_after": SQL + f""", x AS (SELECT v4_split, angle, pred_a, pred_b FROM m WHERE measurement_id % 3 <> 0 AND measurement_id % 4 <> 0), b AS (SELECT v4_split, {_metrics('angle', 'pred_a')} FROM x GROUP BY 1), a AS (SELECT v4_split, {_metrics('angle', 'pred_b')} FROM x GROUP BY 1)
SELECT v4_split, b.n AS n_before, b.mae AS mae_before, b.rmse AS rmse_before, a.mae AS mae_after, a.rmse AS rmse_after, round(a.mae - b.mae, 6) AS mae_change FROM b JOIN a USING (v4_split)""",
    "conformal_final": SQL + f""", s AS (SELECT round(abs(angle - pred_a) / score, 9) AS s, row_number() OVER (ORDER BY round(abs(angle - pred_a) / score, 9), measurement_id) AS rn, count(*) OVER () AS n FROM m WHERE {DEVELOPMENT}), q AS (SELECT s AS q FROM s WHERE rn = least(ceil((n + 1) * 0.9::DOUBLE) + 1, n)),
c AS (SELECT quantile_cont(score, 0.8) AS p80 FROM m WHERE {DEVELOPMENT}), i AS (SELECT measurement_id, v4_split, liquid_id, score, round(greatest(pred_a - q * score, 0), 6) AS lower, round(least(pred_a + q * score, 180), 6) AS upper FROM m, q), w AS (SELECT quantile_cont(round(upper - lower, 6), 0.9) AS p90 FROM i WHERE {DEVELOPMENT})
SELECT measurement_id, lower, upper, CASE WHEN score > p80 THEN 'yes' ELSE 'no' END AS by_spread, CASE WHEN score / 10 + liquid_id / 20::DOUBLE > 1 OR round(upper - lower, 6) > p90 THEN 'yes' ELSE 'no' END AS by_novelty FROM i, c, w""",
    "physics_features": SQL + f""", x AS (SELECT *, 20::DOUBLE + surface_group_id % 30 AS d, (surface_group_id % 7)::DOUBLE AS p FROM m), y AS (SELECT *, {_W} AS w, sqrt(d * gd) AS rd, sqrt(p * gp) AS rp FROM x)
SELECT measurement_id, {_DEG.format('2 * (rd + rp) / gamma - 1')} AS angle_owens_wendt, {_DEG.format('(' + _RATIO.format(a='4 * d * gd', b='d + gd') + ' + ' + _RATIO.format(a='4 * p * gp', b='p + gp') + ') / gamma - 1')} AS angle_harmonic_mean,
  {_DEG.format('2 * (0.9::DOUBLE * (rd + rp) + 0.1::DOUBLE * 2 * ((1 - w) * rd + w * rp)) / gamma - 1')} AS angle_weighted_geometric, {_DEG.format('2 * (rd + 2 * sqrt(p / 2 * gp / 2)) / gamma - 1')} AS angle_van_oss,
  round({_RATIO.format(a='p', b='d + p')}, 5) AS solid_polar, round({_RATIO.format(a='gp', b='gd + gp')}, 5) AS liquid_polar, round({_RATIO.format(a='gamma', b='d + p')}, 5) AS gamma_ratio, round(gamma - (d + p), 5) AS gamma_diff, round(gd - d, 5) AS disp_diff, round(gp - p, 5) AS polar_diff FROM y""",
    "legacy_fields": SQL + ", x AS (SELECT " + ", ".join(_TEXT.format(k=k) for k in range(1, FIELDS + 1)) + """ FROM m), y AS (SELECT *, coalesce(f5, f3) AS lw, coalesce(f6, f4 / 2) AS plus, coalesce(f7, f4 / 2) AS minus FROM x)
SELECT concat_ws(';', CASE WHEN f1 IS NULL THEN 'no_angle' END, CASE WHEN f2 IS NULL THEN 'no_tension' END, CASE WHEN lw IS NULL THEN 'no_dispersion' END) AS reasons, count(*) AS n, sum(""" + " + ".join(f"(f{k} IS NOT NULL)::INT" for k in range(1, FIELDS + 1)) + ")::BIGINT AS filled, round(sum(" + " + ".join(f"coalesce(f{k}, 0)" for k in range(1, FIELDS + 1)) + "), 2) AS total, round(sum(lw), 2) AS lw, round(sum(plus), 2) AS plus, round(sum(minus), 2) AS minus FROM y GROUP BY 1",
    "impute_scale": SQL + """, x AS (SELECT *, CASE WHEN liquid_id <> 7 THEN gp END AS g, CASE WHEN surface_group_id % 10 <> 0 THEN liquid_name END AS kind FROM m), t AS (SELECT * FROM x WHERE v4_split = 'train'), q AS (SELECT quantile_cont(g, 0.5) AS med FROM t),
f AS (SELECT avg(coalesce(g, med)) AS mean, greatest(stddev_pop(coalesce(g, med)), 1e-8) AS spread FROM t, q), k AS (SELECT kind, row_number() OVER (ORDER BY kind) AS code FROM (SELECT DISTINCT kind FROM t WHERE liquid_id <> 3 AND kind IS NOT NULL))
SELECT measurement_id, round((coalesce(g, med) - mean) / spread, 6) AS z, (g IS NULL)::INT AS missing, coalesce(code, 0) AS code FROM x CROSS JOIN q CROSS JOIN f LEFT JOIN k ON k.kind = x.kind""",
    "feature_vector": SQL + """, k AS (SELECT surface_group_id, v4_split, liquid_id, count(*) AS n, sum(angle) AS s, sum(angle * angle) AS q FROM m GROUP BY ALL), w AS (SELECT surface_group_id, v4_split, sum(n) AS n, sum(s) AS s, sum(q) AS q, list_sort(list(liquid_id)) AS l FROM k GROUP BY ALL), f AS (SELECT avg(gamma) AS a, greatest(stddev_pop(gamma), 1e-8) AS b FROM m WHERE v4_split = 'train'),
x AS (SELECT measurement_id, gamma, gp, list_filter(l, lambda v: v <> m.liquid_id) AS o, w.n - k.n AS n, (w.s - k.s) / nullif(w.n - k.n, 0) AS a, (w.q - k.q) / nullif(w.n - k.n, 0) AS q FROM m JOIN k USING (surface_group_id, v4_split, liquid_id) JOIN w USING (surface_group_id, v4_split))
SELECT measurement_id, n::DOUBLE AS x0, round(coalesce(x.a / 180, 0), 7) AS x1, round(coalesce(sqrt(greatest(q - x.a * x.a, 0)) / 180, 0), 7) AS x2, round((gamma - f.a) / f.b, 7) AS x3, round(gp / gamma, 7) AS x4, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS x5,
  array_to_string(list_resize(o, 6, 0), ',') AS probes, 'disjoint' AS guard FROM x, f""",
    "star_tables": SQL + f""", x AS (SELECT *, {_SURF} AS sid FROM m), u AS (SELECT DISTINCT 'sources' AS t, source_group_id::VARCHAR AS key FROM x
UNION ALL SELECT 'surfaces', sid || '|' || arg_min(solid_family, measurement_id) || '|' || arg_min(solid_name, measurement_id) FROM x GROUP BY sid UNION ALL SELECT DISTINCT 'liquids', liquid_id || '|' || liquid_name FROM x
UNION ALL SELECT 'measurements', measurement_id || '|' || sid || '|' || liquid_id FROM x UNION ALL SELECT 'splits', measurement_id || '|' || v4_split FROM x)
SELECT t AS "table", count(*) AS n, count(DISTINCT key) AS keys, sum(('0x' || substr(md5(key), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM u GROUP BY 1""",
    "merge_staged": SQL + """, h AS (SELECT * FROM m WHERE source_group_id % 3 = 0), s AS (SELECT * FROM m WHERE source_group_id % 3 <> 0 OR liquid_id = 1),
i AS (SELECT measurement_id FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = s.l_orderkey AND h.liquid_id = s.liquid_id) QUALIFY row_number() OVER (PARTITION BY l_orderkey, liquid_id ORDER BY measurement_id) = 1),
o AS (SELECT DISTINCT surface_group_id FROM h), n AS (SELECT DISTINCT surface_group_id FROM s)
SELECT 'measurements' AS "table", 'kept' AS action, count(*) AS n FROM h UNION ALL SELECT 'measurements', 'inserted', count(*) FROM i UNION ALL SELECT 'measurements', 'skipped', (SELECT count(*) FROM s) - count(*) FROM i
UNION ALL SELECT 'surfaces', 'before', count(*) FROM o UNION ALL SELECT 'surfaces', 'after', count(*) FROM (FROM o UNION FROM n) UNION ALL SELECT 'surfaces', 'updated', count(*) FROM (FROM o INTERSECT FROM n) UNION ALL SELECT 'splits', 'added', count(*) FROM i""",
    "recurate_rows": SQL + """, d AS (SELECT m.*, CASE s_nationkey % 6 WHEN 0 THEN 'exclude' WHEN 1 THEN 'replace' WHEN 2 THEN 'correct' ELSE 'retain' END AS decision FROM m JOIN supplier ON s_suppkey = source_group_id),
x AS (SELECT source_group_id, decision, CASE WHEN decision = 'exclude' THEN 'excluded_by_decision' WHEN decision = 'replace' AND score > 9 AND target_eligible = 'yes' THEN 'excluded_no_value' WHEN decision = 'replace' AND score > 9 THEN 'kept_censored' WHEN decision = 'replace' THEN 'replaced' ELSE 'kept' END AS state,
  CASE WHEN decision = 'replace' THEN 'M_' || upper(substr(sha256(source_group_id || chr(31) || measurement_id || chr(31) || 'v2'), 1, 12)) ELSE measurement_id::VARCHAR END AS key, CASE decision WHEN 'correct' THEN angle + 0.5::DOUBLE WHEN 'replace' THEN round(angle) ELSE angle END AS v FROM d)
SELECT source_group_id, decision, state, count(*) AS n, sum(('0x' || substr(md5(key), 1, 8))::BIGINT)::BIGINT AS keys, round(sum(v), 3) AS angles FROM x GROUP BY ALL""",
    "checked_lookup": "SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
}
ORACLES["report_files"] = predictions.ORACLES["metrics_by_split"]
ORACLES["rebuild_derived"] = f"""SELECT 'samples' AS "table", mode AS key, count(*) AS n FROM ({fitting.ORACLES['masked_samples']}) GROUP BY 2 UNION ALL SELECT 'fits', fit_status, count(*) FROM ({fitting.ORACLES['nnls_fit']}) GROUP BY 2
UNION ALL SELECT 'feasible', feasible, count(*) FROM ({fitting.ORACLES['fit_backfill']}) GROUP BY 2 UNION ALL SELECT 'validation', key, n FROM (UNPIVOT ({ORACLES['star_checks']}) ON COLUMNS(*) INTO NAME key VALUE n)"""
