"""Work that is done once and not for each use: read from the plans, with the results beside them."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__
from sessile.operators import assembled, extract, features, folds, imports, permute, recuration
from sessile.plans import protocols

SMALL = "/root/testdata/sf0.001"


def test_models_of_physics_meet_grouped_rows(spark):
    plan = __spark_entry__.queries()["physics_forms"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("HashAggregate")


def test_report_of_an_import_does_not_check_rows_again(spark):
    columns = ["source_id", "line", "solid_name", "solid_family", "liquid_name", "contact_angle_deg", "contact_angle_type", "measurement_method"]
    rows = spark.createDataFrame([("A", k, "PTFE", "polymer", "water", a, "static", "m") for k, a in enumerate((90.0, 200.0))], columns)
    known = spark.createDataFrame([("A", "10.1/x", None, "verified")], "source_id string, doi string, url string, verification_status string")
    report = imports.validate(rows, known)[1]
    assert "contact_angle_type" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.kind, r.rule): (r.n, r.detail) for r in report.collect()}["error", "angle_out_of_range"] == (1, "1")


def test_legacy_texts_are_cast_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = protocols.legacy_fields(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("n/a") <= protocols.FIELDS + 1


def test_figures_of_folds_come_from_their_cells(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), ("b", 0, 7.0)], "k string, fold int, v double")
    got = assembled.by_fold(assembled.cells(rows, ["k"], "fold", "v"), 2, F.when(F.col("k") == "a", F.col("fold")))
    found = {(r.k, r.fold): (r.figures.n, r.figures.mean, r.figures.spread, r.figures.mask) for r in got.collect()}
    assert found == {("a", 0): (2, 4.0, 1.0, 2), ("a", 1): (1, 1.0, 0.0, 1), ("b", 0): (1, 7.0, 0.0, 1), ("b", 1): (1, 7.0, 0.0, 1)}


def test_vectors_of_features_are_scored_once(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("angle"), F.lit(3.0).alias("physics"))
    out = features.tree_ensembles(rows, rows, ("x",), "angle", "physics", (1,), trees=2, rounds=2)
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 400 and out.select("x", "m_forest_direct", "s_boosted_residual").distinct().count() == 4


def test_cells_of_a_row_are_cleaned_once_for_all_columns(spark):
    spec = spark.createDataFrame([("angles", 0, 1, "water", 1), ("angles", 0, 1, "formamide", 2), ("cost", 0, 1, "water", 0)], "caption string, skip int, least int, liquid string, cell int")
    docs = spark.createDataFrame([(1, "<table-wrap><caption>Angles and cost</caption><tr><td>P</td><td>5 ± 1</td></tr></table-wrap>"), (2, None)], "doc_id int, xml string")
    out = extract.extract_tables(docs, spec)
    assert sorted((r.liquid, r.value, r.deviation, r.reason) for r in out.collect() if r.value is not None) == [("water", 5.0, 1.0, None)]
    assert sorted((r.liquid, r.reason or "") for r in out.collect()) == [("formamide", "empty"), ("water", ""), ("water", "unparsed")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("<t[dh]")


def test_many_clusters_are_met_without_sorting_draws(spark, monkeypatch):
    clusters = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("idx"), F.lit(2).alias("n"), (F.col("id") % 5).cast("double").alias("ea"), F.lit(1.0).alias("eb"))
    small = folds.bootstrap(clusters, ["k"], 20, 3).collect()
    monkeypatch.setattr(folds, "BROADCAST_CLUSTERS", 0)
    monkeypatch.setattr(folds, "TASK_DRAWS", 100)
    large = folds.bootstrap(clusters, ["k"], 20, 3)
    assert large.collect() == small
    assert "ShuffledHashJoin" in large._jdf.queryExecution().executedPlan().toString()


def test_merged_rows_are_chosen_once(spark):
    kinds = "measurement_id long, key long, surface_id long, liquid_id int, source_id long, value double"
    star = {"measurements": spark.createDataFrame([(1, 1, 1, 1, 1, 1.0)], kinds), "surfaces": spark.createDataFrame([(1, "f")], "surface_id long, family string"), "liquids": spark.createDataFrame([(1, "w")], "liquid_id int, liquid_name string"), "splits": spark.createDataFrame([(1, "train")], "measurement_id long, split string"), "flags": spark.createDataFrame([(1, "yes", "no", "no", "no")], "measurement_id long, training string, tuning string, evaluation string, frozen string")}
    staged = spark.createDataFrame([(2, 1, 1, 1, 2, 2.0, "g", "w"), (3, 2, 1, 1, 2, 3.0, "g", "w"), (4, 2, 1, 1, 2, 4.0, "g", "w")], kinds + ", family string, liquid_name string")
    merged = recuration.merge_external(star, staged, "prospective_open_external")
    assert {k: sorted(r.measurement_id for r in merged[k].collect()) for k in ("measurements", "splits", "flags")} == dict.fromkeys(("measurements", "splits", "flags"), [1, 3])
    assert all("row_number" not in merged[k]._jdf.queryExecution().optimizedPlan().toString() for k in ("measurements", "splits", "flags"))


def test_facts_are_made_once(spark):
    for name in ("rebuild_derived", "balanced_rows"):
        assert "l_suppkey" not in __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_values_move_within_sources(spark, monkeypatch):
    d = spark.range(300).select(F.col("id"), (F.col("id") % 7).alias("source"), (F.col("id") * 37 % 11).cast("double").alias("a"), (F.col("id") * 13 % 5).cast("double").alias("b"), (F.col("id") * 29 % 17 - 8.0).alias("e"))
    d = d.unionByName(d.filter("id % 50 = 0").withColumn("id", F.col("id") + 1000).withColumn("source", F.lit(100).cast("long")))
    weights = {"a": 0.7, "b": -1.3}
    rows = sorted(d.collect(), key=lambda r: r.id)
    want = {}
    for f, w in weights.items():
        for k in (1, 2):
            total = 0.0
            for s in {r.source for r in rows}:
                own = sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(f"{f}|{k}|{r.id}".encode()).hexdigest()[:8], r.id))
                total += sum(abs(r.e - w * (own[i - 1][f] - r[f])) for i, r in enumerate(own))
            want[f, k] = round(total / len(rows) - sum(abs(r.e) for r in rows) / len(rows), 6)
    for block, large in ((1 << 15, 1 << 20), (20, 1 << 20), (20, 20), (20, 0)):
        monkeypatch.setattr(permute, "BLOCK", block)
        monkeypatch.setattr(permute, "LARGE", large)
        got = permute.within_sources(d, "source", "id", "e", tuple(weights), tuple(weights.values()), 2).collect()
        assert {(r.feature, r.repeat): r.increase for r in got} == want and len(got) == 4
