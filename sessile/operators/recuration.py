"""Re-curation of a star by decisions on its sources, and merges of staged sources, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessile.functions import clean as c
from sessile.operators.joins import insert_absent, upsert
from sessile.sources.work import materialised

#: Decisions that the tables are rebuilt by.
EXCLUDE, REPLACE, CORRECT, RETAIN = "exclude", "replace", "correct", "retain"


class DecisionError(ValueError):
    """Decisions that do not allow a rebuild."""


def check_decisions(sources: DataFrame, decisions: DataFrame) -> None:
    """Each source has one decision, and it is a known one; decisions on other sources are none."""
    problems = {
        "repeated": decisions.groupBy("source_id").count().filter("count > 1"),
        "unknown_decision": decisions.filter(~F.coalesce(F.col("decision").isin(EXCLUDE, REPLACE, CORRECT, RETAIN), F.lit(False))),
        "undecided": sources.select("source_id").distinct().join(decisions, "source_id", "left_anti"),
        "no_such_source": decisions.join(sources.select("source_id").distinct(), "source_id", "left_anti"),
    }
    for name, rows in problems.items():
        found = [r.source_id for r in rows.select("source_id").limit(5).collect()]
        if found:
            raise DecisionError(f"{name}: {found}")


def recurate(facts: DataFrame, sources: DataFrame, decisions: DataFrame, replacements: DataFrame, corrections: DataFrame, few: bool = True) -> dict[str, DataFrame]:
    """[Q15 J9 J13 P27] measurements, excluded, sources and manifest after the decisions.

    facts, replacements: measurement_id, source_id, key, value, censored. Rows of excluded
    sources go to `excluded` with their decision; those of replaced sources too, and the
    source's replacements come in, unless they have no value: censored ones stay as
    `censored`, others are excluded. Corrections (measurement_id, value) change values of
    sources that are to be corrected. sources keep their columns and get status and rows;
    the manifest counts retained and excluded rows. few: the decisions were counted and may be broadcast.
    """
    check_decisions(sources, decisions)
    d = F.broadcast(decisions) if few else decisions
    columns = ["measurement_id", "source_id", "key", "value", "censored"]
    old = facts.select(*columns).join(d, "source_id").withColumn("origin", F.lit("original"))
    new = replacements.select(*columns).join(d, "source_id").filter(F.col("decision") == REPLACE).withColumn("origin", F.lit("replacement"))
    fixed = old.join(corrections.select("measurement_id", F.col("value").alias("_v"), F.lit(True).alias("_hit")), "measurement_id", "left")
    correct = (F.col("decision") == CORRECT) & F.coalesce("_hit", F.lit(False))
    old = fixed.withColumn("value", F.when(correct, F.col("_v")).otherwise(F.col("value"))).withColumn("origin", F.when(correct, "corrected").otherwise(F.col("origin"))).drop("_v", "_hit")
    bare = F.col("value").isNull()
    state = F.when(F.col("decision") == EXCLUDE, "excluded_by_decision").when((F.col("decision") == REPLACE) & (F.col("origin") == "original"), "superseded").when(bare & ~F.coalesce("censored", F.lit(False)), "no_value").when(bare, "censored").otherwise("active")
    every = old.unionByName(new).withColumn("state", state)
    gone = F.col("state").isin("excluded_by_decision", "superseded", "no_value")
    counts = every.groupBy("source_id").agg(F.count_if(~gone).alias("retained"), F.count_if(gone).alias("excluded"))
    told = sources.join(d, "source_id").join(counts, "source_id", "left").na.fill(0, ["retained", "excluded"])
    status = F.when(F.col("decision") == EXCLUDE, "removed").when(F.col("retained") == 0, "empty").otherwise("active")
    return {
        "measurements": every.filter(~gone).select(*columns, "origin", "state"),
        "excluded": every.filter(gone).select(*columns, "origin", F.col("state").alias("reason")),
        "sources": told.filter(F.col("decision") != EXCLUDE).select(*sources.columns, status.alias("status"), F.col("retained").alias("rows")),
        "manifest": told.select("source_id", "decision", "retained", "excluded"),
    }


def merge_external(star: dict[str, DataFrame], staged: DataFrame, split: str) -> dict[str, DataFrame]:
    """[Q16 J14 J15] The star with staged rows as frozen external ones: surfaces and liquids upserted, facts inserted where absent, splits and flags appended.

    star: measurements (measurement_id, key, surface_id, liquid_id, source_id, value), surfaces
    (surface_id, family), liquids (liquid_id, liquid_name), splits (measurement_id, split) and flags (measurement_id, training, tuning,
    evaluation, frozen). staged: the same columns as measurements, with family and liquid_name.
    """
    facts = star["measurements"]
    fresh = materialised(insert_absent(facts, staged.select(*facts.columns), ["key", "liquid_id"], [F.col("measurement_id")]), "fresh")  # facts, splits and flags take them
    surfaces = staged.groupBy("surface_id").agg(F.max("family").alias("family"))
    liquids = staged.groupBy("liquid_id").agg(F.max("liquid_name").alias("liquid_name"))
    split_col: Column = F.lit(split)
    allowed = c.permissions(split_col)
    return {
        "measurements": facts.unionByName(fresh.select(*facts.columns)),
        "surfaces": upsert(star["surfaces"], surfaces, ["surface_id"]),
        "liquids": upsert(star["liquids"], liquids, ["liquid_id"]),
        "splits": star["splits"].unionByName(fresh.select("measurement_id", split_col.alias("split"))),
        "flags": star["flags"].unionByName(fresh.select("measurement_id", *[allowed[k].alias(k) for k in ("training", "tuning", "evaluation")], F.lit("yes").alias("frozen"))),
    }
