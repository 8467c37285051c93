"""Feature rows and models on Spark ML. What is fitted is a table, so it can be stored and joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions.clean import anchored
from sessile.sources import BROADCAST_ROWS
from sessile.sources.work import materialised

MISSING = "<missing>"


def fit_scaler(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """[M1] (column, center, scale) over finite values; a scale is at least 1e-8."""
    long = frame.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value").filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('infinity')")
    return long.groupBy("column").agg(F.avg("value").alias("center"), F.greatest(F.stddev_pop("value"), F.lit(1e-8)).alias("scale"))


def fit_vocabulary(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """[M2] (column, token, code): codes from 2 in token order, the missing token included; 0 is for unknown ones."""
    tokens = frame.select(*[F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(MISSING)).alias(c) for c in columns]).unpivot([], list(columns), "column", "token").distinct()
    every = tokens.unionByName(tokens.select("column").distinct().withColumn("token", F.lit(MISSING))).distinct()
    return every.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("token")) + 1)


def scaled(frame: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """[M1] Each column as its standardised value (0 where missing) and a missing flag."""
    row = scaler.groupBy(F.lit(1).alias("_one")).pivot("column", list(columns)).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))
    out = frame.crossJoin(F.broadcast(row))
    for c in columns:
        out = out.withColumn(f"{c}_z", F.coalesce((F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale"), F.lit(0.0))).withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
    return out.drop("_one", *[f"{c}_{x}" for c in columns for x in ("center", "scale")])


def encoded(frame: DataFrame, vocabulary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """[M2] Each column's code; 0 for tokens that the vocabulary lacks."""
    out = frame
    for c in columns:
        own = vocabulary.filter(F.col("column") == c).select(F.col("token").alias("_t"), F.col("code").alias(f"{c}_code"))
        out = out.withColumn("_k", F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(MISSING))).join(own, F.col("_k") == F.col("_t"), "left").drop("_k", "_t").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0)))
    return out


def ridge(features: Sequence[str], alpha: float, n: int) -> Pipeline:
    """[M6] Ridge of the residual with penalty alpha (sum form)."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), LinearRegression(labelCol="residual", regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False)])


def forest(features: Sequence[str], seed: int = 42, trees: int = 20) -> Pipeline:
    """[M7] Random forest of the residual."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), RandomForestRegressor(labelCol="residual", numTrees=trees, maxDepth=5, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=seed)])


def boosted(features: Sequence[str], seed: int = 42, rounds: int = 8, weight: str | None = None) -> Pipeline:
    """[M8] Boosted trees of the residual, with row weights if given."""
    gbt = GBTRegressor(labelCol="residual", maxIter=rounds, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt.setWeightCol(weight) if weight else gbt])


def fit_and_score(model: Pipeline, train: DataFrame, test: DataFrame, source: str) -> DataFrame:
    """[M9 M13] Predictions physics + residual, within bounds, and whether the sides share no source."""
    shared = train.select(source).distinct().join(test.select(source).distinct(), source, "left_semi").limit(1).count()
    out = model.fit(train).transform(test)
    return out.withColumn("predicted", anchored("physics", "prediction")).withColumn("disjoint", F.lit("no" if shared else "yes"))


def tree_ensembles(train: DataFrame, test: DataFrame, features: Sequence[str], observed: str, physics: str, seeds: Sequence[int], trees: int = 20, rounds: int = 8) -> DataFrame:
    """[M7 M8 M9 A22] test with, for forests and boosted trees and for the residual and the angle itself, m_<model>: the
    mean of seeds within bounds, and s_<model>: the seeds' spread. Residual models are anchored in the physics.

    A prediction depends on the features alone: each distinct vector of test rows is scored once and joined.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    rows = assembler.transform(train.withColumn("_residual", F.col(observed) - F.col(physics))).select("_features", "_residual", F.col(observed).alias("_direct")).persist()
    points, columns = assembler.transform(test.select(*features).distinct()), {}
    try:
        for target in ("residual", "direct"):
            for kind in ("forest", "boosted"):
                columns[f"{kind}_{target}"] = []
                for seed in seeds:
                    name = f"_{kind}_{target}_{seed}"
                    common = {"featuresCol": "_features", "labelCol": f"_{target}", "predictionCol": name, "seed": seed}
                    if kind == "forest":
                        model = RandomForestRegressor(numTrees=trees, maxDepth=5, featureSubsetStrategy="sqrt", minInstancesPerNode=5, **common)
                    else:
                        model = GBTRegressor(maxIter=rounds, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, **common)
                    points = model.fit(rows).transform(points)
                    columns[f"{kind}_{target}"].append(name)
    finally:
        rows.unpersist()
    told = {}
    for model, names in columns.items():
        values = F.array(*[F.col(n) for n in names])
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / len(names)
        squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / len(names)
        told |= {f"_m_{model}": mean, f"s_{model}": F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))}
    scored = materialised(points.select(*features, *[c.alias(k) for k, c in told.items()]), "points")
    out = test.join(F.broadcast(scored) if scored.count() <= BROADCAST_ROWS else scored, list(features))
    means = {f"m_{model}": anchored(physics if model.endswith("residual") else F.lit(0.0), f"_m_{model}") for model in columns}
    return out.withColumns(means).select(*test.columns, *[f"{x}_{model}" for model in columns for x in "ms"])
