"""Calibration: residual baselines, conformal intervals, abstention, novelty distance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessile.operators import neighbours, quantiles


def residual_means(train: DataFrame, group: str, shrink: float) -> tuple[DataFrame, DataFrame]:
    """[E10] The mean residual of all training rows, and each group's, drawn to it by so many rows' weight."""
    overall = train.agg(F.avg("residual").alias("overall"))
    each = train.groupBy(group).agg(F.count("*").alias("n_train"), F.sum("residual").alias("s"))
    return overall, each.crossJoin(F.broadcast(overall)).select(group, "n_train", ((F.col("s") + shrink * F.col("overall")) / (F.col("n_train") + shrink)).alias("group_mean"))


def order_statistic(scores: DataFrame, keys: Sequence[str], level: float, ties: Sequence[Column] = (), weight: Column | None = None) -> DataFrame:
    """[W8] For each key the score of rank min(k + 1, n), k = ceil((n + 1) level): the 'higher' quantile of split conformal.

    How ties are ordered does not matter to the score. A row counts as often as its weight says.
    """
    rank = lambda n: F.least(F.ceil((n + 1) * level) + 1, n)
    return quantiles.order_values(scores, keys, F.col("score"), {"quantile": rank}, weight).select(*keys, "quantile", "n")


def conformal_quantile(scores: DataFrame, level: float) -> float:
    """[W8] order_statistic of a whole frame, as a number."""
    return quantiles.whole_values(scores, F.col("score"), {"q": lambda n: min(math.ceil((n + 1) * level) + 1, n)})[1]["q"]


def nearest_distance(train: DataFrame, queries: DataFrame, nth: int, block: int = 2048) -> DataFrame:
    """[E13] (id, distance) to the n-th nearest training vector, exactly; neighbours.search tells how much it compared."""
    return neighbours.search(train, queries, nth, block).distance


def backend_scores(requests: DataFrame, backend, schema: str) -> DataFrame:
    """[M12] Scores of an injected backend: a function from a pandas frame of requests to one of results."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield backend(f)

    return requests.mapInPandas(run, schema)


def guarded(requests: DataFrame) -> DataFrame:
    """[Q12] Requests (mode, target, probes as structs of liquid and angle) with the reasons that speak against them."""
    reasons = F.concat_ws(
        ";",
        F.when(~F.col("mode").isin("zero_shot", "probe_assisted"), "unknown_mode"),
        F.when((F.col("mode") == "zero_shot") & (F.size("probes") > 0), "probes_in_zero_shot"),
        F.when((F.col("mode") == "probe_assisted") & (F.size("probes") < 2), "too_few_probes"),
        F.when(F.exists("probes", lambda p: p["liquid"] == F.col("target")), "target_among_probes"),
        F.when(F.exists("probes", lambda p: ~F.coalesce(p["angle"].between(0, 180), F.lit(False))), "angle_range"),
    )
    return requests.withColumn("reasons", reasons)
