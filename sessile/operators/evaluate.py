"""Evaluation of prediction frames: long form, metrics by groups, shifts, wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions.clean import right_closed_bin

#: The bucket of errors that are 0, before all others.
_ZERO = -(10**6)


def long_form(wide: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """[A11] One row per record and model; models that the frame lacks are skipped."""
    return wide.unpivot(list(ids), [m for m in models if m in wide.columns], "model", "predicted")


def metrics_by(long: DataFrame, keys: Sequence[str], least: int = 1, one_row_r2: bool = False, digits: int = 6, parts: int = 64) -> DataFrame:
    """[A8 A11] metrics.regression of groups with so many rows at least. Null keys are a group.

    The two order statistics are exact without holding a group's errors anywhere:
    rows are counted by bucket of their error (so many to each doubling, whatever
    the scale), and only those in the buckets that hold a wanted rank are counted by value.
    """
    error = F.col("observed") - F.col("predicted")
    rows = long.select(*keys, F.when(error.isNotNull(), F.col("observed")).alias("_o"), error.alias("_e"), F.abs(error).alias("_v"), F.when(error == 0, _ZERO).when(error.isNotNull(), F.floor(F.log2(F.abs(error)) * parts)).alias("_b"))
    sums = {"_n": F.count("_e"), "_a": F.sum("_v"), "_s": F.sum(F.col("_e") * F.col("_e")), "_t": F.sum("_o"), "_q": F.sum(F.col("_o") * F.col("_o"))}
    part = rows.groupBy(*keys, "_b").agg(*[c.alias(k) for k, c in sums.items()], F.min("_o").alias("_low"), F.max("_o").alias("_high"))
    group = Window.partitionBy(*keys)
    part = part.withColumn("_upto", F.sum("_n").over(group.orderBy("_b")))
    for k in sums:
        part = part.withColumn(f"{k}_all", F.sum(k).over(group))
    part = part.withColumn("_low", F.min("_low").over(group)).withColumn("_high", F.max("_high").over(group)).withColumn("_first", F.row_number().over(group.orderBy("_b")) == 1)
    places = {name: (share * (F.col("_n_all") - 1), rank) for name, share, rank in (("l5", 0.5, F.floor), ("h5", 0.5, F.ceil), ("l9", 0.9, F.floor), ("h9", 0.9, F.ceil))}
    inside = lambda name: (places[name][1](places[name][0]) < F.col("_upto")) & (places[name][1](places[name][0]) >= F.col("_upto") - F.col("_n"))
    same = lambda other: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(other + k)) for k in keys], F.lit(True))
    wanted = part.filter(inside("l5") | inside("h5") | inside("l9") | inside("h9"))
    at = wanted.select(*[F.col(k).alias("_w" + k) for k in keys], F.col("_b").alias("_wb"), (F.col("_upto") - F.col("_n")).alias("_before"), "_n_all")
    values = rows.join(at, same("_w") & (F.col("_b") == F.col("_wb"))).groupBy(*keys, "_b", "_before", "_n_all", "_v").agg(F.count("*").alias("_n"))
    values = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    picks = values.groupBy(*[F.col(k).alias("_p" + k) for k in keys]).agg(*[F.max(F.when(inside(name), F.col("_v"))).alias(name) for name in places])
    total = part.filter("_first").drop("_b", "_upto", "_first", *sums)
    both = total.join(picks, same("_p"), "left")
    between = lambda share, low, high: F.col(low) + (share * (F.col("_n_all") - 1) - F.floor(share * (F.col("_n_all") - 1))) * (F.col(high) - F.col(low))
    n, sse = F.col("_n_all"), F.col("_s_all")
    constant = F.lit(None).cast("double") if one_row_r2 else F.when(sse == 0, 1.0).otherwise(0.0)
    r2 = F.when(n < 2, None).when(F.col("_low") == F.col("_high"), constant).otherwise(1 - sse / (F.col("_q_all") - F.col("_t_all") * F.col("_t_all") / n))
    r = lambda c, name: F.round(c, digits).alias(name)
    return both.select(*keys, n.alias("n"), r(F.col("_a_all") / n, "mae"), r(F.sqrt(sse / n), "rmse"), r(r2, "r2"), r(between(0.5, "l5", "h5"), "median_ae"), r(between(0.9, "l9", "h9"), "p90_ae")).filter(F.col("n") >= least)


def strata(long: DataFrame, stratifiers: Sequence[str], keys: Sequence[str], least: int = 2) -> DataFrame:
    """[A12] Metrics by each stratifier's values, one after the other in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratifier"), F.col(s).cast("string").alias("stratum")) for s in stratifiers]))
    spread = long.select("*", pairs.alias("_s")).select("*", "_s.stratifier", "_s.stratum")
    return metrics_by(spread, ["stratifier", "stratum", *keys], least)


def within(long: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """[A10] Share of absolute errors within thresholds."""
    error = F.abs(F.col("observed") - F.col("predicted"))
    shares = long.groupBy(*keys).agg(*[F.round(F.avg((error <= t).cast("double")), 6).alias(f"t{t:g}") for t in thresholds])
    return shares.unpivot(list(keys), [f"t{t:g}" for t in thresholds], "threshold", "share")


def angle_bin(c: Column | str) -> Column:
    return right_closed_bin(c, (-0.1, 60.0, 90.0, 120.0, 180.1), ("low", "middle", "high", "very_high"))


def shift_summary(before: Column, after: Column, tolerance: float = 1e-9) -> list[Column]:
    """[A20] n, changed rows, mean and largest absolute shift."""
    d = F.abs(after - before)
    return [F.count(d).alias("n"), F.count_if(d > tolerance).alias("changed"), F.round(F.avg(d), 6).alias("mean_shift"), F.round(F.max(d), 6).alias("max_shift")]


def wins(group_metrics: DataFrame, group: str, metric: str, models: Sequence[str], reference: str) -> DataFrame:
    """[A21] Share of groups in which a model's metric is below the reference's."""
    wide = group_metrics.groupBy(group).pivot("model", list(models)).agg(F.first(metric))
    others = [m for m in models if m != reference]
    row = wide.agg(*[F.round(F.avg((F.col(m) < F.col(reference)).cast("double")), 6).alias(m) for m in others], F.count("*").alias("groups"))
    return row.unpivot(["groups"], others, "model", "win_fraction")


def histogram(frame: DataFrame, value: Column, bins: int, keys: Sequence[str]) -> DataFrame:
    """[A27] Counts in equal bins between each group's least and largest value; the last bin is closed."""
    x = frame.select(*keys, value.alias("x")).filter("x IS NOT NULL")
    ends = x.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)) + 1, F.lit(bins)))
    return x.join(F.broadcast(ends) if not keys else ends, list(keys)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
