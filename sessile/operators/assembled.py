"""Feature rows from training sources only, with a guard that tests what went into them.

Every aggregate carries a mask: a bit for each fold of the rows that it has taken. Masks
of what an aggregate is made from are joined by or, up to the feature row. A row whose
own fold has its bit in its mask has seen itself, or rows of its sources: a leak.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folds are numbered from 0; a mask is a long.
MOST_FOLDS = 62


def bit(fold: Column | str) -> Column:
    """2 ** fold as a long."""
    return F.expr(f"shiftleft(1L, {fold})") if isinstance(fold, str) else F.call_function("shiftleft", F.lit(1).cast("long"), fold)


def cells(frame: DataFrame, keys: Sequence[str], fold: str, value: str) -> DataFrame:
    """(keys, cells): for each key its folds' number, sum, sum of squares and mask, a few entries whatever the rows."""
    v = F.col(value).cast("double")
    each = frame.filter(v.isNotNull()).groupBy(*keys, fold).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.bit_or(bit(fold)).alias("mask"))
    entry = F.collect_list(F.struct(F.col(fold).alias("fold"), "n", "s", "q", "mask")).alias("cells")
    return each.groupBy(*keys).agg(entry) if keys else each.agg(entry)


def by_fold(entries: DataFrame, folds: int, without: Column) -> DataFrame:
    """cells as (keys, fold, figures): figures of all folds but one, made once for each key and fold and not for each row.

    without: the fold to leave out, by the columns of entries and `fold`.
    """
    each = entries.crossJoin(entries.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")))
    return each.withColumn("figures", over(F.col("cells"), without)).drop("cells")


def over(entries: Column, without: Column) -> Column:
    """Struct n, mean, spread and mask over the entries of all folds but one (of all folds where that is null)."""
    rest = F.filter(entries, lambda c: F.coalesce(c["fold"] != without, F.lit(True)))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("mask"))
    add = lambda a, c: F.struct((a["n"] + c["n"]).alias("n"), (a["s"] + c["s"]).alias("s"), (a["q"] + c["q"]).alias("q"), a["mask"].bitwiseOR(c["mask"]).alias("mask"))
    mean = lambda t: F.when(t["n"] > 0, t["s"] / t["n"]).otherwise(0.0)
    finish = lambda t: F.struct(t["n"].alias("n"), mean(t).alias("mean"), F.sqrt(F.greatest(F.when(t["n"] > 0, t["q"] / t["n"]).otherwise(0.0) - mean(t) * mean(t), F.lit(0.0))).alias("spread"), t["mask"].alias("mask"))
    return F.aggregate(F.coalesce(rest, F.array().cast("array<struct<fold:int,n:bigint,s:double,q:double,mask:bigint>>")), zero, add, finish)


def scaled(value: Column, figures: Column) -> Column:
    """[M1] The value by its training mean and spread; 0 where it is missing or nothing was learned."""
    return F.when(figures["n"] > 0, F.coalesce((value - figures["mean"]) / F.greatest(figures["spread"], F.lit(1e-8)), F.lit(0.0))).otherwise(0.0)


def probe_summary(frame: DataFrame, surface: Sequence[str], liquid: str, angle: str, most: int) -> DataFrame:
    """[A23] (surface, liquid, probes, has_probes, mean, spread, least, largest, probe_liquids): what other liquids told of a surface.

    Angles are shares of 180. Liquids of a surface are few; more probe liquids than
    `most` stop the query, as a row of features has no more places.
    """
    a = F.col(angle) / 180
    each = frame.groupBy(*surface, liquid).agg(F.count("*").alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("q"), F.min(a).alias("low"), F.max(a).alias("high"))
    every = each.groupBy(*surface).agg(F.array_sort(F.collect_list(F.struct(F.col(liquid).alias("liquid"), "n", "s", "q", "low", "high"))).alias("of"))
    row = every.select(*surface, "of", F.explode("of.liquid").alias(liquid))
    rest = F.filter("of", lambda c: c["liquid"] != F.col(liquid))
    row = row.withColumn("rest", F.when(F.size(rest) <= most, rest).otherwise(F.raise_error(F.concat(F.lit(f"more than {most} probe liquids on a surface: "), F.size(rest).cast("string")))))
    total = lambda f: F.aggregate(F.transform("rest", lambda c: c[f].cast("double")), F.lit(0.0), lambda x, y: x + y)
    n, any_ = total("n"), F.size("rest") > 0
    mean = F.when(any_, total("s") / n).otherwise(0.0)
    return row.select(*surface, liquid, n.alias("probes"), any_.cast("double").alias("has_probes"), mean.alias("mean"), F.when(any_, F.sqrt(F.greatest(total("q") / n - mean * mean, F.lit(0.0)))).otherwise(0.0).alias("spread"),
        F.when(any_, F.array_min(F.transform("rest", lambda c: c["low"]))).otherwise(0.0).alias("least"), F.when(any_, F.array_max(F.transform("rest", lambda c: c["high"]))).otherwise(0.0).alias("largest"), F.transform("rest", lambda c: c["liquid"]).alias("probe_liquids"))


def guard(masks: Sequence[Column], fold: Column, target: Column, probes: Column) -> Column:
    """[M4] `fold_leak` if what a row was made from has rows of its own fold, `target_leak` if its target is among its probes, else `disjoint`."""
    whole = F.lit(0).cast("long")
    for m in masks:
        whole = whole.bitwiseOR(F.coalesce(m, F.lit(0).cast("long")))
    return F.when(whole.bitwiseAND(bit(fold)) != 0, "fold_leak").when(F.array_contains(probes, target), "target_leak").otherwise("disjoint")
