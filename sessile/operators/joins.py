"""Joins and merges with declared cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A key that must be unique, or complete, is not."""


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False, complete: bool = False) -> DataFrame:
    """[J1 J7 J8] Join whose right side (and left side, if one to one) has each key once, and, if complete, every left key."""
    for side, name in ((right, "right"), *(((left, "left"),) if one_to_one else ())):
        if side.groupBy(*on).count().filter("count > 1").limit(1).count():
            raise CardinalityError(f"the {name} side repeats a key of {list(on)}")
    if complete and left.join(right, list(on), "left_anti").limit(1).count():
        raise CardinalityError(f"the right side lacks a key of {list(on)}")
    return left.join(right, list(on), how)


def first_rows(frame: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """[A2] The first row of each group by an explicit order."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_filled(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """[A1] For each group and column the first value that is not blank; empty if there is none."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return frame.groupBy(*keys).agg(*[F.coalesce(F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(order))), F.lit("")).alias(c) for c in columns])


def insert_absent(existing: DataFrame, staged: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """[J14] Staged rows whose key the table lacks; of one key in the batch the first by order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return staged.join(existing.select(*keys).distinct(), list(keys), "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, staged: DataFrame, keys: Sequence[str], keep_known: bool = True) -> DataFrame:
    """[J15] Staged rows replace those of their key; with keep_known their nulls do not erase known values."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_batch", F.lit(0)).unionByName(staged.withColumn("_batch", F.lit(1)))
    if keep_known:
        return both.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_batch"))).alias(c) for c in rest])
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
