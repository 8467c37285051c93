"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sessile.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Rewire each node's neighbours (the larger ones, or the smaller ones and itself) to the least of them all."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, written, and a mark of them: their number and a sum of their hashes, noted while writing."""
    seen = Observation()
    out = stored(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) of longs; a component is named by its least node.

    Rounds end when the edge set repeats, which takes about the logarithm of the
    longest chain. Each round is written to the shared folder.
    """
    now, mark = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        before = mark
        now, mark = _written(_stars(_stars(now, True), False))
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
