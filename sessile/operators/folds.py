"""Folds, ranks and draws that do not depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions.clean import draw
from sessile.sources.work import materialised

#: Clusters of a bootstrap are broadcast only if they are at most so many, counted: a few numbers each, where a join by shuffles moves every draw.
BROADCAST_CLUSTERS = 1_000_000
#: Draws of a bootstrap that one task makes, and meets with clusters where these are not broadcast: its memory does not grow with the clusters.
TASK_DRAWS = 1 << 22


def numbered(frame: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Rows with place: 0, 1, ... by the order within their group, without a task that sees a whole group.

    Rows are sorted by ranges; the share of a group in each partition is shifted by what lies before it.
    """
    sorted_rows = frame.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = materialised(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    each = placed.groupBy(group, "_part").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = each.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_shift"))
    return placed.join(shifts, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def greedy_runs(sizes: Sequence[tuple[int, int]], fractions: Sequence[float]) -> list[tuple[int, int, int, list[int]]]:
    """(size, start, length, cycle): where the groups of each size go, by their place among them.

    sizes: (size, groups), the largest first. Groups of one size go to bins whose
    shortfalls fall by that size with each, so the order of bins merges arithmetic
    progressions: bins take turns, and further ones join the cycle as the others come
    down to them. A size has at most as many runs as there are bins.
    """
    total = sum(s * n for s, n in sizes)
    short = [Fraction(float(f) * float(total)) for f in fractions]
    out: list[tuple[int, int, int, list[int]]] = []
    for size, n in sizes:
        start = 0
        while start < n:
            order = sorted(range(len(short)), key=lambda b: (-short[b], b))
            first = order[0]
            turn = (short[first] - size, first)  # when the first bin has its next turn
            cycle = [b for b in order if b == first or short[b] > turn[0] or (short[b] == turn[0] and b < first)]
            rest = [b for b in order if b not in cycle]
            if not size or not rest:
                take = n - start
            else:
                cycles = min(max(1, math.floor((short[first] - short[b]) / size) - (1 if (short[first] - short[b]) % size == 0 and b < first else 0)) for b in rest)
                take = min(n - start, cycles * len(cycle))
            out.append((size, start, take, cycle))
            for i, b in enumerate(cycle):
                short[b] -= size * (take // len(cycle) + (i < take % len(cycle)))
            start += take
    return out


def greedy_bins(groups: DataFrame, key: str, size: str, fractions: Sequence[float]) -> DataFrame:
    """[E1 Q3] (key, bin): groups by falling size (then falling key) each go to the bin that is furthest below its share, the first among equals.

    Only distinct sizes are placed one after the other, in the driver: they are few, as
    their sum is at most the number of rows. Groups find their bin by their place within their size.
    """
    rows = groups.select(F.col(key), F.col(size).cast("long").alias("_size"))
    counts = sorted(((r["_size"], r["count"]) for r in rows.groupBy("_size").count().collect()), reverse=True)
    runs = groups.sparkSession.createDataFrame(greedy_runs(counts, fractions), "_size long, start long, length long, cycle array<int>")
    placed = numbered(rows, "_size", [F.col(key).desc()]).join(runs, "_size").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("length")))
    return placed.select(key, F.get("cycle", F.pmod(F.col("place") - F.col("start"), F.size("cycle")).cast("int")).alias("bin"))


def ranked(frame: DataFrame, keys: Sequence[str], value: Column, bucket: Column, ties: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank of each row by value within keys, from 1, without one task for all rows of a key.

    Rows are counted by bucket (a rising function of the value), and ranked within it.
    """
    rows = frame.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n") if keys else counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value, *ties)
    return rows.withColumn("_rn", F.row_number().over(inside)).join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_rn")).drop("_bucket", "_before", "_rn")


def seeded_split(frame: DataFrame, key: str, seed: int, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """[W9] Rows in the order of a seeded draw, cut at the shares of their number."""
    n = frame.count()
    out = ranked(frame.withColumn("_d", draw(F.lit(seed), key)), [], F.col("_d"), F.shiftright("_d", 20), [F.col(key)])
    edge, label = 0.0, F
    for name, share in shares:
        edge += share
        label = label.when(F.col("rank") <= round(edge * n), name)
    return out.withColumn("part", label).drop("_d")


def bootstrap(clusters: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """[E9 E9a] Paired cluster bootstrap of a difference of mean absolute errors.

    clusters has for each cluster: idx (from 0 within keys), n, ea, eb (sums of
    absolute errors). A resample draws as many clusters as there are, by fixed draws;
    sums of the drawn clusters are all it needs.
    """
    clusters = materialised(clusters, "clusters")  # read for sizes, points and draws
    sizes = clusters.groupBy(*keys).agg(F.count("*").alias("c")).collect()  # a row for each group that is compared
    spark = clusters.sparkSession
    # A draw depends on b and j alone and its cluster on the group's size: it is made once, and groups of one size share it.
    each_size = sorted({row["c"] for row in sizes})
    first = {c: sum(each_size[:k]) for k, c in enumerate(each_size)}  # clusters of all sizes have numbers of one range
    most = max(each_size, default=0)
    tasks = max(spark.sparkContext.defaultParallelism, -(-resamples * most // TASK_DRAWS))
    draws = spark.range(0, resamples * most, 1, tasks).select((F.floor(F.col("id") / max(most, 1)) + 1).alias("b"), (F.col("id") % max(most, 1) + 1).alias("j")).withColumn("u", draw(F.lit(seed), "b", "j"))
    listed = spark.createDataFrame([(c, first[c]) for c in each_size], "c long, first long")
    draws = draws.join(F.broadcast(listed), F.col("j") <= F.col("c")).select("b", (F.col("first") + F.col("u") % F.col("c")).alias("_at"))
    kinds = ", ".join(f"`{k}` {clusters.schema[k].dataType.simpleString()}" for k in keys)
    counted = clusters.groupBy(*keys).agg(F.count("*").alias("c")) if not keys else spark.createDataFrame([tuple(row) for row in sizes], f"{kinds}, c long")
    same = reduce(lambda x, y: x & y, [clusters[k].eqNullSafe(counted[k]) for k in keys], F.lit(True))
    numbered_ = clusters.join(F.broadcast(counted), same).join(F.broadcast(listed), "c").select(*[clusters[k] for k in keys], (F.col("first") + F.col("idx")).alias("_at"), "n", "ea", "eb")
    few = sum(row["c"] for row in sizes) <= BROADCAST_CLUSTERS
    # Where clusters are many, each part of them is a table in memory that its draws pass by; draws are not sorted.
    met = draws.join(F.broadcast(numbered_), "_at") if few else draws.repartition(max(tasks, len(each_size)), "_at").join(numbered_.hint("shuffle_hash"), "_at")
    each = met.groupBy(*keys, "b").agg(((F.sum("ea") - F.sum("eb")) / F.sum("n")).alias("d"))
    point = clusters.groupBy(*keys).agg(F.round((F.sum("ea") - F.sum("eb")) / F.sum("n"), 6).alias("point"), F.count("*").alias("clusters"))
    ends = each.groupBy(*keys).agg(F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), F.round(F.avg((F.col("d") < 0).cast("double")), 6).alias("p_better"))
    return point.join(ends, list(keys)) if keys else point.crossJoin(ends)
