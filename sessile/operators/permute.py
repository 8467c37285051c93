"""Permutation importance: over a whole cohort by keyed permutations of row numbers, and within sources by draws."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions.clean import draw
from sessile.operators.folds import numbered
from sessile.sources.work import materialised

ROUNDS = 4
#: Rows that a task permutes at once, and rows of a source beyond which it is sorted by Spark instead.
BLOCK, LARGE = 1 << 15, 1 << 20


def half_bits(n: int) -> int:
    """Bits of each half of a number below the next power of four."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permuted(at: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """A permutation of 0..n-1 for keys of ROUNDS numbers below 2**32: a Feistel network over the next power of
    four, walked until it comes back below n."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    out = at.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in keys:
            turn = ((right * 40503 + key) % 1048583 * 30011 % 16777259) >> 3
            left, right = right, left ^ (turn & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out


def importance(rows: DataFrame, order: str, features: Sequence[str], weights: Sequence[float], predicted: str, observed: str, keys: Sequence[tuple[str, int, Sequence[int]]], bounds: tuple[float, float] = (0.0, 180.0)) -> DataFrame:
    """[E18] (feature, repeat, increase) of the mean absolute error when a feature's values are dealt anew among all rows.

    predicted: a linear prediction before its bounds, in which each feature has its weight. keys:
    (feature, repeat, numbers of its permutation). Each row is told its partner by its
    number, so a repeat takes one join by number and no sort.
    """
    place = numbered(rows.select(F.lit(0).alias("_all"), order, *features, F.col(predicted).alias("_p"), F.col(observed).alias("_y")), "_all", [F.col(order)]).drop("_all")
    n = place.count()
    slope = dict(zip(features, weights, strict=True))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, p, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "_p", "_y"))
            for feature, repeat, numbers in keys:
                own = batch.column(feature).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([feature] * len(at), pa.string()), pa.array(np.full(len(at), repeat, np.int32)), pa.array(permuted(at, n, numbers)), pa.array(p - slope[feature] * own), pa.array(y)], ["feature", "repeat", "partner", "rest", "observed"])

    asked = place.mapInArrow(ask, "feature string, repeat int, partner long, rest double, observed double")
    values = place.select(F.col("place").alias("partner"), *features).unpivot(["partner"], list(features), "feature", "value")
    slopes = F.create_map(*[F.lit(x) for f in features for x in (f, float(slope[f]))])
    inside = lambda x: F.greatest(F.least(x, F.lit(bounds[1])), F.lit(bounds[0]))
    base = place.agg(F.avg(F.abs(F.col("_y") - inside(F.col("_p")))).alias("base")).first()["base"] or 0.0
    moved = asked.join(values, ["feature", "partner"]).withColumn("error", F.abs(F.col("observed") - inside(F.col("rest") + F.element_at(slopes, F.col("feature")) * F.col("value"))))
    return moved.groupBy("feature", "repeat").agg(F.count("*").alias("n"), F.round(F.avg("error") - base, 6).alias("increase"), F.round(F.sum("value"), 4).alias("dealt"))


def _dealt(source: np.ndarray, ids: list[str], values: Sequence[np.ndarray], error: np.ndarray, features: Sequence[str], weights: Sequence[float], repeats: int) -> list[tuple[str, int, int, float]]:
    """(feature, repeat, n, sum of absolute errors) of whole sources' rows, sorted by source and id: each row takes the value before it in the order of its draw within its source."""
    starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
    ends = np.r_[starts[1:], len(source)]
    group = np.repeat(np.arange(len(starts), dtype=np.int64) << 32, ends - starts)
    out = [("", 0, len(source), float(np.abs(error).sum()))]
    for feature, weight, x in zip(features, weights, values, strict=True):
        for repeat in range(1, repeats + 1):
            head = f"{feature}|{repeat}|"
            digests = b"".join([hashlib.md5((head + i).encode(), usedforsecurity=False).digest()[:4] for i in ids])
            at = np.argsort(group | np.frombuffer(digests, ">u4"), kind="stable")
            before = np.roll(at, 1)
            before[starts] = at[ends - 1]
            out.append((feature, repeat, len(source), float(np.abs(error[at] - weight * (x[before] - x[at])).sum())))
    return out


def _sums(repeats: int, features: Sequence[str], weights: Sequence[float]):
    kinds = pa.schema([("feature", pa.string()), ("repeat", pa.int32()), ("n", pa.int64()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(table: pa.Table) -> pa.RecordBatch:
            column = lambda c: table.column(c).to_numpy()
            rows = _dealt(column("_source"), table.column("_id").cast(pa.string()).to_pylist(), [column(f).astype(float) for f in features], column("_error"), features, weights, repeats)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                source = table.column("_source").to_numpy()
                last = int(np.searchsorted(source, source[-1]))  # the last source may go on
                held = table.slice(last).to_batches()
                if last:
                    yield told(table.slice(0, last))
        if held and sum(b.num_rows for b in held):
            yield told(pa.Table.from_batches(held))

    return run, "feature string, repeat int, n long, total double"


def within_sources(rows: DataFrame, source: str, order: str, error: str, features: Sequence[str], weights: Sequence[float], repeats: int) -> DataFrame:
    """[E18] (feature, repeat, increase) of the mean absolute error of a linear model when a feature's values move along the order of a draw within each source.

    error: observed less predicted. A row's draw is that of feature, repeat and its number in `order`; it takes the
    value of the row before it, the first that of the last. Rows travel once, to their source, and are dealt there
    for all features and repeats; Spark sorts those of sources with over LARGE rows.
    """
    rows = materialised(rows.select(F.col(source).alias("_source"), F.col(order).alias("_id"), F.col(error).alias("_error"), *features), "permuted")
    large = [r["_source"] for r in rows.groupBy("_source").count().filter(F.col("count") > LARGE).collect()]
    is_large = F.col("_source").isin(large) if large else F.lit(False)
    run, kinds = _sums(repeats, features, weights)
    parts = rows.filter(~is_large).repartition("_source").sortWithinPartitions("_source", "_id").mapInArrow(run, kinds)
    if large:
        slope = F.create_map(*[F.lit(x) for f, w in zip(features, weights, strict=True) for x in (f, float(w))])
        big = rows.filter(is_large)
        each = big.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).unpivot(["_source", "_id", "_error", "repeat"], list(features), "feature", "_x")
        group = Window.partitionBy("_source", "feature", "repeat")
        turn = [draw("feature", "repeat", "_id"), F.col("_id")]
        moved = each.withColumns({"_v": F.lag("_x").over(group.orderBy(*turn)), "_end": F.first("_x").over(group.orderBy(*[c.desc() for c in turn]))})
        moved = moved.withColumn("_v", F.coalesce("_v", "_end"))
        changed = F.abs(F.col("_error") - F.element_at(slope, F.col("feature")) * (F.col("_v") - F.col("_x")))
        parts = parts.unionByName(moved.groupBy("feature", "repeat").agg(F.count("*").alias("n"), F.sum(changed).alias("total"))).unionByName(big.agg(F.lit("").alias("feature"), F.lit(0).alias("repeat"), F.count("*").alias("n"), F.sum(F.abs("_error")).alias("total")))
    means = materialised(parts.groupBy("feature", "repeat").agg((F.sum("total") / F.sum("n")).alias("mae")), "importance")
    base = means.filter("feature = ''").select(F.col("mae").alias("base"))
    return means.filter("feature <> ''").crossJoin(F.broadcast(base)).select("feature", "repeat", F.round(F.col("mae") - F.col("base"), 6).alias("increase"))
