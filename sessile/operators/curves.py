"""Learning curves over many subsets of sources without passing the rows for each subset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessile.functions.clean import draw
from sessile.functions.draws import Draws
from sessile.sources.work import materialised

LEAST, MOST = 0.0, 180.0
#: Sources of one group of the sums, and subsets that are drawn together.
BLOCK, TOGETHER = 256, 64


def drawn_subsets(sources: DataFrame, source: str, sizes: Sequence[int], draws: int) -> DataFrame:
    """(size, subset, source): for each size so many draws of that many sources; a draw that an earlier one equals is left out."""
    spark = sources.sparkSession
    every = sources.select(source).crossJoin(F.broadcast(spark.createDataFrame([(int(k),) for k in sizes], "size int"))).crossJoin(F.broadcast(spark.range(1, draws + 1).select(F.col("id").cast("int").alias("subset"))))
    place = F.row_number().over(Window.partitionBy("size", "subset").orderBy(draw("size", "subset", source), source))
    chosen = every.withColumn("_place", place).filter(F.col("_place") <= F.col("size")).drop("_place")
    name = chosen.groupBy("size", "subset").agg(F.md5(F.array_join(F.array_sort(F.collect_list(source)).cast("array<string>"), "|")).alias("_name"))
    first = name.groupBy("size", "_name").agg(F.min("subset").alias("subset")).select("size", "subset")
    return chosen.join(first, ["size", "subset"], "left_semi")


def _breaks(data: DataFrame, values: np.ndarray) -> DataFrame:
    """(source, at, a, b): sums of the rows' breaks by source and by the interval between two of the rising values."""

    def breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "p"))
            names = batch.column("source").dictionary_encode()
            who = np.tile(names.indices.to_numpy(zero_copy_only=False), 3).astype(np.int64)
            at = np.concatenate([LEAST - p, y - p, MOST - p])
            turn = np.repeat([-1.0, 2.0, -1.0], len(y))
            code, where = np.unique(who * (len(values) + 1) + np.searchsorted(values, at), return_inverse=True)
            sums = [np.bincount(where, w, len(code)) for w in (turn, turn * at)]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code // (len(values) + 1))), pa.array((code % (len(values) + 1)).astype(np.int32)), *map(pa.array, sums)], ["source", "at", "a", "b"])

    kind = data.schema["source"].dataType.simpleString()
    return materialised(data.mapInArrow(breaks, f"source {kind}, at int, a double, b double").groupBy("source", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "curve-breaks")


def learning_curve(rows: DataFrame, source: str, observed: str, predicted: str, subsets: DataFrame) -> DataFrame:
    """[E5 A13] (size, subset, test_sources, test_rows, mae): the mean residual of a subset's rows corrects the rows of all other sources.

    The absolute error of a row, as a function of the shift that is added to its
    prediction (kept within the bounds), is a broken line: flat until the prediction
    leaves the lower bound, falling to its residual, rising to the upper bound, flat.
    So the sum over rows at any shift comes from sums over the breaks below it. Breaks
    are summed by source and by the interval between two subsets' shifts; a subset
    takes the totals, less its own sources. It costs rows plus sources x subsets.
    Observed values are within the bounds; rows with a null are left out.
    """
    data = rows.select(F.col(source).alias("source"), F.col(observed).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).na.drop()
    own = materialised(data.groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") - F.col("p")).alias("r")), "curve-sources")
    chosen = materialised(subsets.withColumnRenamed(source, "source").join(own, "source"), "curve-subsets")
    shifts = chosen.groupBy("size", "subset").agg((F.sum("r") / F.sum("n")).alias("shift"), F.sum("n").alias("train_rows"), F.count("*").alias("train_sources"), F.sum("y").alias("train_y"))
    ordered = sorted((tuple(r) for r in shifts.collect()), key=lambda r: (r[2], r[0], r[1]))  # one row a subset, as many as sizes x draws
    values = np.array([r[2] for r in ordered])
    asked = data.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(ordered)], "size int, subset int, shift double, train_rows long, train_sources long, train_y double, at int")

    parts = _breaks(data, values)
    whole = own.agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("k")).first()
    upto = F.sum("a"), F.sum("b")
    # Totals have one row an interval; as-of sums of a source come from one window over its breaks and its subsets.
    total = parts.groupBy("at").agg(*[s.alias(c) for s, c in zip(upto, "ab", strict=True)]).unionByName(asked.select("at", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    running = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = total.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("at", F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))
    wanted = chosen.join(F.broadcast(asked.select("size", "subset", "at", "shift")), ["size", "subset"]).select("source", "at", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "size", "subset", "shift", "y")
    both = wanted.unionByName(parts, allowMissingColumns=True)
    running = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = both.select("size", "subset", "shift", "y", F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b")).filter("size IS NOT NULL")
    mine = mine.groupBy("size", "subset").agg(F.sum(F.col("y") + F.col("shift") * F.col("a") - F.col("b")).alias("own"))
    out = asked.join(total, "at").join(mine, ["size", "subset"])
    error = (F.lit(whole["y"]) + F.col("shift") * F.col("a") - F.col("b") - F.col("own")) / (whole["n"] - F.col("train_rows"))
    return out.filter(F.col("train_rows") < whole["n"]).select("size", "subset", (whole["k"] - F.col("train_sources")).alias("test_sources"), (whole["n"] - F.col("train_rows")).alias("test_rows"), F.round(error, 6).alias("mae"))


def drawn_curve(rows: DataFrame, source: str, observed: str, predicted: str, draws: int) -> DataFrame:
    """[E5 A13] learning_curve of drawn_subsets of every size from one to all sources but one, for many sources.

    There are sources x draws subsets with up to all sources each. Members never travel
    as rows: all draws of a size are made in one place, from the sources' sums, and leave
    a bit for each source. A group of some sources then meets its own bits of all subsets.
    """
    data = rows.select(F.col(source).alias("source"), F.col(observed).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).na.drop()
    spark = data.sparkSession
    own = materialised(data.groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") - F.col("p")).alias("r")), "curve-sources")
    whole = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("y").alias("y"), F.count("*").alias("k")).first()
    listed = own.orderBy("source").select(F.col("source").cast("string").alias("name"), "n", "y", "r").toArrow()  # four values a source, not its rows
    sent = spark.sparkContext.broadcast(([x.encode() for x in listed.column("name").to_pylist()], *[listed.column(c).to_numpy() for c in ("n", "y", "r")]))
    sizes = max(1, TOGETHER // draws)  # draws of one size stay together, so that equal ones are seen
    groups = spark.range(0, -(-max(whole["k"] - 1, 0) // sizes), 1, 8 * spark.sparkContext.defaultParallelism).withColumnRenamed("id", "group")
    last = whole["k"] - 1

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, y, r = sent.value
        keys = Draws(names)
        for batch in batches:
            for group in batch.column("group").to_pylist():
                out = []
                for size in range(group * sizes + 1, min((group + 1) * sizes, last) + 1):
                    seen = set()
                    for at in range(0, draws, TOGETHER):
                        subsets = range(at + 1, min(at + TOGETHER, draws) + 1)
                        for subset, number in zip(subsets, keys.numbers([b"%d|%d|" % (size, k) for k in subsets]), strict=True):
                            # Sources are in order, so of equal draws at the end the first ones are taken.
                            end = np.partition(number, size - 1)[size - 1]
                            member = number < end
                            member[np.flatnonzero(number == end)[: size - np.count_nonzero(member)]] = True
                            bits = np.packbits(member, bitorder="little").tobytes()
                            if bits not in seen:
                                seen.add(bits)
                                where = np.flatnonzero(member)
                                rows = int(n[where].sum())
                                out.append((size, subset, float(r[where].sum() / rows), rows, float(y[where].sum()), bits))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["size", "subset", "shift", "train_rows", "train_y", "bits"])

    chosen = materialised(groups.mapInArrow(drawn, "size int, subset int, shift double, train_rows long, train_y double, bits binary"), "curve-drawn")
    ordered = chosen.select("size", "subset", "shift", "train_rows", "train_y").toArrow().sort_by([(c, "ascending") for c in ("shift", "size", "subset")])  # one row a subset
    values = ordered.column("shift").to_numpy()
    asked = spark.createDataFrame(ordered.append_column("at", pa.array(np.arange(len(values), dtype=np.int32))))
    parts = _breaks(data, values)
    total = parts.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).unionByName(asked.select("at", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))).groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    running = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row a subset
    total = total.select("at", F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                ats = batch.column("at").to_numpy().astype(np.int32).tobytes()
                cut = [np.ascontiguousarray(every[:, k : k + BLOCK // 8]).tobytes() for k in range(0, every.shape[1], BLOCK // 8)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array([ats] * len(cut)), pa.array(cut)], ["block", "ats", "bits"])

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(values))
        if len(b):
            order = np.concatenate([np.frombuffer(x, np.int32) for x in a["ats"]])
            member = np.concatenate([np.frombuffer(x, np.uint8).reshape(len(t) // 4, -1) for x, t in zip(a["bits"], a["ats"], strict=True)])
            member = np.ascontiguousarray(member[np.argsort(order)].T)  # each subset is in one tile: by rising shift, a row for eight sources
            for place, mine in b.groupby("place"):
                in_it = (member[place % BLOCK // 8] & np.uint8(1 << place % 8)).astype(bool)
                here = mine["at"].to_numpy() < len(values)
                s, t = (np.cumsum(np.bincount(mine["at"].to_numpy()[here], mine[c].to_numpy()[here], len(values))) for c in ("a", "b"))
                out += np.where(in_it, values * s - t, 0.0)
        return pd.DataFrame({"at": np.arange(len(values), dtype=np.int32), "own": out})

    tiles = chosen.select("size", "subset", "bits").join(F.broadcast(asked.select("size", "subset", "at")), ["size", "subset"]).select("at", "bits").mapInArrow(blocks, "block long, ats binary, bits binary")
    places = own.agg(F.array_sort(F.collect_list("source")).alias("e")).select(F.posexplode("e").alias("place", "source"))
    placed = parts.join(places, "source").select((F.floor(F.col("place") / BLOCK)).alias("block"), "place", "at", "a", "b")
    mine = tiles.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(sums, "at int, own double").groupBy("at").agg(F.sum("own").alias("own"))
    error = (F.lit(whole["y"]) - F.col("train_y") + F.col("shift") * F.col("a") - F.col("b") - F.col("own")) / (whole["n"] - F.col("train_rows"))
    out = asked.join(total, "at").join(mine, "at")
    return out.select("size", "subset", (F.lit(whole["k"]) - F.col("size")).alias("test_sources"), (whole["n"] - F.col("train_rows")).alias("test_rows"), F.round(error, 6).alias("mae"))
