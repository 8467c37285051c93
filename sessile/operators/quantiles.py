"""Exact order statistics of any distribution, by radix selection on the digits of doubles.

A double's sign and exponent are its first digit, its 52 bits of fraction the other
three. Each level counts rows by one digit, with partial aggregation, and goes on with
the rows of the digits that hold a wanted rank. No window has more rows than a digit has
values, whatever the number of rows, their scale, or their ties. Rows are counted by
value once, before all levels, so what is read again has a row for each distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessile.sources.work import materialised

#: Bits of the fraction's digits, the first one first.
BITS = (16, 18, 18)
_DIGITS = ("_d0", "_d1", "_d2", "_d3")
#: Added to exponents, so that the first digit of the least positive double is 1.
_SHIFT = 1075


def digits(value: Column) -> list[Column]:
    """Four longs that sort, one after the other, as the doubles do. Zeros of both signs are equal; infinities are the ends."""
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")
    low = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(a >= 2 * low, 1).when(a < low, -1).otherwise(0)
    fraction = ((a / F.pow(F.lit(2.0), exponent) - 1) * float(2**52)).cast("long")
    sign, plain = F.signum(v).cast("long"), (a > 0) & (a < float("inf"))
    out, rest = [F.when(v == 0, 0).when(plain, exponent + _SHIFT).otherwise(_SHIFT + 1024)], 52
    for bits in BITS:
        rest -= bits
        out.append(F.when(plain, F.shiftright(fraction, rest).bitwiseAND(2**bits - 1)).otherwise(0))
    return [sign * c.cast("long") for c in out]


def value_of(parts: Sequence[Column]) -> Column:
    """The double that has these digits."""
    fraction, rest = F.lit(0.0), 0
    for bits in BITS:
        rest += bits
    for part, bits in zip(parts[1:], BITS, strict=True):
        rest -= bits
        fraction = fraction + F.abs(part).cast("double") * float(2**rest)
    exponent = (F.abs(parts[0]) - _SHIFT).cast("int")
    size = F.when(exponent == 1024, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), exponent) * (1 + fraction / float(2**52)))
    return F.when(parts[0] == 0, 0.0).otherwise(F.signum(parts[0].cast("double")) * size)


def _counted(frame: DataFrame, own: Mapping[str, Column], value: Column, weight: Column) -> DataFrame:
    """(own keys, digits, _w): how often each value is there; nulls and NaNs are left out."""
    v = value.cast("double")
    rows = frame.select(*[c.alias(k) for k, c in own.items()], v.alias("_v"), weight.cast("long").alias("_w")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    counts = materialised(rows.groupBy(*own, "_v").agg(F.sum("_w").alias("_w")), "values")
    return counts.select(*own, "_w", *[d.alias(n) for n, d in zip(_DIGITS, digits(F.col("_v")), strict=True)])


def order_values(frame: DataFrame, keys: Sequence[str], value: Column, ranks: Mapping[str, Callable[[Column], Column]], weight: Column | None = None) -> DataFrame:
    """(keys, n, a column for each name): the value at a rank from 1, given as a function of the group's size.

    Nulls and NaNs are left out; a group without values has no row, and a rank outside
    1..n gives null. Null keys are a group. Without keys there is one row, or none.
    A weight is the number of times, 1 at least, that its row counts.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = _counted(frame, {o: F.col(k) for k, o in zip(keys, own, strict=True)}, value, F.lit(1) if weight is None else weight)

    def same(left: DataFrame, right: DataFrame, at: Sequence[str]) -> Column:
        # Digits are never null; keys may be.
        return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) if c in own else left[c] == right[c] for c in at], F.lit(True))

    wanted = None
    for level, digit in enumerate(_DIGITS):
        before = [*own, *_DIGITS[:level]]
        if wanted is None:
            here = rows
        else:
            some = wanted.select(*before).distinct()
            here = rows.join(some, same(rows, some, before), "left_semi")
        counts = here.groupBy(*before, digit).agg(F.sum("_w").alias("_c"))
        group = Window.partitionBy(*before)
        counts = counts.withColumn("_upto", F.sum("_c").over(group.orderBy(digit)))
        if wanted is None:
            sizes = counts.withColumn("_n", F.sum("_c").over(group))
            asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).cast("long").alias("_rank")) for name, rank in ranks.items()]))
            placed = sizes.select(*before, digit, "_c", "_upto", "_n", asked.alias("_a")).select("*", "_a._name", "_a._rank")
        else:
            left = wanted.select(*[F.col(c).alias(f"{c}_w") for c in before], "_n", "_name", "_rank")
            match = reduce(lambda x, y: x & y, [counts[c].eqNullSafe(left[f"{c}_w"]) if c in own else counts[c] == left[f"{c}_w"] for c in before], F.lit(True))
            placed = counts.join(left, match)
        inside = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
        wanted = placed.filter(inside).select(*before, digit, "_n", "_name", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"))
    found = wanted.withColumn("_v", value_of([F.col(d) for d in _DIGITS]))
    wide = found.groupBy(*own, "_n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return wide.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("_n").alias("n"), *ranks)


def whole_values(frame: DataFrame, value: Column, ranks: Mapping[str, Callable[[int], int]]) -> tuple[int, dict[str, float | None]]:
    """The number of values of a whole frame and those at given ranks, now: a job a level, whose wanted digits are constants in the next.

    For figures that later steps need as numbers. What a level brings to the driver is
    one row for each rank.
    """
    rows = _counted(frame, {}, value, F.lit(1))
    n, left = 0, {}
    at: dict[str, tuple[int, ...]] = {}
    for level, digit in enumerate(_DIGITS):
        before = list(_DIGITS[:level])
        if level:
            some = sorted(set(at.values()))
            if not some:
                break
            here = rows.filter(reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(c) == d for c, d in zip(before, digits_, strict=True)]) for digits_ in some]))
        else:
            here = rows
        counts = here.groupBy(*before, digit).agg(F.sum("_w").alias("_c")).withColumn("_upto", F.sum("_c").over(Window.partitionBy(*before).orderBy(digit)))
        if not level:
            counts = counts.cache()
            n = counts.agg(F.max("_upto")).first()[0] or 0
            left = {name: int(rank(n)) for name, rank in ranks.items() if n and 1 <= int(rank(n)) <= n}
            at = dict.fromkeys(left, ())
        asked = [(name, *at[name], rank) for name, rank in left.items()]
        found = {}
        for name, *prefix, rank in asked:
            mine = reduce(lambda x, y: x & y, [F.col(c) == d for c, d in zip(before, prefix, strict=True)], F.lit(True))
            found[name] = F.max(F.when(mine & (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.struct(digit, (F.col("_upto") - F.col("_c")).alias("_before")))).alias(name)
        row = counts.agg(*found.values()).first() if found else None
        for name in left:
            at[name], left[name] = (*at[name], row[name][0]), left[name] - row[name][1]
        if not level:
            counts.unpersist()
    values = frame.sparkSession.range(1).select(*[value_of([F.lit(d) for d in parts]).alias(name) for name, parts in at.items()]).first() if at else {}
    return n, {name: values[name] if name in at else None for name in ranks}


def whole_quantiles(frame: DataFrame, value: Column, shares: Mapping[str, float]) -> dict[str, float | None]:
    """quantiles of a whole frame as numbers; null if it has no values."""
    ranks: dict[str, Callable[[int], int]] = {}
    for name, share in shares.items():
        ranks[f"low_{name}"] = lambda n, s=share: math.floor((n - 1) * s) + 1
        ranks[f"high_{name}"] = lambda n, s=share: math.ceil((n - 1) * s) + 1
    n, found = whole_values(frame, value, ranks)
    out: dict[str, float | None] = {}
    for name, share in shares.items():
        low, high, part = found[f"low_{name}"], found[f"high_{name}"], (n - 1) * share - math.floor((n - 1) * share)
        out[name] = low if low == high else low * (1 - part) + high * part
    return out


def quantiles(frame: DataFrame, keys: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """(keys, n, a column for each name): quantiles between the two nearest ranks, as SQL's continuous percentiles."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, share in shares.items():
        ranks[f"_low_{name}"] = lambda n, s=share: F.floor((n - 1) * s) + 1
        ranks[f"_high_{name}"] = lambda n, s=share: F.ceil((n - 1) * s) + 1
    found = order_values(frame, keys, value, ranks)

    def between(name: str, share: float) -> Column:
        low, high, place = F.col(f"_low_{name}"), F.col(f"_high_{name}"), (F.col("n") - 1) * share
        part = place - F.floor(place)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return found.select(*keys, "n", *[between(name, share).alias(name) for name, share in shares.items()])
