"""Grouped two-parameter fits of surface components from probe liquids.

A fit needs only sums over its probes. They are kept for each (surface, split,
liquid), so leaving the target's liquid out is a sum over the other liquids of a
surface, of which there are few, and never a pass over pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessile.functions.physics import angle, raw_cosine

KEYS = ["surface_group_id", "v4_split"]
SUMS = ("n", "s11", "s12", "s22", "s1y", "s2y", "syy")


def partials(measurements: DataFrame) -> DataFrame:
    """[A14] Sums of the design by (surface, split, liquid) over eligible measurements, and the spread of directions."""
    x1, x2 = F.sqrt("gd"), F.sqrt("gp")
    y = F.col("gamma") * (1 + F.cos(F.radians("angle"))) / 2
    rows = measurements.filter((F.col("target_eligible") == "yes") & F.col("angle").isNotNull() & (F.col("gamma") > 0) & (F.col("gd") >= 0) & (F.col("gp") >= 0))
    return rows.select(*KEYS, "liquid_id", x1.alias("x1"), x2.alias("x2"), y.alias("y")).groupBy(*KEYS, "liquid_id").agg(
        F.count("*").alias("n"), F.sum(F.col("x1") * F.col("x1")).alias("s11"), F.sum(F.col("x1") * F.col("x2")).alias("s12"), F.sum(F.col("x2") * F.col("x2")).alias("s22"),
        F.sum(F.col("x1") * F.col("y")).alias("s1y"), F.sum(F.col("x2") * F.col("y")).alias("s2y"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.min(F.atan2("x2", "x1")).alias("low"), F.max(F.atan2("x2", "x1")).alias("high"),
    )


def masked(measurements: DataFrame) -> DataFrame:
    """[J2 A14] For each (surface, split, target liquid) the sums over its other liquids; zero rows where there are none."""
    parts = partials(measurements)
    targets = measurements.filter(F.col("surface_group_id").isNotNull() & F.col("v4_split").isNotNull()).select(*KEYS, F.col("liquid_id").alias("target_liquid_id")).distinct()
    found = targets.join(parts, KEYS, "left").withColumn("is_other", F.coalesce(F.col("liquid_id") != F.col("target_liquid_id"), F.lit(False)))
    other = lambda c: F.when(F.col("is_other"), F.col(c))
    return found.groupBy(*KEYS, "target_liquid_id").agg(
        *[F.coalesce(F.sum(other(c)), F.lit(0)).alias(c) for c in SUMS], F.count(other("liquid_id")).alias("liquids"), F.min(other("low")).alias("low"), F.max(other("high")).alias("high")
    )


def solve(sums: DataFrame) -> DataFrame:
    """[A14] Non-negative least squares: status, d, p, residual norm. The interior solution if both are 0 or more,
    else the better of the two edges."""
    c = F.col
    det = c("s11") * c("s22") - c("s12") * c("s12")
    status0 = F.when((c("n") < 2) | (c("liquids") < 2), "insufficient_probes").when(c("high") - c("low") <= 1e-12, "singular_fit")
    out = sums.withColumn("u1", F.when(status0.isNull(), (c("s1y") * c("s22") - c("s2y") * c("s12")) / det)).withColumn("u2", F.when(status0.isNull(), (c("s2y") * c("s11") - c("s1y") * c("s12")) / det))
    e1 = F.when(c("s11") > 0, c("s1y") / c("s11")).otherwise(0.0)
    e2 = F.when(c("s22") > 0, c("s2y") / c("s22")).otherwise(0.0)
    gain1, gain2 = e1 * c("s1y"), e2 * c("s2y")
    inside = (c("u1") >= 0) & (c("u2") >= 0)
    b1 = F.when(c("u1").isNull(), None).when(inside, c("u1")).when(gain1 >= gain2, e1).otherwise(0.0)
    b2 = F.when(c("u1").isNull(), None).when(inside, c("u2")).when(gain1 >= gain2, 0.0).otherwise(e2)
    out = out.withColumn("b1", b1).withColumn("b2", b2)
    status = F.coalesce(status0, F.when((c("b1") <= 1e-10) | (c("b2") <= 1e-10), "boundary_fit").otherwise("interior_fit"))
    norm = F.sqrt(F.greatest(F.lit(0.0), c("syy") - 2 * (c("b1") * c("s1y") + c("b2") * c("s2y")) + c("b1") * c("b1") * c("s11") + 2 * c("b1") * c("b2") * c("s12") + c("b2") * c("b2") * c("s22")))
    return out.select(
        *KEYS, "target_liquid_id", c("n").cast("long").alias("n_probes"), c("liquids").alias("n_liquids"), status.alias("fit_status"), (c("b1") * c("b1")).alias("d"), (c("b2") * c("b2")).alias("p"),
        norm.alias("residual_norm"), c("u1"), c("u2"),
    )


def free_fit(fits: DataFrame) -> DataFrame:
    """[A15] The unconstrained solution: components as squares, and whether a coefficient is negative (beyond rounding)."""
    return fits.select(*KEYS, "target_liquid_id", "fit_status", (F.col("u1") * F.col("u1")).alias("free_d"), (F.col("u2") * F.col("u2")).alias("free_p"), F.when((F.col("u1") < -1e-9) | (F.col("u2") < -1e-9), "yes").otherwise("no").alias("negative"))


def forward(fits: DataFrame, liquids: DataFrame) -> DataFrame:
    """[A14 P35] The target liquid's cosine on the fitted surface, clipped, and its angle."""
    cosine = raw_cosine("owens_wendt", F.col("d"), F.col("p"), F.col("gamma"), F.col("gd"), F.col("gp"))
    known = fits.join(F.broadcast(liquids), F.col("target_liquid_id") == F.col("liquid_id"))
    return known.withColumn("cosine", F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))).withColumn("fitted_angle", F.when(F.col("d").isNotNull(), angle(cosine)))
