"""Work-of-adhesion models: from surface and liquid components to a contact angle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS = ("owens_wendt", "harmonic_mean", "weighted_geometric", "van_oss")


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def polar_ratio(d: Column, p: Column) -> Column:
    return F.when(d + p > 0, p / (d + p)).otherwise(0.0)


def raw_cosine(model: str, solid_d: Column, solid_p: Column, liquid: Column, liquid_d: Column, liquid_p: Column) -> Column:
    """[P35] The cosine that a model gives, before it is clipped."""
    if model == "owens_wendt":
        return 2 * (_root(solid_d * liquid_d) + _root(solid_p * liquid_p)) / liquid - 1
    if model == "harmonic_mean":
        part = lambda a, b: F.when(a + b > 0, 4 * a * b / (a + b)).otherwise(0.0)
        return (part(solid_d, liquid_d) + part(solid_p, liquid_p)) / liquid - 1
    if model == "weighted_geometric":
        w = F.least(F.greatest((polar_ratio(solid_d, solid_p) + polar_ratio(liquid_d, liquid_p)) / 2, F.lit(0.4)), F.lit(0.6))
        d, p = _root(solid_d * liquid_d), _root(solid_p * liquid_p)
        return 2 * (0.9 * (d + p) + 0.1 * 2 * ((1 - w) * d + w * p)) / liquid - 1
    if model == "van_oss":
        # Acid and base parts default to half of the polar one.
        half_s, half_l = solid_p / 2, liquid_p / 2
        return 2 * (_root(solid_d * liquid_d) + _root(half_s * half_l) + _root(half_s * half_l)) / liquid - 1
    raise ValueError(f"unknown model {model!r}")


def clipped(cosine: Column) -> Column:
    return F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))


def was_clipped(cosine: Column) -> Column:
    return F.abs(cosine - clipped(cosine)) > 1e-12


def angle(cosine: Column) -> Column:
    """Degrees of a clipped cosine."""
    return F.degrees(F.acos(clipped(cosine)))
