"""Aggregate expressions for regression metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regression(observed: str = "observed", predicted: str = "predicted", digits: int = 6, one_row_r2: bool = False, accuracy: int | None = None) -> list[Column]:
    """[A8] n, MAE, RMSE, R2, median and P90 absolute error.

    R2 is null for one row; for a constant target it is 1 if all errors are 0, else 0,
    or null with one_row_r2 (the other flavour). The order statistics hold the distinct
    errors of a group in one place: where groups are large, take evaluate.metrics_by,
    or approximate ones of the given accuracy.
    """
    o, p = F.col(observed), F.col(predicted)
    e = o - p
    n, sse = F.count(e), F.sum(e * e)
    spread = F.count(e) * F.var_pop(F.when(e.isNotNull(), o))
    constant = F.lit(None).cast("double") if one_row_r2 else F.when(sse == 0, 1.0).otherwise(0.0)
    r2 = F.when(n < 2, None).when(F.max(F.when(e.isNotNull(), o)) == F.min(F.when(e.isNotNull(), o)), constant).otherwise(1 - sse / spread)
    r = lambda c, name: F.round(c, digits).alias(name)
    order = lambda share: F.percentile(F.abs(e), F.lit(share)) if accuracy is None else F.percentile_approx(F.abs(e), share, accuracy)
    return [n.alias("n"), r(F.avg(F.abs(e)), "mae"), r(F.sqrt(F.avg(e * e)), "rmse"), r(r2, "r2"), r(order(0.5), "median_ae"), r(order(0.9), "p90_ae")]


def intervals(observed: str = "observed", lower: str = "lower", upper: str = "upper", kept: str = "kept", error: str = "abs_error", digits: int = 6) -> list[Column]:
    """[A9] Coverage and mean width of intervals; share and MAE of the rows that are kept."""
    inside = (F.col(observed) >= F.col(lower)) & (F.col(observed) <= F.col(upper))
    return [
        F.round(F.avg(inside.cast("double")), digits).alias("coverage"),
        F.round(F.avg(F.col(upper) - F.col(lower)), digits).alias("width"),
        F.round(F.avg(F.col(kept).cast("double")), digits).alias("retained"),
        F.round(F.avg(F.when(F.col(kept), F.col(error))), digits).alias("retained_mae"),
    ]


def huber(error: Column, delta: float = 5.0) -> Column:
    """[P38] Half the square within delta, linear beyond."""
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))
