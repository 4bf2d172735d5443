"""Split-conformal radius, interval and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks, metrics, scan


def radius(df: DataFrame, alpha: float = 0.1, group: list[str] | None = None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(group, radius, n): with k = ceil((n + 1)(1 - alpha)), the (k + 1)-th smallest absolute residual, the largest if there
    are not so many. That is one order statistic more than the textbook's, on purpose.

    The order statistic is found by counting (scan.kth), so neither a group nor all rows are the work of one task.
    """
    metrics._in_unit(alpha, "alpha")
    group = group or []
    own = metrics._checked(df, [y, yhat]).select(*group, F.abs(F.col(y) - F.col(yhat)).alias("r"))
    k = F.ceil((F.col("n").cast("double") + 1.0) * F.lit(1.0 - alpha))
    totals = own.groupBy(*group).agg(F.count("*").alias("n")).where("n > 0").withColumn("k", F.least(k + 1, F.col("n")))
    found = scan.kth(own, "r", totals, group)
    totals = totals.drop("k")
    both = found.join(totals, group) if group else found.crossJoin(totals)  # without groups one row each
    return both.select(*group, F.col("r").alias("radius"), "n")


def interval(df: DataFrame, radius_: float | str, yhat: str = "yhat") -> DataFrame:
    """The rows with lo and hi, a radius on either side of the prediction. The radius is a number, or a column's name."""
    if isinstance(radius_, str):
        checks.require(df, {"the radius is not finite": checks.not_finite(F.col(radius_)), "the radius is negative": F.col(radius_) < 0}, "interval")
        radius = F.col(radius_)
    elif not 0 <= radius_ < float("inf"):
        raise ValueError("the radius must be finite and not negative")
    else:
        radius = F.lit(radius_)
    return df.withColumn("lo", F.col(yhat) - radius).withColumn("hi", F.col(yhat) + radius)


def coverage(df: DataFrame, y: str = "y", lower: str = "lo", upper: str = "hi") -> DataFrame:
    return metrics.interval_coverage(df, y, lower, upper)
