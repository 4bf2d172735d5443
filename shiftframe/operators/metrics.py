"""Forecast metrics: scalar ones, four aggregation levels, intervals and quantiles; all as partial and final sums."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..schemas import ACTIVITY_EPSILON
from . import checks

#: Columns of a level's rows.
LEVEL = ("level", "bus", "horizon", "mae", "rmse", "wape", "points", "active_buses")


def ratio(n: Column, d: Column, epsilon: float = ACTIVITY_EPSILON) -> Column:
    """n / d, NULL where d is at most epsilon."""
    return F.when(d > epsilon, n / d)


def error_sums(weight: Column | None = None) -> dict[str, Column]:
    """Mergeable sums over rows (y, yhat): absolute error, squared error, absolute target, count."""
    w = F.lit(1) if weight is None else weight
    y, e = F.col("y").cast("double"), F.col("y").cast("double") - F.col("yhat").cast("double")
    return {"abs_e": F.sum(F.abs(e) * w), "sq_e": F.sum(e * e * w), "abs_y": F.sum(F.abs(y) * w), "n": F.sum(w)}


def named(sums: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in sums.items()]


def finals(epsilon: float = ACTIVITY_EPSILON) -> dict[str, Column]:
    return {"mae": F.col("abs_e") / F.col("n"), "rmse": F.sqrt(F.col("sq_e") / F.col("n")), "wape": ratio(F.col("abs_e"), F.col("abs_y"), epsilon)}


def bus_micro(rows: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    return rows.groupBy(*group).agg(*named(error_sums(weight))).select(*group, *named(finals()), F.col("n").cast("long").alias("points"))


def bus_macro(rows: DataFrame, active: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """Each active bus's metrics, then their plain mean; undefined WAPEs are skipped."""
    own = [x for x in group if x in active.columns]  # such as the channel
    per_bus = rows.groupBy(*group, "bus").agg(*named(error_sums(weight))).join(active.where("active").select(*own, "bus"), [*own, "bus"])
    per_bus = per_bus.select(*group, "bus", *named(finals()), "n")
    return per_bus.groupBy(*group).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("wape").alias("wape"), F.sum("n").cast("long").alias("points"), F.count("*").alias("active_buses"))


def system(rows: DataFrame, group: list[str], at: list[str], weight: Column | None = None) -> DataFrame:
    """Errors of the sums over all buses; `at` names one forecast instant, whose rows have one weight."""
    w = F.first(weight).alias("w") if weight is not None else F.lit(1).alias("w")
    total = rows.groupBy(*group, *at).agg(F.sum(F.col("y").cast("double")).alias("y"), F.sum(F.col("yhat").cast("double")).alias("yhat"), w)
    return bus_micro(total, group, F.col("w"))


def horizon_step(rows: DataFrame, group: list[str]) -> DataFrame:
    return bus_micro(rows, [*group, "horizon"])


def horizon_arrays(rows: DataFrame, group: list[str]) -> DataFrame:
    """Metrics as arrays in order of horizon."""
    each = F.sort_array(F.collect_list(F.struct("horizon", "mae", "rmse", "wape")))
    out = horizon_step(rows, group).groupBy(*group).agg(each.alias("x"))
    return out.select(*group, *[F.col(f"x.{k}").alias(k) for k in ("mae", "rmse", "wape")])


def levels(rows: DataFrame, by_step: DataFrame, active: DataFrame, group: list[str]) -> DataFrame:
    """All four levels as one table. rows carry a weight w and, where it matters, the horizon; by_step is the last level."""
    if not active.where("active").take(1):
        raise IntegrityError("there is no active bus")
    w = F.col("w")
    null = {"bus": F.lit(None).cast("long"), "horizon": F.lit(None).cast("int"), "active_buses": F.lit(None).cast("long")}
    parts = {"bus_micro": bus_micro(rows, group, w), "bus_macro_active": bus_macro(rows, active, group, w), "system_aggregate": system(rows, group, ["step", "horizon"], w), "horizon_step": by_step}
    out = [x.withColumns({k: v for k, v in null.items() if k not in x.columns}).select(F.lit(name).alias("level"), *group, *LEVEL[1:]) for name, x in parts.items()]
    return reduce(DataFrame.unionByName, out)


def grouping_sets(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sums for all rows, each bus and each horizon, in one scan and one shuffle: GROUPING SETS by way of an expand."""
    cols = [F.col(x) for x in [*group, "bus", "horizon"]]
    sets = [[F.col(x) for x in group], [F.col(x) for x in [*group, "bus"]], [F.col(x) for x in [*group, "horizon"]]]
    out = rows.groupingSets(sets, *cols).agg(*named(error_sums()), F.grouping_id().alias("gid"))
    k = F.when(F.col("gid") == 3, "bus_micro").when(F.col("gid") == 1, "bus").otherwise("horizon_step")
    return out.select(k.alias("level"), *group, "bus", "horizon", *named(finals()), F.col("n").cast("long").alias("points"))


# --- scalar metrics over a table; each takes the names of its columns and returns one row


def _raise_for(found: dict[str, int]) -> None:
    if not found.pop("_rows"):
        raise ValueError("there are no rows")
    broken = [k for k, v in found.items() if v]
    if broken:
        raise ValueError(", ".join(broken))


def _rules(columns: list[str], rules: dict[str, Column] | None) -> dict[str, Column]:
    return {f"{x} is not finite": checks.not_finite(F.col(x)) for x in columns} | (rules or {})


def _checked(df: DataFrame, columns: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """df, after a pass for the rules."""
    _raise_for(checks.count_rules(df, _rules(columns, rules)))
    return df


def measured(df: DataFrame, columns: list[str], values: dict[str, Column], rules: dict[str, Column] | None = None) -> DataFrame:
    """One row of aggregates, from the same pass that counts the rows which break a rule; a broken rule raises."""
    broken = [F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in _rules(columns, rules).items()]
    row = df.agg(F.count("*").alias("_rows"), *broken, *[v.cast("double").alias(f"_{k}") for k, v in values.items()]).first().asDict()
    result = tuple(row.pop(f"_{k}") for k in values)
    _raise_for(row)
    return df.sparkSession.createDataFrame([result], ", ".join(f"{k} double" for k in values))


def _in_unit(x: float, name: str) -> None:
    if not 0 < x < 1:
        raise ValueError(f"{name} must lie in (0, 1)")


def mae_value(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(yhat)))


def rmse_value(y: str = "y", yhat: str = "yhat") -> Column:
    e = F.col(y) - F.col(yhat)
    return F.sqrt(F.avg(e * e))


def pinball_value(q: float, y: str = "y", yhat: str = "yhat") -> Column:
    _in_unit(q, "the quantile")
    return F.avg(pinball(F.col(y), F.col(yhat), q))


def mae(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return measured(df, [y, yhat], {"mae": mae_value(y, yhat)})


def rmse(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return measured(df, [y, yhat], {"rmse": rmse_value(y, yhat)})


def pinball(y: Column, pred: Column, q: float) -> Column:
    e = y - pred
    return F.greatest(e * q, e * (q - 1))


def pinball_loss(df: DataFrame, q: float, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return measured(df, [y, yhat], {"pinball": pinball_value(q, y, yhat)})


def covered(y: Column, lower: Column, upper: Column) -> Column:
    """1 inside the interval, ends included."""
    return F.when((y >= lower) & (y <= upper), 1.0).otherwise(0.0)


def interval_coverage(df: DataFrame, y: str = "y", lower: str = "lo", upper: str = "hi") -> DataFrame:
    return measured(df, [y, lower, upper], {"coverage": F.avg(covered(F.col(y), F.col(lower), F.col(upper)))}, {"lower above upper": F.col(lower) > F.col(upper)})


def mean_interval_width(df: DataFrame, lower: str = "lo", upper: str = "hi") -> DataFrame:
    return measured(df, [lower, upper], {"width": F.avg(F.col(upper) - F.col(lower))}, {"lower above upper": F.col(lower) > F.col(upper)})


def winkler(y: Column, lower: Column, upper: Column, alpha: float) -> Column:
    out = F.when(y < lower, lower - y).when(y > upper, y - upper).otherwise(0.0)
    return (upper - lower) + out * (2.0 / alpha)


def interval_score(df: DataFrame, alpha: float, y: str = "y", lower: str = "lo", upper: str = "hi") -> DataFrame:
    _in_unit(alpha, "alpha")
    return measured(df, [y, lower, upper], {"score": F.avg(winkler(F.col(y), F.col(lower), F.col(upper), alpha))}, {"lower above upper": F.col(lower) > F.col(upper)})


def regret(cost: Column, oracle: Column) -> Column:
    return F.greatest(F.lit(0.0), cost - oracle)


def decision_regret(df: DataFrame, cost: str = "cost", oracle: str = "oracle", tolerance: float = 1e-9) -> DataFrame:
    """The rows with their regret; a cost below the oracle's by more than the tolerance is an error."""
    own = _checked(df, [cost, oracle], {"cost below the oracle's": F.col(cost) - F.col(oracle) < -tolerance})
    return own.withColumn("regret", regret(F.col(cost), F.col(oracle)))


def violation_rate(df: DataFrame, lower: float, upper: float, value: str = "value") -> DataFrame:
    if not lower <= upper:
        raise ValueError("lower above upper")
    v = F.col(value)
    return measured(df, [value], {"violation_rate": F.avg(F.when((v < lower) | (v > upper), 1.0).otherwise(0.0))})


# --- probabilistic metrics over wide quantile columns


def label(q: float) -> str:
    """q05 for 0.05: the name of a quantile's column."""
    return f"q{round(q * 100):02d}"


def probabilistic(df: DataFrame, quantiles: tuple[float, ...], interval: tuple[float, float], group: list[str], y: str = "y") -> DataFrame:
    """One pass over the quantile columns: pinball of each and their mean, coverage, width, coverage error, crossings.

    Crossing quantiles are counted, never put right; a width may be negative for that reason.
    """
    q = list(quantiles)
    if q != sorted(set(q)) or not q or any(not 0 < x < 1 for x in q):
        raise ValueError("quantiles must ascend without repeats within (0, 1)")
    if any(x not in q for x in interval):
        raise ValueError("the interval's ends are not among the quantiles")
    lo, hi = (F.col(label(x)) for x in interval)
    t = F.col(y)
    crossed = reduce(lambda a, b: a + b, [F.when(F.col(label(a)) > F.col(label(b)), 1.0).otherwise(0.0) for a, b in zip(q, q[1:], strict=False)], F.lit(0.0))
    out = df.groupBy(*group).agg(
        *[F.avg(pinball(t, F.col(label(x)), x)).alias(f"pinball_{label(x)}") for x in q], F.avg(covered(t, lo, hi)).alias("coverage"), F.avg(hi - lo).alias("width"),
        (F.sum(crossed) / (F.count("*") * max(1, len(q) - 1))).alias("crossing_rate"), F.count("*").alias("points"),
    )
    mean = reduce(lambda a, b: a + b, [F.col(f"pinball_{label(x)}") for x in q]) / len(q)
    return out.withColumn("mean_pinball", mean).withColumn("abs_coverage_error", F.abs(F.col("coverage") - (interval[1] - interval[0])))


def best_naive_skill(scores: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, best, best_mae): the baseline of least MAE; on ties the first of `order`."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("baseline"))
    return scores.groupBy(*group).agg(F.min(F.struct(F.col("mae"), place.alias("place"), F.col("baseline"))).alias("x")).select(*group, F.col("x.baseline").alias("best"), F.col("x.mae").alias("best_mae"))


def skill(mae_: Column, best: Column) -> Column:
    """1 - mae / best, NULL where the best is not positive."""
    return F.when(best > 0, 1 - mae_ / best)


def text(value: float | None, digits: int = 6) -> str:
    """A metric in a report; NA where it is undefined."""
    return "NA" if value is None or math.isnan(value) else f"{value:.{digits}f}"
