"""Features: lags, rolling means, trends, static bus features, the 41-column matrix, and row sampling.

All lag and rolling columns of a cube share one window specification, by bus and stretch of steps in order of step, so
there is one exchange and one sort whatever their number. A stretch has the rows of the longest lag before it as a
run-up, so a bus with a long history is the work of many tasks. The cube must be dense (windows.check_dense).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import WindowSpec as WindowSpecification
from pyspark.sql import functions as F

from ..contract import Task, WindowSpec
from ..errors import IntegrityError
from ..schemas import FEATURES, MEANS, NET_P, NET_Q, ORIGIN_LAGS, STATIC, TARGET_LAGS
from . import checks

NET = {"p": NET_P, "q": NET_Q}
#: Steps of a stretch; its run-up of 672 steps adds 8 percent of rows.
STRETCH = 8192


def by_bus(*more: str) -> WindowSpecification:
    return Window.partitionBy(*more, "bus", "stretch").orderBy("step")


def stretched(rows: DataFrame, run_up: int, length: int | None = None) -> DataFrame:
    """The rows with their `stretch` of steps, and `home` true; the `run_up` steps before a stretch are in it too, home false."""
    length = max(run_up, length or STRETCH)
    own, ahead = F.floor(F.col("step") / length), F.pmod(F.col("step"), F.lit(length)) >= length - run_up
    rows = rows.withColumn("_own", own).withColumn("stretch", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))))
    return rows.withColumn("home", F.col("stretch") == F.col("_own")).drop("_own")


def at_home(rows: DataFrame) -> DataFrame:
    return rows.where("home").drop("stretch", "home")


def audit_causality(task: Task) -> None:
    """The target-aligned daily lag must be known at the origin."""
    least = min(TARGET_LAGS.values())
    if task.lead_steps < 1 or task.lead_steps + task.horizon_steps - 1 > least:
        raise IntegrityError(f"lead {task.lead_steps} and horizon {task.horizon_steps} reach beyond the lag of {least} steps")


def lagged(value: str | Column, k: int) -> Column:
    """The value k steps before, NULL before the first."""
    return F.lag(value, k).over(by_bus())


def prefix(value: str) -> Column:
    """Sum up to and with this step within the stretch and its run-up, in double precision."""
    return F.sum(F.col(value).cast("double")).over(by_bus().rowsBetween(Window.unboundedPreceding, 0))


def rolling_mean(sums: str, k: int) -> Column:
    """Mean of the last k values with this one, from a column of prefix sums; NULL until there are k.

    The difference of two prefix sums costs the same for every k, where a sliding frame costs k a row.
    """
    return F.when(F.col("step") >= k - 1, (F.col(sums) - F.coalesce(F.lag(sums, k).over(by_bus()), F.lit(0.0))) / k)


def origin_frame(cube: DataFrame, *, kind: str = "float") -> DataFrame:
    """(step, bus, origin values, lags, rolling means, trend) of every step as an origin."""
    own = cube.select("step", "bus", *[F.col(c).alias(f"origin_{x}") for x, c in NET.items()])
    own = stretched(own, max(*ORIGIN_LAGS.values(), *MEANS.values()))
    own = own.withColumns({f"_sum_{x}": prefix(f"origin_{x}") for x in NET})
    own = own.withColumns(
        {f"lag_{name}_{x}": lagged(f"origin_{x}", k) for name, k in ORIGIN_LAGS.items() for x in NET} | {f"mean_{name}_{x}": rolling_mean(f"_sum_{x}", k).cast(kind) for name, k in MEANS.items() for x in NET}
    )
    return at_home(own).withColumns({f"trend_4h_{x}": (F.col(f"origin_{x}") - F.col(f"mean_4h_{x}")).cast(kind) for x in NET}).drop(*[f"_sum_{x}" for x in NET])


def target_frame(cube: DataFrame) -> DataFrame:
    """(step, bus, target_lag_*): values 24 hours and 7 days before each step as a target."""
    own = stretched(cube.select("step", "bus", *NET.values()), max(TARGET_LAGS.values()))
    lags = {f"target_lag_{name}_{x}": lagged(c, k) for name, k in TARGET_LAGS.items() for x, c in NET.items()}
    return at_home(own.withColumns(lags)).select("step", "bus", *lags)


def counts_by_bus(elements: DataFrame, buses: DataFrame, name: str) -> DataFrame:
    """(bus, name): number of elements, 0 where there are none; an unknown bus is an error."""
    checks.none_of(elements.join(buses.select("bus"), "bus", "left_anti"), f"{name}: elements at unknown buses")
    return buses.select("bus").join(elements.groupBy("bus").agg(F.count("*").alias(name)), "bus", "left").select("bus", F.coalesce(name, F.lit(0)).alias(name))


def abs_sum_by_bus(elements: DataFrame, buses: DataFrame, column: str, name: str) -> DataFrame:
    """(bus, name): sum of absolute values, 0 where there are no elements; an unknown bus is an error."""
    checks.none_of(elements.join(buses.select("bus"), "bus", "left_anti"), f"{name}: elements at unknown buses")
    return buses.select("bus").join(elements.groupBy("bus").agg(F.sum(F.abs(column)).alias(name)), "bus", "left").select("bus", F.coalesce(name, F.lit(0).cast("double")).alias(name))


def degree(edges: DataFrame, buses: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
    """(bus, name): ends of edges at each bus; a loop counts twice; ends at unknown buses are ignored."""
    at = edges.select(F.explode(F.array(*ends)).alias("bus")).groupBy("bus").agg(F.count("*").alias(name))
    return buses.select("bus").join(at, "bus", "left").select("bus", F.coalesce(name, F.lit(0)).alias(name))


def static_features(tables: dict[str, DataFrame], *, kind: str = "float") -> DataFrame:
    """(bus, bus_pos, nine static features). bus_pos is the bus's place in the order of the bus table."""
    buses = tables["bus"].select(F.col("element_id").alias("bus"), "vn_kv")
    parts = [
        buses,
        degree(tables["line"], buses, ("from_bus", "to_bus"), "line_degree"),
        degree(tables["trafo"], buses, ("hv_bus", "lv_bus"), "trafo_degree"),
        *[counts_by_bus(tables[x], buses, f"n_{x}") for x in ("load", "sgen", "storage")],
        *[abs_sum_by_bus(tables[x], buses, "p_mw", n) for x, n in (("load", "installed_load_p_mw"), ("sgen", "installed_sgen_p_mw"), ("storage", "installed_storage_abs_p_mw"))],
    ]
    out = reduce(lambda a, b: a.join(b, "bus"), parts)
    # one row for each bus: the order of buses is a small dimension, ranked on one task
    place = F.row_number().over(Window.orderBy("bus")) - 1
    out = out.select("bus", place.cast("long").alias("bus_pos"), *[F.col(x).cast(kind).alias(x) for x in STATIC])
    checks.finite(out, list(STATIC), "static bus features")
    return out


def matrix(cube: DataFrame, sample: DataFrame, static: DataFrame, calendar: DataFrame, *, kind: str = "float") -> DataFrame:
    """The 41 features of each row of a sample: (row_id, window_index, bus_pos, horizon_pos, origin, target_step).

    The sample is joined to the origin frame on (bus, origin) and to the target frame on (bus, target); both frames
    come from one exchange of the cube by bus. Unavailable values are NULL; infinities are refused. Rows are kept as
    often as they were drawn.
    """
    named = sample.join(static.select("bus", "bus_pos", *STATIC), "bus_pos")
    at = origin_frame(cube, kind=kind).withColumnRenamed("step", "origin")
    to = target_frame(cube).withColumnRenamed("step", "target_step")
    rows = named.join(at, ["bus", "origin"]).join(to, ["bus", "target_step"]).join(calendar.withColumnRenamed("step", "target_step"), "target_step")
    rows = rows.withColumn("horizon_step", F.col("horizon_pos") + 1)
    return rows.select("row_id", "bus", "origin", "target_step", *[F.col(x).cast(kind).alias(x) for x in FEATURES])


def check_matrix(rows: DataFrame, expected: int | None = None) -> int:
    """No infinities, as many rows as were asked for; NULL is allowed."""
    checks.ordered_columns(rows, FEATURES, "feature matrix")
    bad = reduce(lambda a, b: a | b, [F.abs(F.col(x)) == float("inf") for x in FEATURES])
    n = checks.require(rows, {"infinite": bad, "target not after origin": F.col("target_step") <= F.col("origin")}, "feature matrix")
    if not n or expected is not None and n != expected:
        raise IntegrityError(f"the feature matrix has {n} rows; {expected} were sampled")
    return n


def target_vector(rows: DataFrame, cube: DataFrame, channel: str) -> DataFrame:
    """The rows with y, the channel's finite value at their target step."""
    out = rows.join(cube.select("bus", F.col("step").alias("target_step"), F.col(channel).cast("double").alias("y")), ["bus", "target_step"], "left")
    checks.finite(out, ["y"], f"targets of {channel}")
    return out


def decode(flat: Column, n_buses: int, horizon: int) -> list[Column]:
    """Window, bus and horizon places of a flat number; windows are slowest, horizons fastest."""
    horizon_pos = F.pmod(flat, F.lit(horizon)).cast("long")
    pair = ((flat - horizon_pos) / horizon).cast("long")
    bus_pos = F.pmod(pair, F.lit(n_buses)).cast("long")
    return [((pair - bus_pos) / n_buses).cast("long").alias("window_index"), bus_pos.alias("bus_pos"), horizon_pos.alias("horizon_pos")]


def exhaustive_rows(spark: SparkSession, n_windows: int, n_buses: int, horizon: int) -> DataFrame:
    """(row_id, window_index, bus_pos, horizon_pos): every combination, generated, not joined."""
    if min(n_windows, n_buses, horizon) < 1:
        raise IntegrityError("windows, buses and horizon must be at least 1")
    return spark.range(n_windows * n_buses * horizon).select(F.col("id").alias("row_id"), *decode(F.col("id"), n_buses, horizon))


def sample_rows(spark: SparkSession, n_windows: int, n_buses: int, horizon: int, *, max_rows: int, seed: int) -> DataFrame:
    """All combinations if there are at most max_rows, else max_rows drawn with replacement by numpy's generator.

    The draws are those of numpy, so they are made on the driver; their number is max_rows, a parameter, whatever the
    data's size.
    """
    total = n_windows * n_buses * horizon
    if max_rows < 1 or seed < 0:
        raise IntegrityError("max_rows must be at least 1 and the seed not negative")
    if total <= max_rows:
        return exhaustive_rows(spark, n_windows, n_buses, horizon)
    drawn = np.random.default_rng(seed).integers(0, total, size=max_rows, dtype=np.int64)
    rows = spark.createDataFrame(list(enumerate(drawn.tolist())), "row_id long, flat long")
    return rows.select("row_id", *decode(F.col("flat"), n_buses, horizon))


def with_windows(sample: DataFrame, first_origin: int, spec: WindowSpec) -> DataFrame:
    """Origin and target step of each sampled row; a split's windows begin at its first origin, a stride apart."""
    origin = F.lit(first_origin) + F.col("window_index") * spec.stride
    return sample.withColumn("origin", origin).withColumn("target_step", origin + spec.lead + F.col("horizon_pos"))
