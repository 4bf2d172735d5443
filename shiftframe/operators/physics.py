"""Grid checks and power-flow aggregates. The solver itself is a plug-in; what comes before and after it is here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..schemas import BALANCE_TOLERANCE, BRANCHES
from . import checks, timeaxis

TAP_COLUMNS = ("tap_pos", "tap_neutral", "tap_min", "tap_max", "tap_step_percent", "tap_step_degree", "tap_side", "tap_changer_type")


def tap_type(step_percent: Column, step_degree: Column, tolerance: float = 1e-9) -> Column:
    """Type of an untyped tap changer: symmetrical if it turns by a right angle, else a ratio changer."""
    return F.when(F.abs(F.abs(F.coalesce(step_degree, F.lit(0.0))) - 90.0) <= tolerance, "Symmetrical").otherwise("Ratio")


def needs_type() -> Column:
    return F.col("tap_pos").isNotNull() & (F.abs(F.col("tap_step_percent")) > 1e-12) & F.col("tap_changer_type").isNull()


def repair_taps(trafo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired table, audit rows). An untyped tap that turns the phase without a step in percent has no safe type."""
    checks.columns_present(trafo, TAP_COLUMNS, "trafo")
    angle_only = F.col("tap_pos").isNotNull() & F.col("tap_changer_type").isNull() & ~(F.abs(F.coalesce("tap_step_percent", F.lit(0.0))) > 1e-12) & (F.abs(F.coalesce("tap_step_degree", F.lit(0.0))) > 1e-12)
    checks.none_of(trafo.where(angle_only).select("element_id"), "untyped tap changers with an angle alone")
    kind = tap_type(F.col("tap_step_percent"), F.col("tap_step_degree"))
    audit = trafo.where(needs_type()).select("element_id", "tap_pos", F.coalesce("tap_neutral", F.lit(0.0)).alias("tap_neutral"), "tap_step_percent", F.coalesce("tap_step_degree", F.lit(0.0)).alias("tap_step_degree"), kind.alias("tap_changer_type"))
    return trafo.withColumn("tap_changer_type", F.when(needs_type(), kind).otherwise(F.col("tap_changer_type"))), audit


def tap_bounds(trafo: DataFrame) -> DataFrame:
    """Taps outside their bounds; a bound that is NULL does not bind."""
    checks.columns_present(trafo, TAP_COLUMNS, "trafo")
    return trafo.where(F.coalesce(F.col("tap_pos") < F.col("tap_min"), F.lit(False)) | F.coalesce(F.col("tap_pos") > F.col("tap_max"), F.lit(False)))


def in_service(bus: DataFrame) -> DataFrame:
    return bus.where(F.coalesce("in_service", F.lit(True))) if "in_service" in bus.columns else bus


def voltage_summary(res_bus: DataFrame, bus: DataFrame) -> DataFrame:
    """Least and greatest voltage of the buses in service."""
    own = res_bus.join(in_service(bus).select("element_id"), "element_id", "left_semi")
    return own.agg(F.min("vm_pu").alias("min_vm_pu"), F.max("vm_pu").alias("max_vm_pu"))


def voltage_delta(raw: DataFrame, repaired: DataFrame) -> DataFrame:
    """Greatest and mean absolute change over the buses of both results."""
    d = F.abs(F.col("b.vm_pu") - F.col("a.vm_pu"))
    return raw.alias("a").join(repaired.alias("b"), "element_id").agg(F.max(d).alias("max_abs_delta"), F.avg(d).alias("mean_abs_delta"), F.count("*").alias("n"))


def require_tap_response(audit: DataFrame, delta: DataFrame, least: float = 1e-8) -> None:
    """A repaired tap off its neutral position must move a voltage."""
    if audit.where(F.col("tap_pos") != F.col("tap_neutral")).take(1) and not (delta.first()["max_abs_delta"] or 0.0) > least:
        raise IntegrityError("tap changers were repaired, but no voltage moved")


def branch_loss(results: dict[str, DataFrame], kind: str = "p") -> DataFrame:
    """(branch, loss): the loss column's sum, or that of the flows into both ends where there is none; 0 for a missing table."""
    unit = {"p": "mw", "q": "mvar"}[kind]
    loss, ends = f"{kind}l_{unit}", {"line": ("from", "to"), "trafo": ("hv", "lv"), "trafo3w": ("hv", "mv", "lv"), "impedance": ("from", "to"), "dcline": ("from", "to")}
    parts = []
    for branch in BRANCHES:
        df = results.get(branch)
        flows = [f"{kind}_{e}_{unit}" for e in ends[branch]]
        if df is None or loss not in df.columns and not set(flows) <= set(df.columns):
            continue
        value = F.col(loss) if loss in df.columns else reduce(lambda a, b: a + b, [F.col(x) for x in flows])
        checks.none_of(df.select(value.alias("loss")).where(checks.not_finite(F.col("loss"))), f"{branch}: losses are not finite")
        parts.append(df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("loss")).select(F.lit(branch).alias("branch"), "loss"))
    if not parts:
        raise IntegrityError("there is no branch result")
    return reduce(DataFrame.unionByName, parts)


def safe_sum(df: DataFrame | None, column: str) -> float:
    return _safe(df, column, F.sum)


def safe_max(df: DataFrame | None, column: str) -> float:
    return _safe(df, column, F.max)


def _safe(df: DataFrame | None, column: str, f: Callable[[Column], Column]) -> float:
    """0 for a missing table or column and for no rows; a value that is not finite is an error."""
    if df is None or column not in df.columns:
        return 0.0
    row = df.agg(F.coalesce(f(F.col(column).cast("double")), F.lit(0.0)).alias("x"), F.count_if(checks.not_finite(F.col(column))).alias("bad")).first()
    if row["bad"]:
        raise IntegrityError(f"{column}: {row['bad']} values are not finite")
    return row["x"]


def require_balance(generation: float, demand: float, losses: float, what: str = "power", tolerance: float = BALANCE_TOLERANCE) -> float:
    residual = generation - demand - losses
    if not abs(residual) <= tolerance:
        raise IntegrityError(f"{what} balance is off by {residual}")
    return residual


def require_voltages(res_bus: DataFrame, lower: float = 0.5, upper: float = 1.5) -> None:
    bad = checks.not_finite(F.col("vm_pu")) | ~((F.col("vm_pu") > lower) & (F.col("vm_pu") < upper))
    checks.none_of(res_bus.where(bad), f"voltages outside ({lower}, {upper})")


def binding_constraints(df: DataFrame, constraints: str = "constraints", tolerance: float = 1e-5) -> DataFrame:
    """The array of structs with a slack near zero; a missing slack is 1."""
    return df.withColumn("binding", F.filter(constraints, lambda x: F.abs(F.coalesce(x["slack"], F.lit(1.0))) <= tolerance))


def peak_step(values: DataFrame, step: str = "pos") -> DataFrame:
    """The step with the largest sum, the first on ties; no row if there are no values."""
    return values.groupBy(step).agg(F.sum("value").alias("total")).orderBy(F.desc("total"), step).limit(1)


def validation_positions(axis: DataFrame, load: DataFrame, generation: DataFrame, *, zone: str = timeaxis.ZONE) -> DataFrame:
    """(pos): ends, quartiles, peaks of load and generation, and both sides of each change of daylight saving."""
    spark = axis.sparkSession
    n = axis.count()
    if not n:
        raise IntegrityError("the axis is empty")
    fixed = spark.createDataFrame([(x,) for x in (0, n // 4, n // 2, 3 * n // 4, n - 1)], "pos long")
    peaks = [peak_step(x).select("pos") for x in (load, generation)]
    return reduce(DataFrame.union, [fixed, *peaks, timeaxis.transitions(axis, zone=zone)]).distinct().where((F.col("pos") >= 0) & (F.col("pos") < n)).orderBy("pos")


def solve(snapshots: DataFrame, solver: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "position") -> DataFrame:
    """Run a power-flow solver, one task per snapshot: it gets a snapshot's element rows and returns result rows.

    A solver that does not converge must raise; the run then fails. A snapshot has the grid's elements, a bounded group.
    """
    return snapshots.groupBy(key).applyInPandas(solver, schema)
