"""Snapshots of a grid: the injections at chosen positions, a power-flow solver, and one summary row for each position.

All positions go through one plan. Injections and results are long tables, so a snapshot's checks and sums are
aggregates by position, and the solver, a plug-in, gets one position's injections at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..schemas import BALANCE_TOLERANCE, BRANCHES, FAMILIES, PROFILED
from ..session import checkpoint_folder
from . import checks, cube, physics

#: What a solver returns: a value of an element's result table.
RESULTS = "position long, result string, element_id long, name string, value double"
#: The summary's maxima and sums, by result table and column.
LARGEST = {"max_line_loading_percent": ("res_line", "loading_percent"), "max_trafo_loading_percent": ("res_trafo", "loading_percent")}
TOTALS = {
    "total_load_p_mw": ("res_load", "p_mw"), "total_load_q_mvar": ("res_load", "q_mvar"), "total_sgen_p_mw": ("res_sgen", "p_mw"), "total_gen_p_mw": ("res_gen", "p_mw"),
    "total_storage_p_mw": ("res_storage", "p_mw"), "total_ext_grid_p_mw": ("res_ext_grid", "p_mw"), "total_ext_grid_q_mvar": ("res_ext_grid", "q_mvar"),
}
UNITS = {"active": ("p", "mw"), "reactive": ("q", "mvar")}


def at_positions(axis: DataFrame, positions: DataFrame) -> DataFrame:
    """(position) in range: a negative one counts from the axis's end; one that is outside is an error."""
    n = axis.count()
    own = positions.select(F.when(F.col("position") < 0, F.col("position") + n).otherwise(F.col("position")).cast("long").alias("position")).distinct()
    checks.none_of(own.where((F.col("position") < 0) | (F.col("position") >= n)), f"positions outside [0, {n})")
    return own


def times(profile: DataFrame, axis: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, local_time, utc_time): the raw local text of a profile's time, and the axis's UTC time in ISO form."""
    local = profile.select(F.col("pos").alias("position"), F.col("time").cast("string").alias("local_time"))
    utc = axis.select(F.col("pos").alias("position"), F.date_format(F.to_utc_timestamp("t_utc", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("utc_time"))
    return positions.select("position").join(local, "position").join(utc, "position")


def injections(tables: Mapping[str, DataFrame], bundle: Mapping[tuple[str, str], DataFrame], positions: DataFrame) -> DataFrame:
    """(position, element, element_id, bus, name, value): each element column's profile value at each position, exactly."""
    parts = []
    for element, name in PROFILED:
        own = tables[element].select("element_id", "bus")
        values = bundle[element, name].withColumnRenamed("pos", "position").join(positions.select("position"), "position")
        parts.append(values.join(own, "element_id").select("position", F.lit(element).alias("element"), "element_id", "bus", F.lit(name).alias("name"), "value"))
    return reduce(DataFrame.unionByName, parts)


def _of(result: str, name: str) -> Column:
    return F.when((F.col("result") == result) & (F.col("name") == name), F.col("value"))


def _total(result: str, name: str) -> Column:
    return F.coalesce(F.sum(_of(result, name)), F.lit(0.0))


def _losses(kind: str, unit: str) -> Column:
    """Over all branch tables: the loss column's sum, or that of the flows into both ends where there is none."""
    parts = []
    for branch in BRANCHES:
        table = f"res_{branch}"
        loss, ends = f"{kind}l_{unit}", [f"{kind}_from_{unit}", f"{kind}_to_{unit}"]
        there = reduce(lambda a, b: a & b, [F.count(_of(table, x)) > 0 for x in ends])
        parts.append(F.when(F.count(_of(table, loss)) > 0, _total(table, loss)).when(there, _total(table, ends[0]) + _total(table, ends[1])).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def summary(results: DataFrame) -> DataFrame:
    """One row for each position: voltages, loadings, sums, losses and balance residuals; no rule is checked here."""
    vm = _of("res_bus", "vm_pu")
    values = {"min_vm_pu": F.min(vm), "max_vm_pu": F.max(vm)}
    values |= {k: F.coalesce(F.max(_of(*v)), F.lit(0.0)) for k, v in LARGEST.items()} | {k: _total(*v) for k, v in TOTALS.items()}
    for name, (kind, unit) in UNITS.items():
        values[f"{name}_branch_loss_{unit}"] = _losses(kind, unit)
        values[f"_{name}_bus"] = _total("res_bus", f"{kind}_{unit}")
    own = results.groupBy("position").agg(F.lit(True).alias("converged"), *[v.alias(k) for k, v in values.items()])
    return own.withColumns({f"{name}_balance_residual_{unit}": F.col(f"_{name}_bus") + F.col(f"{name}_branch_loss_{unit}") for name, (_, unit) in UNITS.items()}).drop(*[f"_{x}_bus" for x in UNITS])


def require_sound(results: DataFrame, summaries: DataFrame, positions: DataFrame, *, lower: float = 0.5, upper: float = 1.5, tolerance: float = BALANCE_TOLERANCE) -> None:
    """Every position has results, all of them finite; voltages lie strictly between the bounds, and power is balanced."""
    checks.none_of(positions.join(summaries.where("min_vm_pu IS NOT NULL"), "position", "left_anti"), "positions without bus voltages")
    checks.none_of(results.where(checks.not_finite(F.col("value"))), "results that are not finite")
    rules = {"voltages are implausible": (F.col("min_vm_pu") <= lower) | (F.col("max_vm_pu") >= upper)}
    rules |= {f"{x} power is not balanced": F.abs(f"{x}_balance_residual_{unit}") > tolerance for x, (_, unit) in UNITS.items()}
    checks.require(summaries, rules, "power flow")


def verify_formula(bundle: Mapping[tuple[str, str], DataFrame], tables: Mapping[str, DataFrame], profiles: DataFrame, positions: DataFrame, tolerance: float = 1e-12) -> None:
    """The bundle's values at the positions are base power times factor, and base power where there is no profile; one pass."""
    at = profiles.join(positions.select(F.col("position").alias("pos")), "pos")
    parts = []
    for element, name in PROFILED:
        own = tables[element].select("element_id", F.col(name).cast("double").alias("base"), cube.signal_name(element, name, F.col("profile")).alias("signal"))
        usable = at.where(F.col("family").isin(*FAMILIES[element])).select("pos", "signal", "factor")
        official = bundle[element, name].join(positions.select(F.col("position").alias("pos")), "pos")
        both = official.join(own, "element_id").join(usable, ["pos", "signal"], "left")
        formula = F.col("base") * F.when(F.col("signal").isNull(), 1.0).otherwise(F.col("factor"))
        parts.append(both.select(F.lit(f"{element}.{name}").alias("column"), "element_id", "pos", "value", formula.alias("formula")))
    wrong = reduce(DataFrame.unionByName, parts)
    checks.none_of(wrong.where(checks.not_finite(F.col("formula")) | (F.abs(F.col("value") - F.col("formula")) > tolerance)), "profile values that are not the formula's")


def reconstruct(
    grid_code: str, grid: Mapping[str, object], raw_profile: DataFrame, positions: DataFrame, solver: Callable[[pd.DataFrame], pd.DataFrame], *,
    bundle: Mapping[tuple[str, str], DataFrame] | None = None, formula: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(results, summaries) of a loaded grid (see tables.load_grid) at the positions asked for.

    raw_profile: (pos, time) of a profile family as it was read. The solver gets a position's injections and returns
    rows of RESULTS; one that does not converge must raise. It runs once for each position: its results are
    checkpointed. The bundle of absolute profiles is made if it is not given; `formula` compares it with the formula.
    """
    tables, axis = grid["tables"], grid["axis"]
    bundle = bundle or cube.absolute_bundle(tables, grid["profiles"], axis)
    own = at_positions(axis, positions)
    if own.isEmpty():
        raise IntegrityError("no position was asked for")
    if formula:
        verify_formula(bundle, tables, grid["profiles"], own)
    checkpoint_folder(own.sparkSession)
    results = physics.solve(injections(tables, bundle, own), solver, RESULTS).checkpoint()
    summaries = summary(results)
    require_sound(results, summaries, own)
    named = summaries.join(times(raw_profile, axis, own), "position")
    first = [F.lit(grid_code).alias("grid_code"), "position", "local_time", "utc_time"]
    return results, named.select(*first, *[x for x in summaries.columns if x != "position"])
