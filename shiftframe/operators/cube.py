"""The dense cube: profile formula, element to bus, net demand, one row for each step and bus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BASE_CHANNELS, CHANNELS, FAMILIES, NET_P, NET_Q, PROFILED, SUFFIX
from . import checks


def net_demand() -> tuple[Column, Column]:
    """Consumer-positive: load + storage - sgen - gen, and the loads' reactive power; in double precision."""
    x = {name: F.col(name).cast("double") for name in BASE_CHANNELS}
    return x["load_p_mw"] + x["storage_p_mw"] - x["sgen_p_mw"] - x["gen_p_mw"], x["load_q_mvar"]


def with_net_demand(cube: DataFrame, kind: str | None = "float") -> DataFrame:
    """The seven channels; sums are in double precision and cast last."""
    p, q = net_demand()
    out = cube.withColumns({NET_P: p, NET_Q: q})
    if kind:
        out = out.withColumns({x: F.col(x).cast(kind) for x in CHANNELS})
    return out.select(*[x for x in cube.columns if x not in CHANNELS], *CHANNELS)


def signal_name(element: str, column: str, profile: Column) -> Column:
    """Name of the profile's signal: loads have one for each of P and Q."""
    suffix = SUFFIX.get((element, column), "")
    return F.concat(profile, F.lit(suffix)) if suffix else profile


def _matched(elements: DataFrame, signals: DataFrame, element: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Elements with base and signal, and those with a signal beside each family that has it (null where none has)."""
    profile = F.col("profile") if "profile" in elements.columns else F.lit(None).cast("string")
    own = elements.select("element_id", F.col(column).cast("double").alias("base"), signal_name(element, column, profile).alias("signal"))
    usable = signals.where(F.col("family").isin(*FAMILIES[element])).select("family", "signal").distinct()
    return own, own.where("signal IS NOT NULL").join(usable, "signal", "left")


def ambiguous_signals(elements: DataFrame, signals: DataFrame, element: str, column: str) -> DataFrame:
    """(element_id, signal, matches) of elements whose signal is in no family that may drive them, or in several."""
    matched = _matched(elements, signals, element, column)[1]
    return matched.groupBy("element_id", "signal").agg(F.count("family").alias("matches")).where("matches <> 1")


def resolved_signals(elements: DataFrame, signals: DataFrame, element: str, column: str) -> DataFrame:
    """(element_id, base, family, signal) of each element; an element with a profile needs one family that has its signal.

    signals: (family, signal), one row for each column of the profile tables.
    """
    checks.none_of(ambiguous_signals(elements, signals, element, column), f"{element}.{column}: a profile must have its signal in exactly one family")
    own, matched = _matched(elements, signals, element, column)
    plain = own.where("signal IS NULL").select("element_id", "base", F.lit(None).cast("string").alias("family"), "signal")
    return matched.select("element_id", "base", "family", "signal").unionByName(plain)


def absolute_profile(elements: DataFrame, profiles: DataFrame, axis: DataFrame, element: str, column: str) -> DataFrame:
    """(pos, element_id, value): base power times factor, or base power alone where there is no profile.

    profiles: (family, pos, signal, factor). Joined by position, never by local time, which repeats in autumn. Element
    tables are dimensions of the grid, a few rows per bus, so Spark may broadcast them by their statistics.
    """
    own = resolved_signals(elements, profiles.select("family", "signal"), element, column)
    driven = profiles.join(own.where("signal IS NOT NULL"), ["family", "signal"]).select("pos", "element_id", (F.col("base") * F.col("factor")).alias("value"))
    constant = axis.select("pos").crossJoin(own.where("signal IS NULL").select("element_id", F.col("base").alias("value")))
    return driven.unionByName(constant.select("pos", "element_id", "value"))


def absolute_bundle(tables: dict[str, DataFrame], profiles: DataFrame, axis: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """One absolute profile for each of the required element columns; no element may lack a step or have a bad value."""
    n = axis.count()
    out = {}
    for element, column in PROFILED:
        one = absolute_profile(tables[element], profiles, axis, element, column)
        checks.finite(one, ["value"], f"{element}.{column}")
        wrong = one.groupBy("element_id").count().where(F.col("count") != n)
        checks.none_of(wrong, f"{element}.{column}: elements without a value for each of {n} positions")
        checks.same_keys(one, tables[element], "element_id", f"{element}.{column}: profile and table differ in elements")
        out[element, column] = one
    return out


def manual_row(elements: DataFrame, profiles: DataFrame, element: str, column: str, pos: int) -> DataFrame:
    """The formula at one position; a negative one counts from the end."""
    if pos < 0:
        pos += profiles.agg(F.max("pos")).first()[0] + 1
    at = profiles.where(F.col("pos") == pos)
    own = resolved_signals(elements, at.select("family", "signal"), element, column)
    factor = F.when(F.col("signal").isNull(), 1.0).otherwise(F.col("factor"))
    out = own.join(at.select("family", "signal", "factor"), ["family", "signal"], "left").select("element_id", (F.col("base") * factor).alias("value"))
    checks.finite(out, ["value"], f"{element}.{column} at {pos}")
    return out


def verify_formula(bundle: dict[tuple[str, str], DataFrame], tables: dict[str, DataFrame], profiles: DataFrame, pos: int, tolerance: float = 1e-12) -> dict[str, float]:
    """Largest difference between a bundle and the formula at one position, per element column."""
    out = {}
    for (element, column), values in bundle.items():
        there = values.where(F.col("pos") == pos).select("element_id", F.col("value").alias("official"))
        both = manual_row(tables[element], profiles, element, column, pos).join(there, "element_id", "full_outer")
        out[f"{element}.{column}"] = checks.worst(both, "element_id", F.col("value") - F.col("official"), tolerance, f"{element}.{column} at {pos}")
    return out


def assign_row(elements: DataFrame, values: DataFrame, column: str, pos: int) -> DataFrame:
    """The element table with its column set to the values at a position; a new table, the old one stays as it is."""
    at = values.where(F.col("pos") == pos).select("element_id", F.col("value").alias("_value"))
    checks.same_keys(elements, at, "element_id", f"{column} at {pos}: values and table differ in elements")
    return elements.drop(column).join(at, "element_id").withColumnRenamed("_value", column)


def element_to_bus(values: DataFrame, elements: DataFrame, buses: DataFrame, name: str) -> DataFrame:
    """(step, bus, name): sums over a bus's elements. An element at an unknown bus is an error."""
    checks.none_of(elements.join(buses.select("bus"), "bus", "left_anti"), f"{name}: elements at unknown buses")
    return values.join(elements.select("element_id", "bus"), "element_id").groupBy(F.col("pos").alias("step"), "bus").agg(F.sum("value").alias(name))


def dense(sums: DataFrame, steps: DataFrame, buses: DataFrame, columns: list[str], zero: object = 0.0) -> DataFrame:
    """One row for each step and bus; what has no element is zero. NaN is not touched: it must fail a check, not vanish.

    The grid is steps x buses, the cube's own size. Buses are a dimension table.
    """
    grid = steps.select("step").crossJoin(buses.select("bus"))
    return grid.join(sums, ["step", "bus"], "left").select("step", "bus", *[F.coalesce(F.col(x), F.lit(zero)).alias(x) for x in columns])


def build_cube(tables: dict[str, DataFrame], bundle: dict[tuple[str, str], DataFrame], axis: DataFrame) -> DataFrame:
    """(step, bus, seven channels FLOAT). All elements go through one shuffle: long rows, pivoted by conditional sums."""
    buses = tables["bus"].select(F.col("element_id").alias("bus"))
    name = {("load", "p_mw"): "load_p_mw", ("load", "q_mvar"): "load_q_mvar", ("sgen", "p_mw"): "sgen_p_mw", ("gen", "p_mw"): "gen_p_mw", ("storage", "p_mw"): "storage_p_mw"}
    parts = []
    for (element, column), values in bundle.items():
        own = tables[element].select("element_id", "bus")
        checks.none_of(own.join(buses, "bus", "left_anti"), f"{element}: elements at unknown buses")
        parts.append(values.join(own, "element_id").select(F.col("pos").alias("step"), "bus", F.lit(name[element, column]).alias("channel"), "value"))
    long = reduce(DataFrame.unionByName, parts)
    sums = long.groupBy("step", "bus").agg(*[F.sum(F.when(F.col("channel") == x, F.col("value"))).alias(x) for x in BASE_CHANNELS])
    cube = with_net_demand(dense(sums, axis.select(F.col("pos").alias("step")), buses, list(BASE_CHANNELS)))
    checks.finite(cube, list(CHANNELS), "cube")
    return cube


def long_channels(cube: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(step, bus, channel, value)"""
    return cube.unpivot(["step", "bus"], list(channels), "channel", "value")
