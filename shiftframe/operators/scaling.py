"""Scaling and activity, fitted on training rows alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import Split, Task
from ..errors import IntegrityError
from ..schemas import ACTIVITY_EPSILON, SCALE_EPSILON
from . import checks


def fit(cube: DataFrame, split: Split, channels: list[str] | tuple[str, ...], *, epsilon: float = SCALE_EPSILON) -> DataFrame:
    """(channel, bus, mean, scale, is_constant, fit_rows): population statistics of the training rows.

    The range of steps is a filter before the only aggregate, so later rows are not even read into it.
    """
    unknown = [x for x in channels if x not in cube.columns]
    if unknown or not channels:
        raise IntegrityError(f"unknown or no channels: {unknown}")
    if split.train[0] != 0:
        raise IntegrityError("training must begin at step 0")
    train = cube.where((F.col("step") >= split.train[0]) & (F.col("step") < split.train[1]))
    stats = [f(F.col(x).cast("double")).alias(f"{g}_{x}") for x in channels for g, f in (("m", F.avg), ("s", F.stddev_pop))]
    wide = train.groupBy("bus").agg(F.count("*").alias("fit_rows"), *stats)
    flat = wide.select("bus", "fit_rows", F.explode(F.array(*[F.struct(F.lit(x).alias("channel"), F.col(f"m_{x}").alias("mean"), F.col(f"s_{x}").alias("std")) for x in channels])).alias("x"))
    constant = F.col("x.std") <= epsilon
    return flat.select("x.channel", "bus", "x.mean", F.when(constant, 1.0).otherwise(F.col("x.std")).alias("scale"), constant.alias("is_constant"), "fit_rows")


def fit_task(cube: DataFrame, split: Split, task: Task) -> DataFrame:
    return fit(cube, split, task.channels())


def transform(cube: DataFrame, scaler: DataFrame, channels: list[str] | tuple[str, ...]) -> DataFrame:
    """(step, bus, z-scores). The scaler has a row for each bus and channel, pivoted to one for each bus before the join."""
    unknown = [x for x in channels if x not in cube.columns]
    if unknown:
        raise IntegrityError(f"unknown channels: {unknown}")
    wide = scaler.groupBy("bus").agg(*[F.max(F.when(F.col("channel") == x, F.col(k))).alias(f"{k}_{x}") for x in channels for k in ("mean", "scale")])
    checks.none_of(wide.where(reduce(lambda a, b: a | b, [F.col(f"mean_{x}").isNull() for x in channels])), "the scaler lacks a channel")
    checks.none_of(cube.select("bus").distinct().join(wide, "bus", "left_anti"), "the scaler lacks a bus")
    z = [((F.col(x).cast("double") - F.col(f"mean_{x}")) / F.col(f"scale_{x}")).alias(x) for x in channels]
    return cube.join(wide, "bus").select("step", "bus", *z)


def activity(cube: DataFrame, split: Split, channel: str, *, epsilon: float = ACTIVITY_EPSILON) -> DataFrame:
    """(bus, active): mean absolute value over the training rows above epsilon."""
    return activities(cube, split, (channel,), epsilon=epsilon).select("bus", "active")


def activities(cube: DataFrame, split: Split, channels: tuple[str, ...], *, epsilon: float = ACTIVITY_EPSILON) -> DataFrame:
    """(channel, bus, active) of several channels in one pass."""
    gone = sorted(set(channels) - set(cube.columns))
    if gone:
        raise IntegrityError(f"unknown channels {gone}")
    train = cube.where((F.col("step") >= split.train[0]) & (F.col("step") < split.train[1]))
    means = train.groupBy("bus").agg(*[(F.avg(F.abs(F.col(x).cast("double"))) > epsilon).alias(x) for x in channels])
    return means.unpivot(["bus"], list(channels), "channel", "active").select("channel", "bus", "active")
