"""Time axis: localisation across daylight saving, cadence, calendar features, exact boundaries."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..schemas import CALENDAR, STEP_SECONDS
from . import checks

ZONE = "Europe/Berlin"
FORMAT = "dd.MM.yyyy HH:mm"


def localise(profile: DataFrame, *, zone: str = ZONE, time_col: str = "time", fmt: str = FORMAT, seconds: int = STEP_SECONDS) -> DataFrame:
    """(pos, t_utc) of a local wall-clock series of strings, which may repeat an hour in autumn and lack one in spring.

    The first time is converted and the series generated from it at a constant cadence; then every generated instant
    must read, in local time, exactly as its string. A constant cadence fixes which of two equal readings is meant.
    A first reading that is itself ambiguous or does not exist is refused.
    """
    rows = profile.select("pos", F.col(time_col).alias("raw"), F.expr(f"try_to_timestamp({time_col}, '{fmt}')").alias("local"))
    checks.none_of(rows.where("local IS NULL"), "a time is not of the expected form")
    checks.unique(rows, ["pos"], "a position occurs twice")
    first = rows.orderBy("pos").limit(1).select("pos", "local", F.to_utc_timestamp("local", zone).alias("u0")).first()
    if first is None:
        raise IntegrityError("the profile has no rows")
    u0 = F.lit(first["u0"])
    probe = rows.sparkSession.range(1).select(
        F.from_utc_timestamp(u0, zone).alias("again"),
        *[F.from_utc_timestamp(u0 + F.expr(f"INTERVAL {h} HOURS"), zone).alias(f"h{h}".replace("-", "m")) for h in (-1, 1)],
    ).first()
    if probe["again"] != first["local"]:
        raise IntegrityError(f"the first time {first['local']} does not exist in {zone}")
    if first["local"] in (probe["hm1"], probe["h1"]):
        raise IntegrityError(f"the first time {first['local']} is ambiguous in {zone}")
    made = rows.select("pos", "raw", "local", F.timestamp_seconds(F.unix_timestamp(u0) + (F.col("pos") - first["pos"]) * seconds).alias("t_utc"))
    checks.none_of(made.where(F.from_utc_timestamp("t_utc", zone) != F.col("local")), f"times do not follow each other every {seconds} s in {zone}")
    return made.select("pos", "t_utc")


def cadence_breaks(axis: DataFrame, *, order: str = "step", by: tuple[str, ...] = (), expected: int = 1) -> DataFrame:
    """Rows that don't follow their predecessor by `expected`, with the gap."""
    w = Window.partitionBy(*by).orderBy(order)
    return axis.withColumn("gap", F.col(order) - F.lag(order).over(w)).where(F.col("gap") != expected)


def transitions(axis: DataFrame, *, zone: str = ZONE, seconds: int = STEP_SECONDS) -> DataFrame:
    """Positions on either side of a jump of local time. (pos, t_utc) -> pos

    The offset between neighbours is compared, which needs no window over the whole axis: an instant is last before a
    jump if the zone's offset differs one step later.
    """
    offset = lambda t: F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)
    later = F.timestamp_seconds(F.unix_timestamp("t_utc") + seconds)
    jumps = axis.where(offset(F.col("t_utc")) != offset(later)).select("pos")
    both = jumps.select(F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))
    return both.join(axis.select("pos"), "pos", "left_semi").distinct()


def utc_axis(axis: DataFrame, n: int | None = None, *, seconds: int = STEP_SECONDS) -> None:
    """Assert that (step, t_utc) is gap-free: t_utc = t0 + step * seconds for every step 0, 1, 2, ..."""
    row = axis.agg(
        F.count("*").alias("n"), F.count_distinct("step").alias("distinct"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.min(F.unix_timestamp("t_utc") - F.col("step") * seconds).alias("a"), F.max(F.unix_timestamp("t_utc") - F.col("step") * seconds).alias("b"),
        F.count_if(F.col("t_utc").isNull() | F.col("step").isNull()).alias("nulls"),
    ).first()
    if not row["n"] or row["nulls"] or row["distinct"] != row["n"] or row["lo"] != 0 or row["hi"] != row["n"] - 1 or row["a"] != row["b"]:
        raise IntegrityError(f"the UTC axis has gaps, repeats or nulls: {row.asDict()}")
    if n is not None and row["n"] != n:
        raise IntegrityError(f"the UTC axis has {row['n']} steps, not {n}")


def calendar(t_utc: Column, *, zone: str = ZONE, standard_hours: float = 1.0) -> list[Column]:
    """The eight calendar features of an instant. Weeks begin on Monday; the year is a cycle of 366 days."""
    local = F.from_utc_timestamp(t_utc, zone)
    offset = (F.unix_timestamp(local) - F.unix_timestamp(t_utc)) / 3600.0
    turns = {
        "minute": (F.hour(local) * 60 + F.minute(local)) / F.lit(1440.0),
        "weekday": F.weekday(local) / F.lit(7.0),
        "year": (F.dayofyear(local) - 1) / F.lit(366.0),
    }
    angles = [f(x * (2 * math.pi)).alias(f"{name}_{g}") for name, x in turns.items() for g, f in (("sin", F.sin), ("cos", F.cos))]
    return [*angles, offset.cast("double").alias("utc_offset_hours"), F.when(offset > standard_hours, 1.0).otherwise(0.0).alias("is_dst")]


def calendar_table(axis: DataFrame, *, zone: str = ZONE) -> DataFrame:
    """(step, eight features) of (step, t_utc)."""
    out = axis.select("step", *calendar(F.col("t_utc"), zone=zone))
    checks.ordered_columns(out, CALENDAR, "calendar")
    return out


def generated_axis(spark: SparkSession, start_utc: datetime | str, n: int, *, seconds: int = STEP_SECONDS) -> DataFrame:
    """(step, t_utc) for n steps from an instant."""
    t0 = F.unix_timestamp(F.lit(str(start_utc)).cast("timestamp"))
    return spark.range(n).select(F.col("id").alias("step"), F.timestamp_seconds(t0 + F.col("id") * seconds).alias("t_utc"))


def boundary_to_utc(spark: SparkSession, local: datetime | str, *, zone: str = ZONE) -> datetime:
    """The instant of a local boundary without a zone; one that is repeated or skipped is refused."""
    if isinstance(local, datetime) and local.tzinfo is not None:
        raise IntegrityError("a local boundary must not have a zone")
    text = str(local)
    row = (
        spark.range(1)
        .select(F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd HH:mm:ss")).alias("l"))
        .select("l", F.to_utc_timestamp("l", zone).alias("u"))
        .select("l", "u", F.from_utc_timestamp("u", zone).alias("again"), *[F.from_utc_timestamp(F.col("u") + F.expr(f"INTERVAL {h} HOURS"), zone).alias(n) for h, n in ((-1, "before"), (1, "after"))])
        .first()
    )
    if row["l"] is None:
        raise IntegrityError(f"{text!r} is not a time")
    if row["again"] != row["l"]:
        raise IntegrityError(f"{text} does not exist in {zone}")
    if row["l"] in (row["before"], row["after"]):
        raise IntegrityError(f"{text} is ambiguous in {zone}")
    return row["u"]


def exact_position(axis: DataFrame, instant: datetime, *, allow_end: bool = False, seconds: int = STEP_SECONDS) -> int:
    """Step of an instant that must be on the axis; with allow_end also the step after the last."""
    at = F.lit(instant)
    row = axis.agg(F.max(F.when(F.col("t_utc") == at, F.col("step"))).alias("hit"), F.max("step").alias("last"), F.max("t_utc").alias("end")).first()
    if row["hit"] is not None:
        return row["hit"]
    if allow_end and row["end"] is not None and (instant - row["end"]).total_seconds() == seconds:
        return row["last"] + 1
    raise IntegrityError(f"{instant} is not on the time axis")
