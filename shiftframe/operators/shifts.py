"""Controlled distribution shifts: sensor dropout and scaling of distributed generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cube import net_demand


def keyed_uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the keys alone, so that it does not depend on partitions or order: 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def sensor_dropout(df: DataFrame, value: str, rate: float, seed: int = 0, keys: tuple[str, ...] = ("step", "bus")) -> DataFrame:
    """The rows with `observed`, and the value NULL where it is not: missing completely at random, at the given rate."""
    if not 0 <= rate <= 1:
        raise ValueError("the rate must lie in [0, 1]")
    if seed < 0:
        raise ValueError("the seed must not be negative")
    out = df.withColumn("observed", keyed_uniform(seed, *keys) >= rate)
    return out.withColumn(value, F.when(F.col("observed"), F.col(value)))


def scale_der(cube: DataFrame, factor: float, channels: tuple[str, ...] = ("sgen_p_mw",)) -> DataFrame:
    """The cube with scaled generation and the net demand that follows."""
    if not factor >= 0 or factor == float("inf"):
        raise ValueError("the factor must be finite and not negative")
    kinds = {x: cube.schema[x].dataType for x in cube.columns}
    out = cube.withColumns({x: (F.col(x) * F.lit(factor)).cast(kinds[x]) for x in channels})
    p, q = net_demand()
    return out.withColumns({"net_demand_p_mw": p.cast(kinds["net_demand_p_mw"]), "net_demand_q_mvar": q.cast(kinds["net_demand_q_mvar"])})
