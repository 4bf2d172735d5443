"""A cube from an event table, where no grid data are at hand: event types stand for channels, users for buses.

Amounts stay integer hundredths, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Split, split_at
from ..operators import cube as cubes
from ..schemas import BASE_CHANNELS, NET_P, NET_Q
from ..session import pin

STEPS, BUSES = 2880, 8
SPLIT: Split = split_at(0, 2016, 2496, 2880)
START = "2024-01-01 00:00:00"
TYPES = {"view": "load_p_mw", "click": "load_q_mvar", "purchase": "sgen_p_mw", "signup": "gen_p_mw", "error": "storage_p_mw"}


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, bus, event_type, cents) of each event."""
    pin(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    step = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{START}', ts) div 900")
    return events.select(step.cast("long").alias("step"), (F.col("user_id") % BUSES).alias("bus"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, n) of the events before the first step or after the last, which the cube leaves out."""
    return elements(spark, sf_dir).where((F.col("step") < 0) | (F.col("step") >= STEPS)).groupBy("event_type").agg(F.count("*").alias("n"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, bus, five base channels): what there is, not yet dense."""
    own = elements(spark, sf_dir)
    return own.groupBy("step", "bus").agg(*[F.sum(F.when(F.col("event_type") == k, F.col("cents")).otherwise(0)).alias(v) for k, v in TYPES.items()])


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, bus, seven channels in hundredths), a row for each of the steps and buses. Its axis is the benchmark's 30
    days; what lies outside is told by outside()."""
    steps, buses = spark.range(STEPS).select(F.col("id").alias("step")), spark.range(BUSES).select(F.col("id").alias("bus"))
    full = cubes.dense(sums(spark, sf_dir), steps, buses, list(BASE_CHANNELS), 0)
    p = F.col("load_p_mw") + F.col("storage_p_mw") - F.col("sgen_p_mw") - F.col("gen_p_mw")
    return full.withColumns({NET_P: p, NET_Q: F.col("load_q_mvar")})
