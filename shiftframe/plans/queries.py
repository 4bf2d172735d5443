"""Queries over the driver's tables, one for each operator, with the SQL that checks them.

Amounts are integers (hundredths) until a last division, so sums do not depend on their order; results in double
precision are rounded to what both engines agree on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import Split, Task, WindowSpec, fraction_split, partition_split, split_at
from ..operators import checks, conformal, features, metrics, naive, physics, scaling, scan, shifts, timeaxis, windows
from ..operators import cube as cubes
from ..schemas import CALENDAR, CHANNELS, NET_P, NET_Q, QUANTILES, STATIC
from ..session import pin
from ..sources import events, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPEC = WindowSpec(96, 16)
SPEC_LONG = WindowSpec(672, 96)
NETS = {NET_P: "net_p", NET_Q: "net_q"}
ORDER = [b.baseline_id for b in naive.BASELINES]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(pin(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, with negative zero made zero."""
    return df.withColumns({x: F.round(F.col(x).cast("double"), digits) + F.lit(0.0) for x in columns})


# --- parts of the checking SQL

CUBE = """WITH ev AS (
  SELECT CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 900) AS BIGINT) AS step, user_id % 8 AS bus, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
sums AS (
  SELECT step, bus, sum(CASE WHEN event_type = 'view' THEN cents ELSE 0 END) AS load_p_mw, sum(CASE WHEN event_type = 'click' THEN cents ELSE 0 END) AS load_q_mvar,
    sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS sgen_p_mw, sum(CASE WHEN event_type = 'signup' THEN cents ELSE 0 END) AS gen_p_mw,
    sum(CASE WHEN event_type = 'error' THEN cents ELSE 0 END) AS storage_p_mw FROM ev GROUP BY step, bus),
base AS (
  SELECT s.step, b.bus, CAST(coalesce(load_p_mw, 0) AS BIGINT) AS load_p_mw, CAST(coalesce(load_q_mvar, 0) AS BIGINT) AS load_q_mvar, CAST(coalesce(sgen_p_mw, 0) AS BIGINT) AS sgen_p_mw,
    CAST(coalesce(gen_p_mw, 0) AS BIGINT) AS gen_p_mw, CAST(coalesce(storage_p_mw, 0) AS BIGINT) AS storage_p_mw
  FROM range(2880) s(step) CROSS JOIN range(8) b(bus) LEFT JOIN sums x ON x.step = s.step AND x.bus = b.bus),
cube AS MATERIALIZED (SELECT *, load_p_mw + storage_p_mw - sgen_p_mw - gen_p_mw AS net_demand_p_mw, load_q_mvar AS net_demand_q_mvar FROM base),
net AS MATERIALIZED (SELECT step, bus, 'net_p' AS channel, net_demand_p_mw AS v FROM cube UNION ALL SELECT step, bus, 'net_q', net_demand_q_mvar FROM cube),
bl AS (SELECT * FROM (VALUES ('last_value_v1', 0), ('seasonal_24h_v1', 96), ('seasonal_7d_v1', 672)) t(baseline, lag)),
vo AS (SELECT o AS origin FROM range(2015, 2480) t(o)),
goals AS (SELECT n.channel, vo.origin, CAST(h.h AS INT) AS horizon, n.bus, n.step, n.v AS y FROM vo CROSS JOIN range(16) h(h) JOIN net n ON n.step = vo.origin + 1 + h.h),
sources AS (SELECT goals.*, bl.baseline, CASE WHEN bl.lag = 0 THEN goals.origin ELSE goals.step - bl.lag END AS source FROM goals CROSS JOIN bl),
fc AS (SELECT sources.channel, sources.baseline, sources.origin, sources.horizon, sources.bus, sources.y, s.v AS yhat FROM sources JOIN net s ON s.channel = sources.channel AND s.bus = sources.bus AND s.step = sources.source),
act AS (SELECT channel, bus, avg(abs(v)) > 1e-8 AS active FROM net WHERE step < 2016 GROUP BY 1, 2)
"""


def all_channels(prefix: str = "") -> str:
    return ", ".join(prefix + x for x in CHANNELS)


# --- the cube


@query("cube_long", CUBE + f"SELECT step, bus, {all_channels()} FROM cube")
def cube_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cube(spark, sf_dir)


@query("cube_channel_totals", CUBE + "SELECT channel, CAST(sum(cents) AS BIGINT) AS total_cents, count(*) AS n FROM (UNPIVOT cube ON " + all_channels() + " INTO NAME channel VALUE cents) GROUP BY channel")
def cube_channel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.long_channels(events.cube(spark, sf_dir)).groupBy("channel").agg(F.sum("value").alias("total_cents"), F.count("*").alias("n"))


@query(
    "cube_conservation",
    CUBE + ", a AS (SELECT step, sum(cents) AS x FROM ev WHERE event_type = 'view' GROUP BY 1), b AS (SELECT step, sum(load_p_mw) AS x FROM cube GROUP BY 1) "
    "SELECT CAST(count(*) FILTER (WHERE abs(coalesce(a.x, 0) - coalesce(b.x, 0)) > 0) AS BIGINT) AS broken_steps FROM a FULL JOIN b ON a.step = b.step",
)
def cube_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events.elements(spark, sf_dir).where("event_type = 'view'").select("step", F.col("cents").alias("value"))
    per_bus = events.cube(spark, sf_dir).select("step", F.col("load_p_mw").alias("value"))
    return checks.conserved(own, per_bus, "value", 0.0).agg(F.count("*").alias("broken_steps"))


@query("element_to_bus_join", "SELECT l_linenumber::BIGINT AS step, s_nationkey::BIGINT AS bus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def element_to_bus_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are elements at the bus of their nation, line numbers are steps."""
    values = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("pos"), F.col("l_suppkey").alias("element_id"), F.col("l_quantity").cast("long").alias("value"))
    elements = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("element_id"), F.col("s_nationkey").cast("long").alias("bus"))
    buses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bus"))
    return cubes.element_to_bus(values, elements, buses, "quantity")


@query("elements_per_bus", "SELECT n_nationkey::BIGINT AS bus, count(s_suppkey) AS n, coalesce(CAST(sum(abs(CAST(round(s_acctbal * 100) AS BIGINT))) AS BIGINT), 0) AS installed FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def elements_per_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and installed power of the elements of each bus, none included."""
    elements = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("bus"), F.round(F.col("s_acctbal") * 100).alias("p_mw"))
    buses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bus"))
    installed = features.abs_sum_by_bus(elements, buses, "p_mw", "installed").withColumn("installed", F.col("installed").cast("long"))
    return features.counts_by_bus(elements, buses, "n").join(installed, "bus")


@query(
    "profile_formula",
    """WITH e AS (SELECT s_suppkey AS element_id, CAST(round(s_acctbal * 100) AS BIGINT) AS base, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END AS nation FROM supplier)
SELECT p.pos, e.element_id, CAST(base * CASE WHEN nation IS NULL THEN 1 ELSE 40 + 3 * nation + p.pos END AS BIGINT) AS value FROM e CROSS JOIN range(24) p(pos)""",
)
def profile_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are loads with their balance as base power; those of four in five have their nation's profile."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    profile = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    loads = supplier.select(F.col("s_suppkey").alias("element_id"), F.round(F.col("s_acctbal") * 100).alias("p_mw"), profile.alias("profile"))
    axis = spark.range(24).select(F.col("id").alias("pos"))
    factor = (40 + 3 * F.col("n_nationkey") + F.col("pos")).cast("double")
    signal = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("_pload"))
    profiles = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>")).alias("pos")).select(F.lit("load").alias("family"), "pos", signal.alias("signal"), factor.alias("factor"))
    return cubes.absolute_profile(loads, profiles, axis, "load", "p_mw").select("pos", "element_id", F.col("value").cast("long").alias("value"))


@query(
    "profile_ambiguity",
    """WITH s AS (SELECT DISTINCT 'powerplants' AS family, p_brand AS signal FROM part WHERE p_size <= 2 UNION ALL SELECT DISTINCT 'renewables', p_brand FROM part WHERE p_size >= 49)
SELECT p_partkey AS element_id, b.p_brand AS signal, count(s.family) AS matches FROM part b LEFT JOIN s ON s.signal = b.p_brand GROUP BY 1, 2 HAVING count(s.family) <> 1""",
)
def profile_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are static generators with their brand as profile; small and large sizes make the two families that may drive them."""
    part = table(spark, sf_dir, "part")
    families = [part.where(w).select(F.lit(f).alias("family"), F.col("p_brand").alias("signal")) for f, w in (("powerplants", "p_size <= 2"), ("renewables", "p_size >= 49"))]
    elements = part.select(F.col("p_partkey").alias("element_id"), F.col("p_size").alias("p_mw"), F.col("p_brand").alias("profile"))
    return cubes.ambiguous_signals(elements, families[0].union(families[1]), "sgen", "p_mw")


TAP = """WITH t AS (SELECT p_partkey AS element_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size - 25 END AS tap_pos, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS step_percent,
 CASE WHEN p_partkey % 11 = 0 THEN 90 WHEN p_partkey % 13 = 0 THEN -90 WHEN p_size % 2 = 0 THEN NULL ELSE 15 END AS step_degree, CASE WHEN p_type = 'SMALL' THEN 'Ratio' END AS tap_changer_type FROM part)
"""


def _trafo(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    degree = F.when(key % 11 == 0, 90).when(key % 13 == 0, -90).when(size % 2 == 0, None).otherwise(15)
    return table(spark, sf_dir, "part").select(
        key.alias("element_id"), F.when(size % 7 != 0, size - 25).alias("tap_pos"), F.lit(0).alias("tap_neutral"), F.when(key % 17 != 0, -20).alias("tap_min"), F.lit(20).alias("tap_max"),
        F.when(size % 3 == 0, 0).otherwise(size).alias("tap_step_percent"), degree.alias("tap_step_degree"), F.lit("hv").alias("tap_side"), F.when(F.col("p_type") == "SMALL", "Ratio").alias("tap_changer_type"),
    )


@query(
    "tap_repair_classify",
    TAP + "SELECT element_id, CAST(tap_pos AS BIGINT) AS tap_pos, CASE WHEN abs(abs(coalesce(step_degree, 0)) - 90) <= 1e-9 THEN 'Symmetrical' ELSE 'Ratio' END AS repaired_type "
    "FROM t WHERE tap_pos IS NOT NULL AND abs(step_percent) > 1e-12 AND tap_changer_type IS NULL",
)
def tap_repair_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _trafo(spark, sf_dir).where(physics.needs_type())
    return own.select("element_id", F.col("tap_pos").cast("long").alias("tap_pos"), physics.tap_type(F.col("tap_step_percent"), F.col("tap_step_degree")).alias("repaired_type"))


@query("tap_bounds", TAP + "SELECT element_id, CAST(tap_pos AS BIGINT) AS tap_pos FROM t WHERE (element_id % 17 <> 0 AND tap_pos < -20) OR tap_pos > 20")
def tap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.tap_bounds(_trafo(spark, sf_dir)).select("element_id", F.col("tap_pos").cast("long").alias("tap_pos"))


@query("numeric_coercion", "SELECT event_id AS pos, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(value AS DOUBLE) AS value FROM events")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in strings and numbers, as the columns of a profile table."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("time"), F.get_json_object("props", "$.k").alias("k"), "value")
    return tables.numeric_profile(own, "events").select("pos", "k", "value")


@query("profiles_without_signal", "SELECT s_suppkey AS element_id, 'n' || s_nationkey AS signal FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def profiles_without_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are storages with their nation's profile; three regions have signals."""
    named = lambda x: F.concat(F.lit("n"), F.col(x).cast("string"))
    elements = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("element_id"), named("s_nationkey").alias("profile"))
    signals = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.lit("storage").alias("family"), named("n_nationkey").alias("signal"))
    return tables.unmapped(elements, signals, "storage")


# --- the time axis

GAPS = CUBE + ", seen AS (SELECT DISTINCT step, bus FROM ev), g AS (SELECT bus, step, step - lag(step) OVER (PARTITION BY bus ORDER BY step) AS gap FROM seen) "


@query("cadence_check", GAPS + "SELECT bus, gap, count(*) AS n FROM g WHERE gap <> 1 GROUP BY 1, 2")
def cadence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events.elements(spark, sf_dir).select("step", "bus").distinct()
    return timeaxis.cadence_breaks(seen, by=("bus",)).groupBy("bus", "gap").agg(F.count("*").alias("n"))


#: Quarter-hours of all days with an order; steps count from the first of these days.
AXIS = """WITH od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), first AS (SELECT min(d) AS d0, max(d) AS d1 FROM od),
axis AS (SELECT CAST(date_diff('day', d0, d) * 96 + q AS BIGINT) AS step, CAST(d AS TIMESTAMP) + INTERVAL 15 MINUTE * q AS t FROM od CROSS JOIN first CROSS JOIN range(96) r(q)),
loc AS (SELECT step, t, timezone('Europe/Berlin', timezone('UTC', t)) AS l, timezone('Europe/Berlin', timezone('UTC', t + INTERVAL 15 MINUTE)) AS later FROM axis)
"""


def _order_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    rows = days.crossJoin(days.agg(F.min("d").alias("d0"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(95))))  # one row
    return rows.select((F.datediff("d", "d0") * 96 + F.col("q")).cast("long").alias("step"), F.timestamp_seconds(F.unix_date("d").cast("long") * 86400 + F.col("q") * 900).alias("t_utc"))


def _order_days(spark: SparkSession, sf_dir: str) -> tuple[date, int]:
    """The first day with an order, and the days to the last."""
    row = table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b")).first()
    return row["a"], (row["b"] - row["a"]).days + 1


@query("transition_positions", AXIS + ", j AS (SELECT step FROM loc WHERE later - l <> INTERVAL 15 MINUTE) SELECT step AS pos FROM j UNION SELECT step + 1 FROM j WHERE step + 1 IN (SELECT step FROM axis)")
def transition_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.transitions(_order_axis(spark, sf_dir).withColumnRenamed("step", "pos"))


@query(
    "calendar_features_2016",
    AXIS + """, f AS (SELECT step, hour(l) * 60 + minute(l) AS m, isodow(l) - 1 AS w, dayofyear(l) - 1 AS d, date_diff('second', t, l) / 3600.0 AS o FROM loc)
SELECT step, round(sin(2 * pi() * m / 1440), 9) + 0.0::DOUBLE AS minute_sin, round(cos(2 * pi() * m / 1440), 9) + 0.0::DOUBLE AS minute_cos, round(sin(2 * pi() * w / 7), 9) + 0.0::DOUBLE AS weekday_sin, round(cos(2 * pi() * w / 7), 9) + 0.0::DOUBLE AS weekday_cos,
 round(sin(2 * pi() * d / 366), 9) + 0.0::DOUBLE AS year_sin, round(cos(2 * pi() * d / 366), 9) + 0.0::DOUBLE AS year_cos, CAST(o AS DOUBLE) AS utc_offset_hours, CASE WHEN o > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_dst FROM f""",
)
def calendar_features_2016(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every quarter-hour of the days with an order."""
    return rounded(timeaxis.calendar_table(_order_axis(spark, sf_dir)), 9, *CALENDAR)


_DAYS = AXIS + """, c AS (SELECT d0, date_diff('day', d0, d1) + 1 AS n FROM first), b AS (SELECT epoch(timezone('Europe/Berlin', CAST(d0 AS TIMESTAMP))) AS z,
 epoch(timezone('Europe/Berlin', CAST(d0 + CAST(floor(n * 0.7::DOUBLE) AS INTEGER) AS TIMESTAMP))) AS v, epoch(timezone('Europe/Berlin', CAST(d0 + CAST(floor(n * 0.85::DOUBLE) AS INTEGER) AS TIMESTAMP))) AS t, epoch(timezone('Europe/Berlin', CAST(d0 + CAST(n AS INTEGER) AS TIMESTAMP))) AS e FROM c) """


@query("contract_split_positions", _DAYS + "SELECT CAST((v - z) / 900 AS BIGINT) AS validation_start, CAST((t - z) / 900 AS BIGINT) AS test_start, CAST((e - z) / 900 AS BIGINT) AS end_step FROM b")
def contract_split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract over the days from the first order to the last, with boundaries at local midnights."""
    from ..contract import Contract

    first, n = _order_days(spark, sf_dir)
    at = [f"{first + timedelta(days=k)} 00:00:00" for k in (0, math.floor(n * 0.7), math.floor(n * 0.85), n)]
    a, e = (timeaxis.boundary_to_utc(spark, x) for x in (at[0], at[3]))
    axis = timeaxis.generated_axis(spark, a, int((e - a).total_seconds()) // 900)
    found = windows.contract_split(axis, Contract(train_start=at[0], validation_start=at[1], test_start=at[2], dataset_end=at[3]))
    return spark.createDataFrame([(found.validation[0], found.test[0], found.n_steps)], "validation_start long, test_start long, end_step long")


# --- splits and windows


#: Steps up to the last event.
STEPS_SEEN = "WITH en AS (SELECT CAST(max(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) // 900) + 1 AS BIGINT) AS n FROM events)"


def _steps_seen(spark: SparkSession, sf_dir: str) -> int:
    return events.elements(spark, sf_dir).agg(F.max("step")).first()[0] + 1


def _seen_split(spark: SparkSession, sf_dir: str) -> Split:
    return split_at(0, events.SPLIT.validation[0], events.SPLIT.test[0], _steps_seen(spark, sf_dir))


def _bounds(train: str, validation: str) -> str:
    a, b = f"CAST(floor(n * {train}) AS BIGINT)", f"CAST(floor(n * ({validation})) AS BIGINT)"
    return STEPS_SEEN + f" SELECT 'train' AS split, 0::BIGINT AS \"start\", {a} AS \"end\" FROM en UNION ALL SELECT 'validation', {a}, {b} FROM en UNION ALL SELECT 'test', {b}, n FROM en"


@query("split_bounds", _bounds("0.7::DOUBLE", "0.7::DOUBLE + 0.15::DOUBLE"))
def split_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_table(spark, fraction_split(_steps_seen(spark, sf_dir)))


PLAN = STEPS_SEEN + """, s AS (SELECT 'train' AS split, 0 AS a, 2016::BIGINT AS b UNION ALL SELECT 'validation', 2016, 2496 UNION ALL SELECT 'test', 2496, n FROM en),
r AS (SELECT unnest(range(95, n - 16)) AS o FROM en),
p AS (SELECT s.split, o - 95 AS history_start, o AS history_end, o AS origin, o + 1 AS target_start, o + 16 AS target_end FROM r LEFT JOIN s ON o + 1 >= s.a AND o + 16 < s.b)
"""


def _seen_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Split]:
    """The plan of the steps up to the last event."""
    split = _seen_split(spark, sf_dir)
    return windows.plan(spark, split.n_steps, split, SPEC), split


@query("window_plan_primary", PLAN + "SELECT * FROM p WHERE split IS NOT NULL")
def window_plan_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen_plan(spark, sf_dir)[0].where("split IS NOT NULL")


@query("window_plan_encoded", PLAN + "SELECT CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END::BIGINT AS split, history_start, history_end, origin, target_start, target_end FROM p WHERE split IS NOT NULL")
def window_plan_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.encode(_seen_plan(spark, sf_dir)[0])


COUNTS = STEPS_SEEN + """, y AS (SELECT (date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1) * 96 AS n FROM orders),
c AS (SELECT 'events_4h' AS task, n, 96 AS hist, 16 AS hor, 2016 AS v, 2496 AS t FROM en UNION ALL SELECT 'events_24h', n, 672, 96, 2016, 2496 FROM en
 UNION ALL SELECT 'orders_4h', n, 96, 16, CAST(floor(n * 0.7::DOUBLE) AS BIGINT), CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) FROM y
 UNION ALL SELECT 'orders_24h', n, 672, 96, CAST(floor(n * 0.7::DOUBLE) AS BIGINT), CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) FROM y),
o AS (SELECT c.*, unnest(range(hist - 1, n - hor)) AS o FROM c),
p AS (SELECT task, CASE WHEN o + hor < v THEN 'train' WHEN o + 1 >= v AND o + hor < t THEN 'validation' WHEN o + 1 >= t THEN 'test' ELSE 'dropped' END AS split FROM o)
SELECT task, split, count(*) AS n FROM p GROUP BY 1, 2"""


@query("window_counts_both_tasks", COUNTS)
def window_counts_both_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, orders = _seen_split(spark, sf_dir), fraction_split(96 * _order_days(spark, sf_dir)[1])
    tasks = {"events_4h": (seen, SPEC), "events_24h": (seen, SPEC_LONG), "orders_4h": (orders, SPEC), "orders_24h": (orders, SPEC_LONG)}
    return reduce(DataFrame.unionByName, [windows.counts(windows.plan(spark, s.n_steps, s, w)).select(F.lit(k).alias("task"), "split", "n") for k, (s, w) in tasks.items()])


@query(
    "leakage_audit",
    PLAN + """SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split IS NULL) AS n_dropped,
 bool_and(history_end < target_start AND target_start <= target_end) AS ordered,
 bool_and(split IS NULL OR (split = 'train' AND target_end < 2016) OR (split = 'validation' AND target_start >= 2016 AND target_end < 2496) OR (split = 'test' AND target_start >= 2496 AND target_end < (SELECT n FROM en))) AS contained,
 NOT EXISTS (SELECT t FROM (SELECT DISTINCT split, unnest(range(target_start, target_end + 1)) AS t FROM p WHERE split IS NOT NULL) GROUP BY t HAVING count(*) > 1) AS disjoint, true AS contiguous, true AS passed FROM p""",
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.audit(*_seen_plan(spark, sf_dir))


TASK = Task("events_4h", "primary", 96, 16)


@query(
    "materialize_windows",
    CUBE + ", o AS (SELECT origin FROM vo), w AS (SELECT origin, 'history' AS part, k::INT AS position, origin - 95 + k AS step FROM o CROSS JOIN range(96) r(k) UNION ALL SELECT origin, 'target', k::INT, origin + 1 + k FROM o CROSS JOIN range(16) r(k)) "
    "SELECT origin, part, position, w.step, bus, net_demand_p_mw, net_demand_q_mvar FROM w JOIN cube USING (step)",
)
def materialize_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = windows.for_split(windows.plan(spark, events.STEPS, events.SPLIT, SPEC), "validation")
    rows = windows.materialise(events.cube(spark, sf_dir), chosen, TASK)
    return rows.select("origin", "part", "position", "step", "bus", NET_P, NET_Q)


# --- scaling

TRAIN = CUBE + ", st AS (SELECT channel, bus, avg(v::DOUBLE) AS mean, stddev_pop(v::DOUBLE) AS sd, count(*) AS fit_rows FROM net WHERE step < 2016 GROUP BY 1, 2) "


def _scaler(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cube = events.cube(spark, sf_dir)
    return cube, scaling.fit(cube, events.SPLIT, [NET_P, NET_Q])


def _short(channel: str = "channel") -> Column:
    return F.when(F.col(channel) == NET_P, "net_p").otherwise("net_q").alias("channel")


@query("scaler_fit", TRAIN + "SELECT channel, bus, round(mean, 6) AS mean, round(CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END, 4) AS scale, sd <= 1e-12 AS is_constant, fit_rows FROM st")
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaler(spark, sf_dir)[1]
    return s.select(_short(), "bus", F.round("mean", 6).alias("mean"), F.round("scale", 4).alias("scale"), "is_constant", "fit_rows")


@query("scaler_transform", TRAIN + "SELECT step, net.bus, channel, round((v - mean) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END, 6) AS z FROM net JOIN st USING (channel, bus) WHERE step >= 2016 AND step < 2496")
def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube, s = _scaler(spark, sf_dir)
    z = scaling.transform(cube.where("step >= 2016 AND step < 2496"), s, [NET_P, NET_Q])
    return z.unpivot(["step", "bus"], [NET_P, NET_Q], "channel", "z").select("step", "bus", _short(), F.round("z", 6).alias("z"))


@query("activity_mask", CUBE + "SELECT channel, bus, active FROM act")
def activity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.activities(events.cube(spark, sf_dir), events.SPLIT, (NET_P, NET_Q)).select(_short(), "bus", "active")


# --- features


def _sql_lag(k: int, c: str) -> str:
    return f"lag({c}, {k}) OVER w"


@query(
    "lag_features",
    CUBE + "SELECT step, bus, " + ", ".join(f"{_sql_lag(k, c)} AS lag_{n}_{x}" for n, k in (("1h", 4), ("4h", 16), ("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q))) + " FROM cube WINDOW w AS (PARTITION BY bus ORDER BY step)",
)
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.origin_frame(events.cube(spark, sf_dir), kind="double")
    return own.select("step", "bus", *[x for x in own.columns if x.startswith("lag_")])


@query("target_lag_features", CUBE + "SELECT step, bus, " + ", ".join(f"{_sql_lag(k, c)} AS target_lag_{n}_{x}" for n, k in (("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q))) + " FROM cube WINDOW w AS (PARTITION BY bus ORDER BY step)")
def target_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.target_frame(events.cube(spark, sf_dir))


def _sql_mean(k: int, c: str) -> str:
    return f"CASE WHEN step >= {k - 1} THEN sum({c}) OVER (PARTITION BY bus ORDER BY step ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)::DOUBLE / {k} END"


@query("rolling_means", CUBE + "SELECT step, bus, " + ", ".join(f"round({_sql_mean(k, c)}, 6) + 0.0::DOUBLE AS mean_{n}_{x}" for n, k in (("4h", 16), ("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q))) + " FROM cube")
def rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.origin_frame(events.cube(spark, sf_dir), kind="double")
    means = [x for x in own.columns if x.startswith("mean_")]
    return rounded(own.select("step", "bus", *means), 6, *means)


@query("trend_4h", CUBE + "SELECT step, bus, " + ", ".join(f"round({c} - {_sql_mean(16, c)}, 6) + 0.0::DOUBLE AS trend_4h_{x}" for x, c in (("p", NET_P), ("q", NET_Q))) + " FROM cube")
def trend_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.origin_frame(events.cube(spark, sf_dir), kind="double").select("step", "bus", "trend_4h_p", "trend_4h_q")
    return rounded(own, 6, "trend_4h_p", "trend_4h_q")


STATIC_SQL = """, l AS (SELECT c_nationkey % 8 AS f, c_custkey % 8 AS t FROM customer), tr AS (SELECT s_nationkey % 8 AS f, s_suppkey % 11 AS t FROM supplier),
deg AS (SELECT b, (SELECT count(*) FROM l WHERE f = b) + (SELECT count(*) FROM l WHERE t = b) AS line_degree, (SELECT count(*) FROM tr WHERE f = b) + (SELECT count(*) FROM tr WHERE t = b) AS trafo_degree FROM range(8) r(b)),
st8 AS (SELECT b AS bus, b AS bus_pos, CAST(10 + b AS DOUBLE) AS vn_kv, line_degree::DOUBLE AS line_degree, trafo_degree::DOUBLE AS trafo_degree,
 (SELECT count(*) FROM customer WHERE c_custkey % 8 = b)::DOUBLE AS n_load, (SELECT count(*) FROM supplier WHERE s_suppkey % 8 = b)::DOUBLE AS n_sgen, (SELECT count(*) FROM part WHERE p_partkey % 4 = b)::DOUBLE AS n_storage,
 coalesce((SELECT sum(abs(CAST(round(c_acctbal * 100) AS BIGINT))) FROM customer WHERE c_custkey % 8 = b), 0)::DOUBLE AS installed_load_p_mw,
 coalesce((SELECT sum(abs(CAST(round(s_acctbal * 100) AS BIGINT))) FROM supplier WHERE s_suppkey % 8 = b), 0)::DOUBLE AS installed_sgen_p_mw,
 coalesce((SELECT sum(abs(CAST(p_size - 25 AS BIGINT))) FROM part WHERE p_partkey % 4 = b), 0)::DOUBLE AS installed_storage_abs_p_mw FROM deg)
"""


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are loads and line ends, suppliers are generators and transformers, parts are storages of four buses."""
    key = lambda x, n: (F.col(x) % n).cast("long")
    customer, supplier, part = (table(spark, sf_dir, x) for x in ("customer", "supplier", "part"))
    cents = lambda x: F.round(F.col(x) * 100)
    tables = {
        "bus": spark.range(events.BUSES).select(F.col("id").alias("element_id"), (F.col("id") + 10).cast("double").alias("vn_kv")),
        "line": customer.select(key("c_nationkey", 8).alias("from_bus"), key("c_custkey", 8).alias("to_bus")),
        "trafo": supplier.select(key("s_nationkey", 8).alias("hv_bus"), key("s_suppkey", 11).alias("lv_bus")),
        "load": customer.select(key("c_custkey", 8).alias("bus"), cents("c_acctbal").alias("p_mw")),
        "sgen": supplier.select(key("s_suppkey", 8).alias("bus"), cents("s_acctbal").alias("p_mw")),
        "storage": part.select(key("p_partkey", 4).alias("bus"), (F.col("p_size") - 25).cast("double").alias("p_mw")),
    }
    return features.static_features(tables, kind="double")


@query("static_bus_features", CUBE + STATIC_SQL + f"SELECT bus, bus_pos, {', '.join(STATIC)} FROM st8")
def static_bus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _static(spark, sf_dir)


MATRIX_SQL = (
    CUBE
    + STATIC_SQL
    + """, smp AS (SELECT i AS row_id, i // 128 AS window_index, (i // 16) % 8 AS bus_pos, i % 16 AS horizon_pos FROM range(59520) r(i)),
o AS (SELECT *, 2015 + window_index AS origin, 2016 + window_index + horizon_pos AS target_step FROM smp),
fr AS (SELECT step, bus, """
    + ", ".join([f"{c}::DOUBLE AS origin_{x}" for x, c in (("p", NET_P), ("q", NET_Q))])
    + ", "
    + ", ".join(f"{_sql_lag(k, c)}::DOUBLE AS lag_{n}_{x}" for n, k in (("1h", 4), ("4h", 16), ("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q)))
    + ", "
    + ", ".join(f"round({_sql_mean(k, c)}, 6) + 0.0::DOUBLE AS mean_{n}_{x}" for n, k in (("4h", 16), ("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q)))
    + ", "
    + ", ".join(f"round({c} - {_sql_mean(16, c)}, 6) + 0.0::DOUBLE AS trend_4h_{x}" for x, c in (("p", NET_P), ("q", NET_Q)))
    + " FROM cube WINDOW w AS (PARTITION BY bus ORDER BY step)), tg AS (SELECT step, bus, "
    + ", ".join(f"{_sql_lag(k, c)}::DOUBLE AS target_lag_{n}_{x}" for n, k in (("24h", 96), ("7d", 672)) for x, c in (("p", NET_P), ("q", NET_Q)))
    + """ FROM cube WINDOW w AS (PARTITION BY bus ORDER BY step)),
loc AS (SELECT step, timezone('Europe/Berlin', timezone('UTC', TIMESTAMP '2024-01-01' + INTERVAL 15 MINUTE * step)) AS l FROM range(2880) r(step)),
cal AS (SELECT step, round(sin(2 * pi() * (hour(l) * 60 + minute(l)) / 1440), 9) + 0.0::DOUBLE AS minute_sin, round(cos(2 * pi() * (hour(l) * 60 + minute(l)) / 1440), 9) + 0.0::DOUBLE AS minute_cos, round(sin(2 * pi() * (isodow(l) - 1) / 7), 9) + 0.0::DOUBLE AS weekday_sin,
 round(cos(2 * pi() * (isodow(l) - 1) / 7), 9) + 0.0::DOUBLE AS weekday_cos, round(sin(2 * pi() * (dayofyear(l) - 1) / 366), 9) + 0.0::DOUBLE AS year_sin, round(cos(2 * pi() * (dayofyear(l) - 1) / 366), 9) + 0.0::DOUBLE AS year_cos, 1.0::DOUBLE AS utc_offset_hours, 0.0::DOUBLE AS is_dst FROM loc)
SELECT o.row_id, o.origin, o.target_step, o.bus_pos::DOUBLE AS bus_pos, (o.horizon_pos + 1)::DOUBLE AS horizon_step, fr.* EXCLUDE (step, bus), tg.* EXCLUDE (step, bus), st8.* EXCLUDE (bus, bus_pos), cal.* EXCLUDE (step)
FROM o JOIN st8 ON st8.bus_pos = o.bus_pos JOIN fr ON fr.step = o.origin AND fr.bus = st8.bus JOIN tg ON tg.step = o.target_step AND tg.bus = st8.bus JOIN cal ON cal.step = o.target_step"""
)


@query("feature_matrix", MATRIX_SQL)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all validation windows."""
    a, _ = naive.target_range(events.SPLIT, "validation", SPEC)
    n = windows.count_windows(events.SPLIT, SPEC)["validation"]
    sample = features.with_windows(features.exhaustive_rows(spark, n, events.BUSES, SPEC.horizon), a - SPEC.lead, SPEC)
    calendar = timeaxis.calendar_table(timeaxis.generated_axis(spark, events.START, events.STEPS))
    rows = features.matrix(events.cube(spark, sf_dir), sample, _static(spark, sf_dir), calendar, kind="double").drop("bus")
    rows = rounded(rows, 9, *CALENDAR)
    return rounded(rows, 6, *[x for x in rows.columns if x.startswith(("mean_", "trend_"))])


@query("cartesian_decode", PLAN + "SELECT i AS row_id, i // 128 AS window_index, (i // 16) % 8 AS bus_pos, i % 16 AS horizon_pos FROM (SELECT unnest(range(n)) AS i FROM (SELECT count(*) * 128 AS n FROM p WHERE split = 'train'))")
def cartesian_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all training windows of the steps up to the last event."""
    n = windows.count_windows(_seen_split(spark, sf_dir), SPEC)["train"]
    return features.exhaustive_rows(spark, n, events.BUSES, SPEC.horizon)


# --- naive forecasts


def _forecast(baseline: naive.Baseline) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        naive.require_causal(baseline, SPEC, naive.target_range(events.SPLIT, "validation", SPEC)[0])
        cube = events.cube(spark, sf_dir)
        own = windows.for_split(windows.plan(spark, events.STEPS, events.SPLIT, SPEC), "validation")
        parts = [naive.forecasts(cube, own, baseline, c).select(F.lit(n).alias("channel"), "origin", "horizon", "bus", "y", "yhat") for c, n in NETS.items()]
        return parts[0].unionByName(parts[1])

    return run


def _naive_sql(baseline: naive.Baseline) -> str:
    """One baseline: the values at the targets, beside those at their sources."""
    source = "p.origin" if baseline.mode == "origin_constant" else f"n.step - {baseline.lag}"
    return CUBE + f""", few AS MATERIALIZED (SELECT * FROM net WHERE step BETWEEN 2015 - 672 AND 2496), pairs AS MATERIALIZED (SELECT origin, CAST(h AS INT) AS horizon, origin + 1 + h AS step FROM vo CROSS JOIN range(16) r(h)),
wanted AS MATERIALIZED (SELECT n.channel, p.origin, p.horizon, n.bus, n.v AS y, {source} AS source FROM pairs p JOIN few n ON n.step = p.step)
SELECT w.channel, w.origin, w.horizon, w.bus, w.y, s.v AS yhat FROM wanted w JOIN few s ON s.channel = w.channel AND s.bus = w.bus AND s.step = w.source"""


for _name, _baseline in (("naive_last_value", naive.LAST_VALUE), ("naive_daily", naive.DAILY), ("naive_weekly", naive.WEEKLY)):
    query(_name, _naive_sql(_baseline))(_forecast(_baseline))


@query(
    "source_causality_audit",
    PLAN + ", bl AS (SELECT * FROM (VALUES ('last_value_v1', 0), ('seasonal_24h_v1', 96), ('seasonal_7d_v1', 672)) t(baseline, lag)), sources AS (SELECT baseline, origin, CASE WHEN lag = 0 THEN origin ELSE origin + 1 + h - lag END AS src FROM p CROSS JOIN range(16) r(h) CROSS JOIN bl WHERE split IN ('validation', 'test')) "
    "SELECT baseline, count(*) AS n_sources, count(*) FILTER (WHERE src < 0) AS n_negative, count(*) FILTER (WHERE src > origin) AS n_future FROM sources GROUP BY 1",
)
def source_causality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all validation and test windows of the steps up to the last event."""
    own = _seen_plan(spark, sf_dir)[0].where("split IN ('validation', 'test')")
    return reduce(DataFrame.unionByName, [naive.audit_sources(own, b).select(F.lit(b.baseline_id).alias("baseline"), "*") for b in naive.BASELINES])


def _errors(spark: SparkSession, sf_dir: str, split: Split = events.SPLIT) -> tuple[DataFrame, DataFrame]:
    """Weighted error rows of all baselines and both channels, and the activity of the buses."""
    cube = events.cube(spark, sf_dir)
    rows = naive.error_rows(cube, split, "validation", SPEC, naive.BASELINES, (NET_P, NET_Q))
    return rows.withColumn("channel", _short()), scaling.activities(cube, split, (NET_P, NET_Q)).withColumn("channel", _short())


KEYS = ["channel", "baseline"]
E = "sum(abs(y - yhat))::DOUBLE / count(*) AS mae, sqrt(sum((y - yhat)::DOUBLE * (y - yhat)) / count(*)) AS rmse, CASE WHEN sum(abs(y)) > 1e-8 THEN sum(abs(y - yhat))::DOUBLE / sum(abs(y)) END AS wape, count(*) AS points"
R = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, points"
METRICS = ("mae", "rmse", "wape")


@query("metrics_bus_micro", CUBE + f", m AS (SELECT channel, baseline, {E} FROM fc GROUP BY 1, 2) SELECT channel, baseline, {R} FROM m")
def metrics_bus_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    return rounded(metrics.bus_micro(rows, KEYS, F.col("w")), 6, *METRICS)


@query(
    "metrics_bus_macro",
    CUBE + f", m AS (SELECT channel, baseline, bus, {E} FROM fc GROUP BY 1, 2, 3) SELECT channel, baseline, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(wape), 6) AS wape, CAST(sum(points) AS BIGINT) AS points, count(*) AS active_buses FROM m JOIN act USING (channel, bus) WHERE active GROUP BY 1, 2",
)
def metrics_bus_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, active = _errors(spark, sf_dir)
    return rounded(metrics.bus_macro(rows, active, KEYS, F.col("w")), 6, *METRICS)


@query("metrics_system", CUBE + f", t AS (SELECT channel, baseline, origin, horizon, sum(y) AS y, sum(yhat) AS yhat FROM fc GROUP BY 1, 2, 3, 4), m AS (SELECT channel, baseline, {E} FROM t GROUP BY 1, 2) SELECT channel, baseline, {R} FROM m")
def metrics_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    return rounded(metrics.system(rows, KEYS, ["step", "horizon"], F.col("w")), 6, *METRICS)


@query("metrics_horizon", CUBE + f", m AS (SELECT channel, baseline, horizon, {E} FROM fc GROUP BY 1, 2, 3) SELECT channel, baseline, horizon, {R} FROM m")
def metrics_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    return rounded(naive.horizon_metrics(rows, events.SPLIT, "validation", SPEC, KEYS), 6, *METRICS)


@query("metrics_horizon_arrays", CUBE + f", m AS (SELECT channel, baseline, horizon, {E} FROM fc GROUP BY 1, 2, 3) SELECT channel, baseline, string_agg(CAST(CAST(round(mae * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY horizon) AS mae_by_horizon FROM m GROUP BY 1, 2")
def metrics_horizon_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    each = naive.by_horizon(rows, events.SPLIT, "validation", SPEC, ["channel"])
    out = metrics.horizon_arrays(each, KEYS)
    return out.select(*KEYS, F.concat_ws(",", F.transform("mae", lambda x: F.round(x * 100).cast("long").cast("string"))).alias("mae_by_horizon"))


@query(
    "grouping_sets_metrics",
    CUBE + f", m AS (SELECT CASE grouping(bus, horizon) WHEN 3 THEN 'bus_micro' WHEN 1 THEN 'bus' ELSE 'horizon_step' END AS level, channel, bus, horizon, {E} FROM fc WHERE baseline = 'last_value_v1' GROUP BY GROUPING SETS ((channel), (channel, bus), (channel, horizon))) SELECT level, channel, bus, horizon, {R} FROM m",
)
def grouping_sets_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    return rounded(metrics.grouping_sets(rows.where("baseline = 'last_value_v1'"), ["channel"]), 6, *METRICS)


@query(
    "best_naive_skill",
    CUBE + f""", m AS (SELECT channel, baseline, {E} FROM fc GROUP BY 1, 2), b AS (SELECT channel, baseline AS best, mae AS best_mae FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY mae, CASE baseline WHEN 'last_value_v1' THEN 1 WHEN 'seasonal_24h_v1' THEN 2 ELSE 3 END) AS r FROM m) WHERE r = 1)
SELECT channel, baseline, best, round(CASE WHEN best_mae > 0 THEN 1 - mae / best_mae END, 6) AS skill FROM m JOIN b USING (channel)""",
)
def best_naive_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _errors(spark, sf_dir)
    scores = metrics.bus_micro(rows, KEYS, F.col("w"))
    best = metrics.best_naive_skill(scores, ["channel"], ORDER)
    return scores.join(best, "channel").select("channel", "baseline", "best", F.round(metrics.skill(F.col("mae"), F.col("best_mae")), 6).alias("skill"))


# --- probabilistic metrics

QS = [(metrics.label(x), x) for x in QUANTILES]
QUANT = CUBE + """, r AS (SELECT bus, step % 96 AS slot, net_demand_p_mw AS v, row_number() OVER (PARTITION BY bus, step % 96 ORDER BY net_demand_p_mw) AS rn, count(*) OVER (PARTITION BY bus, step % 96) AS n FROM cube WHERE step < 2016),
qf AS (SELECT bus, slot, """ + ", ".join(f"max(CASE WHEN rn = CAST(ceil(n * {x}::DOUBLE) AS BIGINT) THEN v END) AS {k}" for k, x in QS) + """ FROM r GROUP BY 1, 2),
pr AS (SELECT c.step, c.bus, c.net_demand_p_mw AS y, """ + ", ".join(k for k, _ in QS) + " FROM cube c JOIN qf ON qf.bus = c.bus AND qf.slot = c.step % 96 WHERE c.step >= 2016 AND c.step < 2496) "


def _quantile_forecast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order statistics of the training values of each bus and time of day, and the validation rows with them."""
    cube = events.cube(spark, sf_dir).select("step", "bus", F.col(NET_P).alias("y"), (F.col("step") % 96).alias("slot"))
    slot = Window.partitionBy("bus", "slot")
    ranked = cube.where("step < 2016").select("bus", "slot", "y", F.row_number().over(slot.orderBy("y")).alias("rn"), F.count("*").over(slot).alias("n"))
    stats = ranked.groupBy("bus", "slot").agg(*[F.max(F.when(F.col("rn") == F.ceil(F.col("n") * F.lit(x)), F.col("y"))).alias(k) for k, x in QS])
    return stats, cube.where("step >= 2016 AND step < 2496").join(stats, ["bus", "slot"])


@query("quantile_forecast_train", QUANT + "SELECT bus, slot, " + ", ".join(k for k, _ in QS) + " FROM qf")
def quantile_forecast_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_forecast(spark, sf_dir)[0]


PROB = "sum(CASE WHEN y >= q05 AND y <= q95 THEN 1 ELSE 0 END)::DOUBLE / count(*)"


def _sql_pinball(k: str, x: float) -> str:
    return f"avg(greatest((y - {k}) * {x}::DOUBLE, (y - {k}) * ({x}::DOUBLE - 1)))"


@query("pinball_by_quantile", QUANT + ", m AS (SELECT bus, " + ", ".join(f"{_sql_pinball(k, x)} AS pinball_{k}" for k, x in QS) + " FROM pr GROUP BY 1) SELECT bus, " + ", ".join(f"round(pinball_{k}, 7) AS pinball_{k}" for k, _ in QS) + ", round((" + " + ".join(f"pinball_{k}" for k, _ in QS) + ") / 7, 7) AS mean_pinball FROM m")
def pinball_by_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.probabilistic(_quantile_forecast(spark, sf_dir)[1], QUANTILES, (0.05, 0.95), ["bus"])
    names = [f"pinball_{k}" for k, _ in QS] + ["mean_pinball"]
    return rounded(out.select("bus", *names), 7, *names)


@query("interval_coverage_width", QUANT + f"SELECT bus, round({PROB}, 6) AS coverage, round(sum(q95 - q05)::DOUBLE / count(*), 6) AS width, round(abs({PROB} - 0.9::DOUBLE), 6) AS abs_coverage_error, count(*) AS points FROM pr GROUP BY 1")
def interval_coverage_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.probabilistic(_quantile_forecast(spark, sf_dir)[1], QUANTILES, (0.05, 0.95), ["bus"])
    return rounded(out.select("bus", "coverage", "width", "abs_coverage_error", "points"), 6, "coverage", "width", "abs_coverage_error")


CROSS = QUANT + ", k AS (SELECT step, bus, y, q05, q10 + CASE WHEN step % 5 = 0 THEN 100000 ELSE 0 END AS q10, q25, q50, q75, q90, q95 FROM pr) "


@query("quantile_crossing", CROSS + "SELECT bus, round(sum(" + " + ".join(f"CASE WHEN {a} > {b} THEN 1 ELSE 0 END" for (a, _), (b, _) in zip(QS, QS[1:], strict=False)) + ")::DOUBLE / (count(*) * 6), 6) AS crossing_rate FROM k GROUP BY 1")
def quantile_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quantile is spoiled at every fifth step, so that something crosses."""
    rows = _quantile_forecast(spark, sf_dir)[1].withColumn("q10", F.col("q10") + F.when(F.col("step") % 5 == 0, 100000).otherwise(0))
    return rounded(metrics.probabilistic(rows, QUANTILES, (0.05, 0.95), ["bus"]).select("bus", "crossing_rate"), 6, "crossing_rate")


@query("interval_score", QUANT + "SELECT round((sum(q95 - q05) + 20 * sum(CASE WHEN y < q05 THEN q05 - y WHEN y > q95 THEN y - q95 ELSE 0 END))::DOUBLE / count(*), 4) AS score FROM pr")
def interval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantile_forecast(spark, sf_dir)[1]
    return rounded(metrics.interval_score(rows, 0.1, "y", "q05", "q95"), 4, "score")


@query("scalar_metrics", CUBE + "SELECT round(sum(abs(y - yhat))::DOUBLE / count(*), 6) AS mae, round(sqrt(sum((y - yhat)::DOUBLE * (y - yhat)) / count(*)), 6) AS rmse, round(avg(greatest((y - yhat) * 0.9::DOUBLE, (y - yhat) * (0.9::DOUBLE - 1))), 4) AS pinball FROM fc WHERE channel = 'net_p' AND baseline = 'seasonal_24h_v1'")
def scalar_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecast(naive.DAILY)(spark, sf_dir).where("channel = 'net_p'")
    values = {"mae": metrics.mae_value(), "rmse": metrics.rmse_value(), "pinball": metrics.pinball_value(0.9)}
    out = metrics.measured(rows, ["y", "yhat"], values)  # rules and values in one pass
    return rounded(rounded(out, 6, "mae", "rmse"), 4, "pinball")


# --- conformal intervals

CONF = CUBE + """, dy AS (SELECT a.bus, a.step, a.net_demand_p_mw AS y, b.net_demand_p_mw AS yhat FROM cube a JOIN cube b ON b.bus = a.bus AND b.step = a.step - 96),
rs AS (SELECT bus, abs(y - yhat) AS r, row_number() OVER (PARTITION BY bus ORDER BY abs(y - yhat)) AS rn, count(*) OVER (PARTITION BY bus) AS n FROM dy WHERE step >= 1920 AND step < 2016),
rad AS (SELECT bus, r AS radius, n FROM rs WHERE rn = least(CAST(ceil((n::DOUBLE + 1) * (1 - 0.1::DOUBLE)) AS BIGINT) + 1, n)),
cf AS (SELECT dy.bus, step, y, yhat - radius AS lo, yhat + radius AS hi FROM dy JOIN rad ON rad.bus = dy.bus WHERE step >= 2016 AND step < 2496) """


def _conformal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The radius of each bus from the last training day, and the validation rows with their intervals."""
    own = features.stretched(events.cube(spark, sf_dir).select("step", "bus", F.col(NET_P).alias("y")), 96)
    rows = features.at_home(own.withColumn("yhat", features.lagged("y", 96)))
    radii = conformal.radius(rows.where("step >= 1920 AND step < 2016"), 0.1, ["bus"])
    own = rows.where("step >= 2016 AND step < 2496").join(radii.select("bus", "radius"), "bus")
    return radii, conformal.interval(own, "radius").select("step", "bus", "y", "lo", "hi")


@query("conformal_radius", CONF + "SELECT bus, radius, n FROM rad")
def conformal_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformal(spark, sf_dir)[0]


@query(
    "conformal_radius_all",
    "WITH r AS (SELECT abs(l_extendedprice - 1000 * l_quantity) AS r FROM lineitem), o AS (SELECT r, row_number() OVER (ORDER BY r) AS rn, count(*) OVER () AS n FROM r) "
    "SELECT r AS radius, n FROM o WHERE rn = least(CAST(ceil((n::DOUBLE + 1) * (1 - 0.1::DOUBLE)) AS BIGINT) + 1, n)",
)
def conformal_radius_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One radius for all lines, with a thousand a piece as the forecast of the price."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1000 * F.col("l_quantity")).alias("yhat"))
    return conformal.radius(rows, 0.1)


# --- scans, sweeps and interval joins


@query("prefix_sums", CUBE + "SELECT bus, step, prefix FROM (SELECT bus, step + 1 AS step, CAST(sum(net_demand_p_mw) OVER (PARTITION BY bus ORDER BY step) AS BIGINT) AS prefix FROM cube UNION ALL SELECT DISTINCT bus, 0, 0 FROM cube)")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums before each step of each bus, from 0 to the whole, over stretches of 512 steps."""
    return scan.prefix_sums(events.cube(spark, sf_dir), "step", NET_P, ["bus"], stretch=512)


@query("stable_totals", "SELECT l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount) * 0.01::DOUBLE), 3) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def stable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles that do not depend on the order of the lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.01).alias("total"))
    return rounded(scan.stable_sums(rows, "total", ["flag"]), 3, "total")


_OWNED = """WITH ev AS (SELECT DISTINCT CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) // 900 AS BIGINT) AS step, user_id FROM events WHERE event_type = 'purchase'),
w AS (SELECT CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, step + 1 AS target_start, step + 2 AS target_end FROM ev WHERE user_id % 97 < 9)"""


@query(
    "shared_target_steps",
    _OWNED + """, t AS (SELECT t FROM (SELECT DISTINCT split, unnest(range(target_start, target_end + 1)) AS t FROM w) GROUP BY t HAVING count(*) > 1)
SELECT min(t) AS start, max(t) AS "end" FROM (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM t) GROUP BY g""",
)
def shared_target_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows behind purchases, dealt to splits by user, so that splits interleave: the stretches of steps that are targets of two."""
    own = table(spark, sf_dir, "events").where("event_type = 'purchase' AND user_id % 97 < 9")
    step = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{events.START}', ts) div 900").cast("long")
    split = F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "validation").otherwise("test")
    return scan.shared_steps(own.select(split.alias("split"), (step + 1).alias("a"), (step + 2).alias("z")).distinct(), "split", "a", "z", stretch=256)


_FOLDS = CUBE + """, folds AS (SELECT user_id AS fold, min(step) AS a, min(step) + 200 AS b FROM (SELECT user_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 900) AS BIGINT) AS step FROM events) GROUP BY 1),
w AS (SELECT DISTINCT step + 1 AS target_start, step + 16 AS target_end FROM ev)
SELECT fold, count(*) AS n_windows, CAST(min(target_start) AS BIGINT) AS first, CAST(max(target_end) AS BIGINT) AS last FROM w JOIN folds ON target_start >= a AND target_end < b GROUP BY 1"""


@query("windows_of_folds", _FOLDS)
def windows_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold for each user, 200 steps from its first event: the windows behind events that lie in each."""
    step = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{events.START}', ts) div 900").cast("long")
    folds = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fold")).agg(F.min(step).alias("start")).withColumn("end", F.col("start") + 200)
    own = events.elements(spark, sf_dir).select((F.col("step") + 1).alias("first"), (F.col("step") + 16).alias("last")).distinct()
    return scan.contained_in(own, "first", "last", folds, bucket=100).groupBy("fold").agg(F.count("*").alias("n_windows"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("conformal_interval", CONF + "SELECT step, bus, y, lo, hi FROM cf")
def conformal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformal(spark, sf_dir)[1]


@query("conformal_coverage", CONF + "SELECT round(sum(CASE WHEN y >= lo AND y <= hi THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS coverage, round(sum(hi - lo)::DOUBLE / count(*), 6) AS width FROM cf")
def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conformal(spark, sf_dir)[1]
    return rounded(conformal.coverage(rows).crossJoin(metrics.mean_interval_width(rows)), 6, "coverage", "width")  # one row each


# --- shifts


@query("sensor_dropout", CUBE + ", d AS (SELECT step, bus, net_demand_p_mw AS v, CAST('0x' || substr(md5('7:' || step || ':' || bus), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE >= 0.25 AS observed FROM cube) SELECT bus, count(*) FILTER (WHERE observed) AS n_observed, count(*) AS n, CAST(sum(CASE WHEN observed THEN v END) AS BIGINT) AS total FROM d GROUP BY 1")
def sensor_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shifts.sensor_dropout(events.cube(spark, sf_dir), NET_P, 0.25, 7)
    return out.groupBy("bus").agg(F.count_if("observed").alias("n_observed"), F.count("*").alias("n"), F.sum(NET_P).alias("total"))


@query("der_scaling", CUBE + "SELECT step, bus, sgen_p_mw * 3 AS sgen_p_mw, load_p_mw + storage_p_mw - 3 * sgen_p_mw - gen_p_mw AS net_demand_p_mw, net_demand_q_mvar FROM cube")
def der_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifts.scale_der(events.cube(spark, sf_dir), 3.0).select("step", "bus", "sgen_p_mw", NET_P, NET_Q)


# --- decisions and physics


@query("decision_regret", "SELECT o_orderpriority AS kind, CAST(sum(greatest(0, cost - oracle)) AS BIGINT) AS regret, count(*) AS n FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cost, CAST(round(o_totalprice * 100) AS BIGINT) - (o_orderkey % 7) * 100 AS oracle FROM orders) GROUP BY 1")
def decision_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.round(F.col("o_totalprice") * 100)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), cost.alias("cost"), (cost - (F.col("o_orderkey") % 7) * 100).alias("oracle"))
    return metrics.decision_regret(rows).groupBy("kind").agg(F.sum(F.col("regret").cast("long")).alias("regret"), F.count("*").alias("n"))


@query("violation_rate", "SELECT round(sum(CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS violation_rate FROM lineitem")
def violation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.violation_rate(table(spark, sf_dir, "lineitem").select("l_quantity"), 10, 40, "l_quantity"), 6, "violation_rate")


@query("binding_constraints", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE abs(CASE WHEN l_linenumber = 3 THEN 1 ELSE l_discount END) <= 1e-5) AS n_binding FROM lineitem GROUP BY 1")
def binding_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are constraints, discounts their slack; third lines have none."""
    slack = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", slack.alias("slack"))).alias("constraints"))
    return physics.binding_constraints(rows).select("l_orderkey", F.size("constraints").cast("long").alias("n"), F.size("binding").cast("long").alias("n_binding"))


@query("branch_loss", "SELECT 'line' AS branch, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS loss FROM lineitem UNION ALL SELECT 'trafo', CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) - o_custkey) AS BIGINT) FROM orders")
def branch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems have a loss column, orders only flows into both ends."""
    line = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_tax") * 100).alias("pl_mw"))
    trafo = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") * 100).alias("p_hv_mw"), (-F.col("o_custkey")).alias("p_lv_mw"))
    return physics.branch_loss({"line": line, "trafo": trafo}).withColumn("loss", F.col("loss").cast("long"))


PEAK = CUBE + ", ld AS (SELECT step AS pos, sum(load_p_mw) AS total FROM cube GROUP BY 1), gn AS (SELECT step AS pos, sum(sgen_p_mw + gen_p_mw) AS total FROM cube GROUP BY 1) "


def _peaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cube = events.cube(spark, sf_dir).withColumnRenamed("step", "pos")
    return cube.select("pos", F.col("load_p_mw").alias("value")), cube.select("pos", (F.col("sgen_p_mw") + F.col("gen_p_mw")).alias("value"))


@query("peak_positions", PEAK + "(SELECT 'generation' AS kind, pos, CAST(total AS BIGINT) AS total FROM gn ORDER BY total DESC, pos LIMIT 1) UNION ALL (SELECT 'load', pos, CAST(total AS BIGINT) FROM ld ORDER BY total DESC, pos LIMIT 1)")
def peak_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [physics.peak_step(x).select(F.lit(k).alias("kind"), "pos", "total") for k, x in zip(("load", "generation"), _peaks(spark, sf_dir), strict=True)]
    return parts[0].unionByName(parts[1])


@query("validation_positions", PEAK + "SELECT DISTINCT pos FROM (SELECT unnest([0, 720, 1440, 2160, 2879])::BIGINT AS pos UNION ALL (SELECT pos FROM gn ORDER BY total DESC, pos LIMIT 1) UNION ALL (SELECT pos FROM ld ORDER BY total DESC, pos LIMIT 1))")
def validation_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = timeaxis.generated_axis(spark, events.START, events.STEPS).withColumnRenamed("step", "pos")
    return physics.validation_positions(axis, *_peaks(spark, sf_dir))


@query(
    "snapshot_summary",
    CUBE + """SELECT step AS position, CAST(sum(load_p_mw) AS BIGINT) AS total_load_p_mw, CAST(sum(load_q_mvar) AS BIGINT) AS total_load_q_mvar, CAST(sum(sgen_p_mw) AS BIGINT) AS total_sgen_p_mw, 1.0 + min(bus) / 64.0::DOUBLE AS min_vm_pu, 1.0 + max(bus) / 64.0::DOUBLE AS max_vm_pu,
 max(abs(net_demand_p_mw))::DOUBLE AS max_line_loading_percent, CAST(sum(gen_p_mw) - sum(storage_p_mw) AS BIGINT) AS active_branch_loss_mw, CAST(sum(load_p_mw) + sum(gen_p_mw) - sum(storage_p_mw) AS BIGINT) AS active_balance_residual_mw FROM cube GROUP BY 1""",
)
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as results of a solver: every step is a snapshot, lines lose what is generated, trafos have flows alone."""
    from ..operators import snapshots

    parts = {("res_load", "p_mw"): "load_p_mw", ("res_load", "q_mvar"): "load_q_mvar", ("res_sgen", "p_mw"): "sgen_p_mw", ("res_line", "pl_mw"): "gen_p_mw", ("res_trafo", "p_from_mw"): "-2 * storage_p_mw", ("res_trafo", "p_to_mw"): "storage_p_mw"}
    parts |= {("res_bus", "p_mw"): "load_p_mw", ("res_bus", "vm_pu"): "1 + bus / 64", ("res_line", "loading_percent"): f"abs({NET_P})"}
    each = [F.struct(F.lit(t).alias("result"), F.lit(n).alias("name"), F.expr(x).cast("double").alias("value")) for (t, n), x in parts.items()]
    results = events.cube(spark, sf_dir).select(F.col("step").alias("position"), F.col("bus").alias("element_id"), F.explode(F.array(*each)).alias("x")).select("position", "element_id", "x.*")
    whole = ("total_load_p_mw", "total_load_q_mvar", "total_sgen_p_mw", "active_branch_loss_mw", "active_balance_residual_mw")
    return snapshots.summary(results).select("position", *[F.col(x).cast("long").alias(x) for x in whole], "min_vm_pu", "max_vm_pu", "max_line_loading_percent")


@query("missing_groups_except", "SELECT * FROM (VALUES ('load'), ('powerplants'), ('renewables'), ('storage'), ('view'), ('click')) t(name) EXCEPT SELECT DISTINCT event_type FROM events")
def missing_groups_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([(x,) for x in ("load", "powerplants", "renewables", "storage", "view", "click")], "name string")
    return checks.missing_from(required, table(spark, sf_dir, "events").select(F.col("event_type").alias("name")))


@query("voltage_delta_join", "SELECT CAST(max(abs(a.p_size - b.s)) AS BIGINT) AS max_abs_delta, round(avg(abs(a.p_size - b.s)), 6) AS mean_abs_delta, count(*) AS n FROM part a JOIN (SELECT s_suppkey AS k, s_nationkey AS s FROM supplier) b ON b.k = a.p_partkey")
def voltage_delta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_size").alias("vm_pu"))
    repaired = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("element_id"), F.col("s_nationkey").alias("vm_pu"))
    out = physics.voltage_delta(raw, repaired)
    return out.select(F.col("max_abs_delta").cast("long").alias("max_abs_delta"), F.round("mean_abs_delta", 6).alias("mean_abs_delta"), "n")


@query("schema_alignment", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT p_partkey AS k FROM part) a FULL JOIN (SELECT DISTINCT s_suppkey * 2 AS k FROM supplier) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def schema_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.differing_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("k")), "k")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "series_fingerprint",
    CUBE + ", d AS (SELECT channel, bus, sha256(string_agg(CAST(cents AS VARCHAR), ',' ORDER BY step)) AS x FROM (UNPIVOT cube ON " + all_channels() + " INTO NAME channel VALUE cents) GROUP BY 1, 2) SELECT sha256(string_agg(channel || ':' || bus || ':' || x, chr(10) ORDER BY channel, bus)) AS fingerprint, count(*) AS n FROM d",
)
def series_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..artifacts import series_fingerprint as digest

    return digest(events.cube(spark, sf_dir), CHANNELS)


# --- further operators


@query("events_outside_axis", CUBE + "SELECT event_type, count(*) AS n FROM ev WHERE step < 0 OR step >= 2880 GROUP BY 1")
def events_outside_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.outside(spark, sf_dir)


@query(
    "naive_levels",
    CUBE + f""", mi AS (SELECT channel, baseline, {E} FROM fc GROUP BY 1, 2), bu AS (SELECT channel, baseline, bus, {E} FROM fc GROUP BY 1, 2, 3), ho AS (SELECT channel, baseline, horizon, {E} FROM fc GROUP BY 1, 2, 3),
sy AS (SELECT channel, baseline, {E} FROM (SELECT channel, baseline, origin, horizon, sum(y) AS y, sum(yhat) AS yhat FROM fc GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
ma AS (SELECT channel, baseline, avg(mae) AS mae, avg(rmse) AS rmse, avg(wape) AS wape, CAST(sum(points) AS BIGINT) AS points, count(*) AS active_buses FROM bu JOIN act USING (channel, bus) WHERE active GROUP BY 1, 2)
SELECT 'bus_micro' AS level, channel, baseline, NULL::INT AS horizon, {R}, NULL::BIGINT AS active_buses FROM mi UNION ALL SELECT 'bus_macro_active', channel, baseline, NULL, {R}, active_buses FROM ma
UNION ALL SELECT 'system_aggregate', channel, baseline, NULL, {R}, NULL FROM sy UNION ALL SELECT 'horizon_step', channel, baseline, horizon, {R}, NULL FROM ho""",
)
def naive_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark of all naive forecasts: every channel, baseline and level, as one plan."""
    from .benchmark import naive_benchmark

    rows = naive_benchmark(events.cube(spark, sf_dir), events.SPLIT, (TASK,))
    return rounded(rows.withColumn("channel", _short()).select("level", "channel", "baseline", "horizon", *METRICS, "points", "active_buses"), 6, *METRICS)


@query("target_vector", CUBE + "SELECT vo.origin, tgt.step AS target_step, tgt.bus, tgt.v::DOUBLE AS y FROM vo CROSS JOIN range(16) h(h) JOIN net tgt ON tgt.step = vo.origin + 1 + h.h AND tgt.channel = 'net_q'")
def target_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of all rows of all validation windows."""
    n = windows.count_windows(events.SPLIT, SPEC)["validation"]
    rows = features.with_windows(features.exhaustive_rows(spark, n, events.BUSES, SPEC.horizon), 2015, SPEC)
    return features.target_vector(rows.withColumn("bus", F.col("bus_pos")), events.cube(spark, sf_dir), NET_Q).select("origin", "target_step", "bus", "y")


@query("partition_bounds", _bounds("0.6::DOUBLE", "0.6::DOUBLE + 0.2::DOUBLE"))
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_table(spark, partition_split(_steps_seen(spark, sf_dir)))


@query("scaler_task", CUBE + "SELECT channel, bus, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) <= 1e-12 THEN 1 ELSE stddev_pop(v) END, 4) AS scale, count(*) AS fit_rows FROM (SELECT bus, 'load_p_mw' AS channel, load_p_mw::DOUBLE AS v FROM cube WHERE step < 2016 UNION ALL SELECT bus, 'net_demand_p_mw', net_demand_p_mw::DOUBLE FROM cube WHERE step < 2016) GROUP BY 1, 2")
def scaler_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and target channels of a task, each once."""
    task = Task("own", "primary", 96, 16, history_channels=("load_p_mw", NET_P), target_channels=(NET_P,))
    return rounded(rounded(scaling.fit_task(events.cube(spark, sf_dir), events.SPLIT, task), 6, "mean"), 4, "scale").drop("is_constant")


@query("assigned_row", "SELECT s_suppkey AS element_id, s_nationkey AS bus, CAST(s_suppkey * 10 + 3 AS BIGINT) AS p_mw FROM supplier")
def assigned_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their power set to the values at the third of five positions."""
    supplier = table(spark, sf_dir, "supplier")
    elements = supplier.select(F.col("s_suppkey").alias("element_id"), F.col("s_nationkey").alias("bus"), F.col("s_acctbal").alias("p_mw"))
    values = supplier.select(F.col("s_suppkey").alias("element_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).withColumn("value", F.col("element_id") * 10 + F.col("pos"))
    return cubes.assign_row(elements, values, "p_mw", 3)


@query("voltage_summary", "SELECT 1 + min(p_size) / 64.0::DOUBLE AS min_vm_pu, 1 + max(p_size) / 64.0::DOUBLE AS max_vm_pu FROM part WHERE p_size % 3 <> 0")
def voltage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are buses; those of some sizes are out of service, and of others it is not known."""
    part = table(spark, sf_dir, "part")
    bus = part.select(F.col("p_partkey").alias("element_id"), F.when(F.col("p_size") % 3 == 0, False).when(F.col("p_size") % 3 == 2, True).alias("in_service"))
    return physics.voltage_summary(part.select(F.col("p_partkey").alias("element_id"), (1 + F.col("p_size") / 64).alias("vm_pu")), bus)


@query("snapshot_times", AXIS + "SELECT step AS position, strftime(l, '%d.%m.%Y %H:%M') AS local_time, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') AS utc_time FROM loc")
def snapshot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw local and UTC time of every quarter-hour of the days with an order."""
    from ..operators import snapshots

    axis = _order_axis(spark, sf_dir).withColumnRenamed("step", "pos")
    raw = axis.select("pos", F.date_format(F.from_utc_timestamp("t_utc", timeaxis.ZONE), "dd.MM.yyyy HH:mm").alias("time"))
    return snapshots.times(raw, axis, axis.select(F.col("pos").alias("position")))


@query("safe_aggregates", "SELECT CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS total, CAST(max(l_quantity) AS DOUBLE) AS largest, 0.0::DOUBLE AS no_column, 0.0::DOUBLE AS no_rows FROM lineitem")
def safe_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_tax") * 100))
    row = physics.safe_sum(line, "cents"), physics.safe_max(line, "l_quantity"), physics.safe_sum(line, "none"), physics.safe_max(line.where("l_quantity < 0"), "l_quantity")
    return spark.createDataFrame([row], "total double, largest double, no_column double, no_rows double")


# --- learned forecasts

#: Trees of each model in the two queries of forecasts; the configuration has 300 (the README has their times).
TREES = 30


#: Lines are rows of four features in bins (the flag is nominal) and gradients, the negative prices in whole units.
SPLIT_SETTINGS = {"leaves": 3, "min_rows": 50, "reg_lambda": 1.0}
_FIRST_SPLITS = """
WITH line AS (SELECT l_orderkey, l_linenumber, -CAST(floor(l_extendedprice) AS BIGINT) AS g,
       [CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER), CAST(round(l_tax * 100) AS INTEGER), CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END] AS bins FROM lineitem),
{levels}
SELECT node, feature, bin, g, n, gain, left_value, right_value FROM {last} ORDER BY node
"""
_SPLIT_OF = """
{h} AS (SELECT node, feature, bin, sum(g)::DOUBLE AS g, count(*)::DOUBLE AS n FROM (SELECT node, g, unnest(bins) AS bin, unnest(range(4)) AS feature FROM {rows}) GROUP BY ALL),
{h}_placed AS (SELECT *, CASE WHEN feature = 3 THEN g / (n + 1.0) ELSE bin END AS place FROM {h}),
{h}_sums AS (SELECT node, feature, bin, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER a AS g, sum(n) OVER a AS n, list(bin) OVER w AS bins_left FROM {h}_placed
       WINDOW w AS (PARTITION BY node, feature ORDER BY place, bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, feature)),
{h}_gains AS (SELECT *, gl * gl / (nl + 1.0) + (g - gl) * (g - gl) / (n - nl + 1.0) - g * g / (n + 1.0) AS gain FROM {h}_sums WHERE nl >= 50 AND n - nl >= 50),
{h}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, CASE WHEN feature = 3 THEN len(bins_left) ELSE bin END) AS nth FROM {h}_gains) WHERE nth = 1)"""
_LEVELS = ",".join([
    "first AS (SELECT 1 AS node, g, bins FROM line)",
    _SPLIT_OF.format(h="one", rows="first"),
    "second AS (SELECT CASE WHEN CASE WHEN b.feature = 3 THEN list_contains(b.bins_left, f.bins[4]) ELSE f.bins[b.feature + 1] <= b.bin END THEN 2 ELSE 3 END AS node, f.g, f.bins FROM first f CROSS JOIN one_best b)",
    _SPLIT_OF.format(h="two", rows="second"),
    "found AS (SELECT * FROM one_best UNION ALL SELECT * FROM (SELECT * FROM two_best ORDER BY gain DESC, node LIMIT 1))",
    "named AS (SELECT node::BIGINT AS node, feature::INTEGER AS feature, bin::INTEGER AS bin, g, n::BIGINT AS n, round(gain, 3) AS gain, round(-gl / (nl + 1.0), 6) AS left_value, round(-(g - gl) / (n - nl + 1.0), 6) AS right_value FROM found)",
])


@query("gbt_first_splits", _FIRST_SPLITS.format(levels=_LEVELS, last="named"))
def gbt_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two splits of a tree of three leaves over all lines, with the values of their sides: grouped histograms, best-first growth."""
    from .. import boosting

    line = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    bins = F.array(F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"), flag)
    rows = line.select(bins.alias("bins"), (-F.floor("l_extendedprice")).cast("long").alias("g"))
    growth = boosting.Growth(**SPLIT_SETTINGS)
    root, out = boosting.grow(rows, growth, nominal=(3,)), []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.children:
            s = node.split
            values = [-x.g / (x.n + growth.reg_lambda) for x in node.children]
            out.append((node.name, s["feature"], s["bin"], float(s["g"]), s["n"], round(s["gain"], 3), *[round(v, 6) for v in values]))
            stack += node.children
    return spark.createDataFrame(out, "node long, feature int, bin int, g double, n long, gain double, left_value double, right_value double")


def _models(spark: SparkSession, sf_dir: str, quantiles: tuple[float, ...], trees: int) -> tuple[DataFrame, DataFrame]:
    """Both channels, fitted on the whole sample that the configuration draws, and scored on all validation windows."""
    from .. import models
    from ..contract import Contract

    cube, static = events.cube(spark, sf_dir), _static(spark, sf_dir)
    calendar = timeaxis.calendar_table(timeaxis.generated_axis(spark, events.START, events.STEPS))
    contract, config = Contract(), models.Config(trees=trees)
    bundle = models.fit(cube, events.SPLIT, static, calendar, contract=contract, config=config, quantiles=quantiles)
    return cube, models.predict(bundle, cube, events.SPLIT, static, calendar, contract=contract)


@query("gbt_point_validation")
def gbt_point_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error levels of the point models of both channels, of TREES trees each."""
    from .. import models

    cube, rows = _models(spark, sf_dir, (), TREES)
    return reduce(DataFrame.unionByName, [models.evaluate(rows, cube, events.SPLIT, c).withColumn("channel", F.lit(n)) for c, n in NETS.items()])


@query("gbt_quantile_validation")
def gbt_quantile_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball, coverage and crossings of all boosted quantiles of both channels, of TREES trees each."""
    _, rows = _models(spark, sf_dir, QUANTILES, TREES)
    return metrics.probabilistic(rows, QUANTILES, (0.05, 0.95), ["channel"])
