"""Fixed schemas and constants. Schemas are asserted, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: channel names, in contractual order
CHANNELS = ("load_p_mw", "load_q_mvar", "sgen_p_mw", "gen_p_mw", "storage_p_mw", "net_demand_p_mw", "net_demand_q_mvar")
BASE_CHANNELS = CHANNELS[:5]
NET_P, NET_Q = CHANNELS[5:]

# --- fixed values: calendar features, in contractual order
CALENDAR = ("minute_sin", "minute_cos", "weekday_sin", "weekday_cos", "year_sin", "year_cos", "utc_offset_hours", "is_dst")

# --- fixed values: static features of a bus, in contractual order
STATIC = ("vn_kv", "line_degree", "trafo_degree", "n_load", "n_sgen", "n_storage", "installed_load_p_mw", "installed_sgen_p_mw", "installed_storage_abs_p_mw")

#: Lags in steps behind the origin, lags behind the target, and lengths of rolling means; steps of 15 minutes.
ORIGIN_LAGS = {"1h": 4, "4h": 16, "24h": 96, "7d": 672}
TARGET_LAGS = {"24h": 96, "7d": 672}
MEANS = {"4h": 16, "24h": 96, "7d": 672}
QUANTITIES = ("p", "q")

#: The feature matrix's columns follow from the above.
FEATURES = (
    "bus_pos",
    "horizon_step",
    *[f"origin_{x}" for x in QUANTITIES],
    *[f"lag_{name}_{x}" for name in ORIGIN_LAGS for x in QUANTITIES],
    *[f"target_lag_{name}_{x}" for name in TARGET_LAGS for x in QUANTITIES],
    *[f"mean_{name}_{x}" for name in MEANS for x in QUANTITIES],
    *[f"trend_4h_{x}" for x in QUANTITIES],
    *STATIC,
    *CALENDAR,
)
CATEGORICAL = ("bus_pos",)

STEP_SECONDS = 900
SPLITS = ("train", "validation", "test")
QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
ACTIVITY_EPSILON = 1e-8
SCALE_EPSILON = 1e-12
BALANCE_TOLERANCE = 1e-6

CUBE = T.StructType([T.StructField("step", T.LongType(), False), T.StructField("bus", T.LongType(), False), *[T.StructField(x, T.FloatType(), False) for x in CHANNELS]])

_double, _long, _string, _bool = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()
#: Element tables: the columns that the engine reads. The pandas-like row index is the column element_id.
ELEMENTS = {
    "bus": {"element_id": _long, "vn_kv": _double, "in_service": _bool},
    "line": {"element_id": _long, "from_bus": _long, "to_bus": _long},
    "trafo": {
        "element_id": _long, "hv_bus": _long, "lv_bus": _long, "tap_pos": _double, "tap_neutral": _double, "tap_min": _double, "tap_max": _double,
        "tap_step_percent": _double, "tap_step_degree": _double, "tap_side": _string, "tap_changer_type": _string,
    },
    "load": {"element_id": _long, "bus": _long, "p_mw": _double, "q_mvar": _double, "profile": _string},
    "sgen": {"element_id": _long, "bus": _long, "p_mw": _double, "q_mvar": _double, "profile": _string},
    "gen": {"element_id": _long, "bus": _long, "p_mw": _double, "profile": _string},
    "storage": {"element_id": _long, "bus": _long, "p_mw": _double, "q_mvar": _double, "profile": _string},
    "ext_grid": {"element_id": _long, "bus": _long},
    "switch": {"element_id": _long, "bus": _long},
}
#: Columns that may be missing from an element table, with what stands for them.
OPTIONAL = {("bus", "in_service"): None, ("load", "profile"): None, ("sgen", "profile"): None, ("gen", "profile"): None, ("storage", "profile"): None, ("sgen", "q_mvar"): None, ("storage", "q_mvar"): None}

#: Families of profiles that may drive an element, and the required element columns with a profile.
FAMILIES = {"load": ("load",), "storage": ("storage",), "sgen": ("powerplants", "renewables"), "gen": ("powerplants", "renewables")}
REQUIRED_FAMILIES = ("load", "powerplants", "renewables", "storage")
PROFILED = (("load", "p_mw"), ("load", "q_mvar"), ("sgen", "p_mw"), ("gen", "p_mw"), ("storage", "p_mw"))
SUFFIX = {("load", "p_mw"): "_pload", ("load", "q_mvar"): "_qload"}
BRANCHES = ("line", "trafo", "trafo3w", "impedance", "dcline")
