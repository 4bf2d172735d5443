"""Naive forecasts: last value, and the value of a day or a week before the target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import Split, WindowSpec
from ..errors import IntegrityError
from . import features, metrics


@dataclass(frozen=True)
class Baseline:
    baseline_id: str
    label: str
    #: `origin_constant`: the value at the origin; `target_lag`: the value lag steps before the target.
    mode: str
    lag: int = 0


# --- fixed values: ids, modes and lags of the baselines
LAST_VALUE = Baseline("last_value_v1", "last value", "origin_constant")
DAILY = Baseline("seasonal_24h_v1", "24 hours before", "target_lag", 96)
WEEKLY = Baseline("seasonal_7d_v1", "7 days before", "target_lag", 672)
BASELINES = (LAST_VALUE, DAILY, WEEKLY)


def target_range(split: Split, name: str, spec: WindowSpec) -> tuple[int, int]:
    """[a, b): steps that may be targets of the split's windows; a is the least target start, history included."""
    a, b = split.range(name)
    return max(a, spec.history - 1 + spec.lead), b


def require_causal(baseline: Baseline, spec: WindowSpec, first_target: int) -> None:
    """Every source must exist and must not lie after the origin."""
    if baseline.mode == "origin_constant":
        return
    if baseline.mode != "target_lag":
        raise IntegrityError(f"unknown mode {baseline.mode!r}")
    if baseline.lag < spec.lead + spec.horizon - 1:
        raise IntegrityError(f"{baseline.baseline_id}: a lag of {baseline.lag} steps reads after the origin of a window of {spec.horizon}")
    if first_target < baseline.lag:
        raise IntegrityError(f"{baseline.baseline_id}: the first target {first_target} has no value {baseline.lag} steps before")


def audit_sources(windows: DataFrame, baseline: Baseline) -> DataFrame:
    """(n_sources, n_negative, n_future): sources of every window and target step, counted."""
    steps = windows.select("origin", F.explode(F.sequence("target_start", "target_end")).alias("target"))
    source = F.col("origin") if baseline.mode == "origin_constant" else F.col("target") - baseline.lag
    return steps.agg(F.count("*").alias("n_sources"), F.count_if(source < 0).alias("n_negative"), F.count_if(source > F.col("origin")).alias("n_future"))


def forecasts(cube: DataFrame, windows: DataFrame, baseline: Baseline, channel: str) -> DataFrame:
    """(origin, horizon, bus, y, yhat) for any set of windows, by equality joins on (bus, step). Horizons count from 0."""
    steps = windows.select("origin", F.posexplode(F.sequence("target_start", "target_end")).alias("horizon", "target"))
    source = F.col("origin") if baseline.mode == "origin_constant" else F.col("target") - baseline.lag
    values = cube.select("step", "bus", F.col(channel).alias("v"))
    rows = steps.withColumn("source", source)
    y = rows.join(values.select(F.col("step").alias("target"), "bus", F.col("v").alias("y")), "target")
    return y.join(values.select(F.col("step").alias("source"), "bus", F.col("v").alias("yhat")), ["source", "bus"]).select("origin", "horizon", "bus", "y", "yhat")


def error_rows(cube: DataFrame, split: Split, name: str, spec: WindowSpec, baselines: tuple[Baseline, ...], channels: str | tuple[str, ...]) -> DataFrame:
    """(channel, baseline, bus, horizon, step, y, yhat, w): each target once per distinct forecast, w times its windows.

    With a stride of one, a lagged forecast of a target is the same in every window that holds it, so one row stands
    for w windows, 16 or 96 times fewer rows than windows x steps; horizon is NULL in these. The last value depends on
    the horizon: one lag column each, and w is 1. All lags and all channels share one window specification, and all
    forecasts one explode. For one channel, given by its name, there is no column of channels.
    """
    if spec.stride != 1:
        raise IntegrityError("closed forms need a stride of 1; use forecasts() for other plans")
    a, b = target_range(split, name, spec)
    h = spec.horizon
    for x in baselines:
        require_causal(x, spec, a)
    many = (channels,) if isinstance(channels, str) else channels
    by_bus = features.by_bus("channel")
    lags = {f"l{x.lag}": x.lag for x in baselines if x.mode == "target_lag"}
    last = [x for x in baselines if x.mode == "origin_constant"]
    if last:
        lags |= {f"l{spec.lead + k}": spec.lead + k for k in range(h)}
    halo = max(lags.values(), default=0)
    own = cube.where((F.col("step") >= a - halo) & (F.col("step") < b)).unpivot(["step", "bus"], list(many), "channel", "y")
    own = features.stretched(own, halo).withColumns({k: F.lag("y", v).over(by_bus) for k, v in lags.items()})
    own = features.at_home(own).where(F.col("step") >= a)
    t = F.col("step")
    covered = F.greatest(F.least(t, F.lit(b - h)) - F.greatest(F.lit(a), t - (h - 1)) + 1, F.lit(0))

    def forecast(baseline: Baseline, horizon: int | None, yhat: str, w: Column) -> Column:
        return F.struct(F.lit(baseline.baseline_id).alias("baseline"), F.lit(horizon).cast("int").alias("horizon"), F.col(yhat).alias("yhat"), w.cast("long").alias("w"))

    each = [forecast(x, None, f"l{x.lag}", covered) for x in baselines if x.mode == "target_lag"]
    each += [forecast(x, k, f"l{spec.lead + k}", F.when((t >= a + k) & (t <= b - h + k), 1).otherwise(0)) for x in last for k in range(h)]
    rows = own.select("channel", "bus", "step", "y", F.explode(F.filter(F.array(*each), lambda x: x["w"] > 0)).alias("x"))
    rows = rows.select("channel", "x.baseline", "bus", "x.horizon", "step", "y", "x.yhat", "x.w")
    return rows.drop("channel") if isinstance(channels, str) else rows


def by_horizon(rows: DataFrame, split: Split, name: str, spec: WindowSpec, keep: list[str] | None = None) -> DataFrame:
    """The rows with their horizon filled in: a lagged forecast at target t is used at horizon h if a + h <= t <= b - H + h."""
    a, b = target_range(split, name, spec)
    h = spec.horizon
    lo = F.greatest(F.lit(0), F.col("step") - (b - h)).cast("int")
    hi = F.least(F.lit(h - 1), F.col("step") - a).cast("int")
    all_h = F.when(F.col("horizon").isNotNull(), F.array("horizon")).otherwise(F.sequence(lo, hi))
    return rows.select(*(keep or []), "baseline", "bus", F.explode(all_h).alias("horizon"), "step", "y", "yhat", F.lit(1).cast("long").alias("w"))


def horizon_sums(rows: DataFrame, split: Split, name: str, spec: WindowSpec, group: list[str], error: dict[str, object]) -> DataFrame:
    """Sums of each horizon for lagged forecasts as differences of sums over steps.

    Row t serves the horizons from max(0, t - (b - H)) to min(H - 1, t - a), a stretch: it adds its value at the
    stretch's begin and takes it off after the end, and a running sum over the H horizons gives every horizon's sum.
    Two rows for a target instead of H. Exact for integers; in double precision the order of addition differs.
    """
    a, b = target_range(split, name, spec)
    h = spec.horizon
    lo = F.coalesce(F.col("horizon"), F.greatest(F.lit(0), F.col("step") - (b - h)).cast("int"))
    hi = F.coalesce(F.col("horizon"), F.least(F.lit(h - 1), F.col("step") - a).cast("int"))
    ends = F.explode(F.array(F.struct(lo.alias("horizon"), F.lit(1).alias("sign")), F.struct((hi + 1).alias("horizon"), F.lit(-1).alias("sign")))).alias("e")
    deltas = rows.select(*group, *[v.alias(k) for k, v in error.items()], ends)
    sums = deltas.groupBy(*group, F.col("e.horizon").alias("horizon")).agg(*[F.sum(F.col(k) * F.col("e.sign")).alias(k) for k in error], F.sum(F.col("e.sign")).alias("n"))
    running = Window.partitionBy(*group).orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    out = sums.select(*group, "horizon", *[F.sum(k).over(running).alias(k) for k in [*error, "n"]])
    return out.where(F.col("horizon") < h)


def horizon_metrics(rows: DataFrame, split: Split, name: str, spec: WindowSpec, group: list[str]) -> DataFrame:
    """(group, horizon, mae, rmse, wape, points) from horizon_sums."""
    y = F.col("y").cast("double")
    e = y - F.col("yhat").cast("double")
    sums = horizon_sums(rows, split, name, spec, group, {"abs_e": F.abs(e), "sq_e": e * e, "abs_y": F.abs(y)})
    return sums.select(*group, "horizon", *metrics.named(metrics.finals()), F.col("n").cast("long").alias("points"))


def evaluate(cube: DataFrame, split: Split, name: str, spec: WindowSpec, channel: str, active: DataFrame, baselines: tuple[Baseline, ...] = BASELINES) -> DataFrame:
    """Metrics of all baselines at the four levels, for one channel and split, as long rows (see metrics.LEVEL)."""
    rows = error_rows(cube, split, name, spec, baselines, channel)
    return metrics.levels(rows, horizon_metrics(rows, split, name, spec, ["baseline"]), active, ["baseline"])
