"""Benchmark runs: naive and learned forecasts on the validation split, behind one seal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Split, Task
from ..errors import IntegrityError
from ..operators import metrics, naive, scaling
from ..schemas import SPLITS
from ..sources import events

OPEN_SPLITS = ("train", "validation")


def require_open(names: tuple[str, ...], *, unseal: bool = False) -> None:
    """Unknown splits are refused, and so is the test split until it is unsealed on purpose."""
    unknown = sorted(set(names) - set(SPLITS))
    if unknown:
        raise IntegrityError(f"unknown splits: {unknown}")
    sealed = sorted(set(names) - set(OPEN_SPLITS))
    if sealed and not unseal:
        raise IntegrityError(f"sealed splits: {sealed}")


def naive_benchmark(cube: DataFrame, split: Split, tasks: tuple[Task, ...], *, splits: tuple[str, ...] = ("validation",), baselines: tuple[naive.Baseline, ...] = naive.BASELINES, unseal: bool = False) -> DataFrame:
    """(task_id, split, channel, level, baseline, ...) of every task, split, channel and legal baseline, as one plan."""
    require_open(splits, unseal=unseal)
    parts = []
    for task in tasks:
        for name in splits:
            for channel in task.target_channels:
                active = scaling.activity(cube, split, channel)
                out = naive.evaluate(cube, split, name, task.spec(), channel, active, baselines)
                parts.append(out.select(F.lit(task.task_id).alias("task_id"), F.lit(name).alias("split"), F.lit(channel).alias("channel"), *out.columns))
    return reduce(DataFrame.unionByName, parts)


def naive_results(spark: SparkSession, sf_dir: str, contract: Contract | None = None) -> dict[str, object]:
    """Nested results of the event cube; only finished metrics reach the driver."""
    task = (contract or Contract()).primary()
    cube = events.cube(spark, sf_dir).persist()
    try:
        rows = naive_benchmark(cube, events.SPLIT, (task,)).collect()
    finally:
        cube.unpersist()
    out: dict[str, object] = {}
    for r in rows:
        at = out.setdefault(r["task_id"], {}).setdefault(r["split"], {}).setdefault(r["channel"], {}).setdefault(r["baseline"], {})
        value = {k: r[k] for k in ("mae", "rmse", "wape", "points", "active_buses") if r[k] is not None or k == "wape"}
        if r["level"] == "horizon_step":
            at.setdefault("horizon_step", {})[str(r["horizon"] + 1)] = value
        else:
            at[r["level"]] = value
    return out


def report(scores: DataFrame) -> list[str]:
    """Lines of text for the bus_micro level."""
    rows = scores.where("level = 'bus_micro'").orderBy("task_id", "split", "channel", "baseline").collect()
    return [f"{r['task_id']} {r['split']} {r['channel']} {r['baseline']}: MAE {metrics.text(r['mae'])} RMSE {metrics.text(r['rmse'])} WAPE {metrics.text(r['wape'])}" for r in rows]
