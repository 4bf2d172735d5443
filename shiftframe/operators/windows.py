"""Forecast windows: planning, split containment, leakage audit, materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Split, Task, WindowSpec
from ..errors import IntegrityError
from ..schemas import SPLITS
from . import checks, scan, timeaxis

COLUMNS = ("split", "history_start", "history_end", "origin", "target_start", "target_end")


def split_table(spark: SparkSession, split: Split) -> DataFrame:
    """(split, start, end): three rows."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in split.ranges().items()], "split string, start long, end long")


def contract_split(axis: DataFrame, contract: Contract, grid_code: str | None = None) -> Split:
    """Split by the contract's local boundaries, each of which must be on the axis (the end may follow its last step)."""
    spark = axis.sparkSession
    if grid_code is not None and grid_code != contract.grid_code:
        raise IntegrityError(f"the data are of grid {grid_code!r}, the contract of {contract.grid_code!r}")
    bounds = [
        timeaxis.exact_position(axis, timeaxis.boundary_to_utc(spark, local, zone=contract.zone), allow_end=last)
        for local, last in ((contract.train_start, False), (contract.validation_start, False), (contract.test_start, False), (contract.dataset_end, True))
    ]
    n = axis.agg(F.max("step")).first()[0] + 1
    if bounds[0] != 0 or bounds[3] != n:
        raise IntegrityError(f"the contract covers steps {bounds[0]} to {bounds[3]}, the data 0 to {n}")
    return Split((bounds[0], bounds[1]), (bounds[1], bounds[2]), (bounds[2], bounds[3]))


def containing_split(split: Split, first: Column, last: Column) -> Column:
    """Name of the split that holds the steps first..last (inclusive), or NULL: three literal ranges, no join."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(split.ranges().items()):
        out = F.when((first >= a) & (last < b), name).otherwise(out)
    return out


def candidates(spark: SparkSession, n: int, spec: WindowSpec) -> DataFrame:
    """All windows that lie in n steps, in whichever split. History and target ends are inclusive."""
    first, stop = spec.history - 1, n - spec.lead - spec.horizon + 1
    origins = spark.range(first, max(first, stop), spec.stride)
    o = F.col("id")
    return origins.select(
        (o - (spec.history - 1)).alias("history_start"), o.alias("history_end"), o.alias("origin"), (o + spec.lead).alias("target_start"), (o + (spec.lead + spec.horizon - 1)).alias("target_end")
    )


def plan(spark: SparkSession, n: int, split: Split, spec: WindowSpec) -> DataFrame:
    """Candidates with their split; NULL marks those that cross a boundary and are dropped."""
    if split.n_steps != n:
        raise IntegrityError(f"the split has {split.n_steps} steps, the data {n}")
    rows = candidates(spark, n, spec)
    return rows.select(containing_split(split, F.col("target_start"), F.col("target_end")).alias("split"), *COLUMNS[1:])


def for_split(windows: DataFrame, name: str) -> DataFrame:
    if name not in SPLITS:
        raise IntegrityError(f"unknown split {name!r}; there are {SPLITS}")
    return windows.where(F.col("split") == name)


def counts(windows: DataFrame) -> DataFrame:
    """(split, n) with `dropped` for the windows without a split."""
    return windows.groupBy(F.coalesce("split", F.lit("dropped")).alias("split")).agg(F.count("*").alias("n"))


def count_windows(split: Split, spec: WindowSpec) -> dict[str, int]:
    """The same counts in closed form, without making a row."""
    n = split.n_steps

    def origins(lo: int, hi: int) -> int:
        """Planned origins in [lo, hi)."""
        first, stop = spec.history - 1, n - spec.lead - spec.horizon + 1
        upto = lambda x: 0 if x <= first else (min(x, stop) - first + spec.stride - 1) // spec.stride
        return max(0, upto(hi) - upto(lo)) if stop > first else 0

    out = {name: origins(a - spec.lead, b - spec.lead - spec.horizon + 1) for name, (a, b) in split.ranges().items()}
    return out | {"dropped": origins(0, n) - sum(out.values())}


def audit(windows: DataFrame, split: Split) -> DataFrame:
    """One row: counts and the four rules that make a plan leak-proof.

    ordered: history ends before the target begins; contained: the target lies in its split; disjoint: no step is a
    target of two splits, by a sweep over the targets, so splits may interleave; contiguous: the splits follow each other.
    """
    kept = windows.where("split IS NOT NULL")
    ends = F.lit(None).cast("boolean")
    for name, (a, b) in split.ranges().items():
        ends = F.when(F.col("split") == name, (F.col("target_start") >= a) & (F.col("target_end") < b)).otherwise(ends)
    counted = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    ordered = (F.col("history_start") <= F.col("history_end")) & (F.col("history_end") == F.col("origin")) & (F.col("origin") < F.col("target_start")) & (F.col("target_start") <= F.col("target_end"))
    contiguous = split.train[1] == split.validation[0] and split.validation[1] == split.test[0]
    out = kept.agg(*counted, F.coalesce(F.bool_and(ordered), F.lit(True)).alias("ordered"), F.coalesce(F.bool_and(ends), F.lit(True)).alias("contained"))
    dropped = windows.where("split IS NULL").agg(F.count("*").alias("n_dropped"))
    shared = scan.shared_steps(kept, "split", "target_start", "target_end").agg((F.count("*") == 0).alias("disjoint"))
    both = out.crossJoin(shared).crossJoin(dropped).withColumn("contiguous", F.lit(contiguous))  # one row each
    return both.withColumn("passed", F.col("ordered") & F.col("contained") & F.col("disjoint") & F.col("contiguous"))


def require_audit(windows: DataFrame, split: Split) -> dict[str, object]:
    row = audit(windows, split).first().asDict()
    if not row["passed"]:
        raise IntegrityError(f"the window plan leaks: {row}")
    return row


def contract_plans(spark: SparkSession, split: Split, contract: Contract, *, check: bool = True) -> DataFrame:
    """Plans of all tasks, audited, as one table with task_id."""
    parts = []
    for task in contract.tasks:
        one = plan(spark, split.n_steps, split, task.spec())
        if check:
            require_audit(one, split)
        parts.append(one.select(F.lit(task.task_id).alias("task_id"), *COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def encode(windows: DataFrame) -> DataFrame:
    """Six BIGINT columns; splits are 0, 1, 2."""
    code = F.lit(None).cast("long")
    for i, name in enumerate(SPLITS):
        code = F.when(F.col("split") == name, F.lit(i).cast("long")).otherwise(code)
    return windows.where("split IS NOT NULL").select(code.alias("split"), *[F.col(x).cast("long").alias(x) for x in COLUMNS[1:]])


def materialise(cube: DataFrame, windows: DataFrame, task: Task, calendar: DataFrame | None = None) -> DataFrame:
    """(window, part, position, step, bus, channels): history and target of each window as long rows.

    A window's steps are generated and joined on the step, an equality; meant for chosen windows, as every step of the
    data is in history + horizon of them.
    """
    if not task.history_channels or not task.target_channels:
        raise IntegrityError("history and target channels must not be empty")
    channels = list(task.channels())
    steps = [
        windows.select("origin", F.lit(part).alias("part"), F.posexplode(F.sequence(a, z)).alias("position", "step"))
        for part, a, z in (("history", "history_start", "history_end"), ("target", "target_start", "target_end"))
    ]
    wanted = steps[0].unionByName(steps[1])
    rows = wanted.join(cube.select("step", "bus", *channels), "step")
    for x in channels:
        parts = [p for p, own in (("history", task.history_channels), ("target", task.target_channels)) if x in own]
        rows = rows.withColumn(x, F.when(F.col("part").isin(*parts), F.col(x)))
    if calendar is not None:
        rows = rows.join(calendar, "step", "left")
    return rows


def nested(cube: DataFrame, task: Task, windows: DataFrame) -> DataFrame:
    """(origin, bus, history, target): arrays of structs in order of steps."""
    rows = materialise(cube, windows, task)

    def part(name: str, channels: tuple[str, ...]) -> Column:
        each = F.when(F.col("part") == name, F.struct("position", *channels))
        return F.transform(F.sort_array(F.collect_list(each)), lambda x: F.struct(*[x[c].alias(c) for c in channels])).alias(name)

    return rows.groupBy("origin", "bus").agg(part("history", task.history_channels), part("target", task.target_channels))


def boundaries(split: Split) -> list[int]:
    return [split.train[0], split.train[1], split.validation[1], split.test[1]]


def check_dense(cube: DataFrame, n_steps: int | None = None) -> None:
    """Lags by position need every step of every bus exactly once."""
    per_bus = cube.groupBy("bus").agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.count_distinct("step").alias("d"))
    bad = per_bus.where("lo <> 0 OR n <> d OR hi <> n - 1" + (f" OR n <> {n_steps}" if n_steps is not None else ""))
    checks.none_of(bad, "a bus has missing or repeated steps")
