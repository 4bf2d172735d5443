"""Contracts: splits, windows, tasks and evaluation, as immutable values that plans are built from."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Any

from .errors import IntegrityError
from .schemas import ACTIVITY_EPSILON, CALENDAR, NET_P, NET_Q, QUANTILES, SPLITS

#: The three ids (contract and tasks) are our own names, as the original ones hold a product's name; they are data, and
#: artifacts may carry any others (see write_artifact). The grid code, the time zone, and the splits' bounds.
CONTRACT_ID = "shiftframe-v1"
SCHEMA_VERSION = 1
GRID_CODE = "1-MV-urban--1-no_sw"
ZONE = "Europe/Berlin"
TRAIN_START, VALIDATION_START, TEST_START, DATASET_END = "2016-01-01 00:00:00", "2016-09-13 00:00:00", "2016-11-07 00:00:00", "2017-01-01 00:00:00"
PRIMARY_TASK, SECONDARY_TASK = "bus_pq_4h_v1", "bus_pq_24h_v1"
LEVELS = ("bus_micro", "bus_macro_active", "system_aggregate", "horizon_step")


@dataclass(frozen=True)
class Split:
    """Half-open ranges of steps, one behind the other."""

    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]

    def __post_init__(self):
        ends = [*self.train, *self.validation, *self.test]
        if any(b <= a for a, b in self.ranges().values()) or ends[1] != ends[2] or ends[3] != ends[4] or ends[0] < 0:
            raise IntegrityError(f"splits must be non-empty and contiguous: {self.ranges()}")

    def ranges(self) -> dict[str, tuple[int, int]]:
        return {"train": self.train, "validation": self.validation, "test": self.test}

    def range(self, name: str) -> tuple[int, int]:
        if name not in SPLITS:
            raise IntegrityError(f"unknown split {name!r}; there are {SPLITS}")
        return self.ranges()[name]

    @property
    def n_steps(self) -> int:
        return self.test[1]


def split_at(*bounds: int) -> Split:
    a, b, c, d = bounds
    return Split((a, b), (b, c), (c, d))


def fraction_split(n: int, *, train: float = 0.70, validation: float = 0.15) -> Split:
    """By fractions of the steps, rounded down in double precision."""
    if n < 3:
        raise IntegrityError("at least three steps are needed for three splits")
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise IntegrityError(f"fractions must lie in (0, 1) and leave room for a test split: {train}, {validation}")
    return split_at(0, math.floor(n * train), math.floor(n * (train + validation)), n)


def partition_split(n: int, *, train: float = 0.6, validation: float = 0.2, least: int = 1) -> Split:
    """The split of the shift tools: other defaults, and a least size for each part."""
    if n < 1 or not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError(f"invalid split of {n} rows: {train}, {validation}")
    a, b = int(n * train), int(n * (train + validation))
    if min(a, b - a, n - b) < least:
        raise ValueError(f"a part of the split has fewer than {least} rows: {(a, b - a, n - b)}")
    return split_at(0, a, b, n)


@dataclass(frozen=True)
class WindowSpec:
    history: int
    horizon: int
    lead: int = 1
    stride: int = 1

    def __post_init__(self):
        if min(self.history, self.horizon, self.lead, self.stride) < 1:
            raise IntegrityError(f"all parts of a window must be at least 1: {self}")


@dataclass(frozen=True)
class Task:
    task_id: str
    role: str
    history_steps: int
    horizon_steps: int
    description: str = ""
    history_channels: tuple[str, ...] = (NET_P, NET_Q)
    target_channels: tuple[str, ...] = (NET_P, NET_Q)
    known_future_features: tuple[str, ...] = CALENDAR
    lead_steps: int = 1
    stride: int = 1
    resolution_minutes: int = 15

    def spec(self) -> WindowSpec:
        return WindowSpec(self.history_steps, self.horizon_steps, self.lead_steps, self.stride)

    def channels(self) -> tuple[str, ...]:
        """History and target channels, each once, in the order of their first mention."""
        return tuple(dict.fromkeys((*self.history_channels, *self.target_channels)))


@dataclass(frozen=True)
class Evaluation:
    deterministic_metrics: tuple[str, ...] = ("mae", "rmse", "wape")
    probabilistic_metrics: tuple[str, ...] = ("mean_pinball_loss", "interval_coverage_90", "mean_interval_width_90", "absolute_coverage_error_90")
    quantiles: tuple[float, ...] = QUANTILES
    central_quantile: float = 0.50
    primary_interval: tuple[float, float] = (0.05, 0.95)
    aggregation_levels: tuple[str, ...] = LEVELS
    zero_activity_epsilon: float = ACTIVITY_EPSILON
    notes: tuple[str, ...] = (
        "Metrics are made of sums over all forecasts, never of means of means but for the macro level.",
        "WAPE is undefined where the targets' absolute sum is at most the activity epsilon.",
        "Quantiles that cross are counted and stay as they are.",
    )


@dataclass(frozen=True)
class Contract:
    contract_id: str = CONTRACT_ID
    schema_version: int = SCHEMA_VERSION
    grid_code: str = GRID_CODE
    zone: str = ZONE
    train_start: str = TRAIN_START
    validation_start: str = VALIDATION_START
    test_start: str = TEST_START
    dataset_end: str = DATASET_END
    tasks: tuple[Task, ...] = field(
        default=(
            Task(PRIMARY_TASK, "primary", 96, 16, "Net active and reactive demand of each bus: 24 hours back, 4 hours ahead."),
            Task(SECONDARY_TASK, "secondary", 672, 96, "Net active and reactive demand of each bus: 7 days back, 24 hours ahead."),
        )
    )
    evaluation: Evaluation = Evaluation()
    sign_convention: str = "Consumption is positive: net demand is load and storage less static and other generation."
    split_policy: str = "By local calendar time, in order; a window belongs to the split that holds all of its targets."
    scaling_policy: str = "Mean and standard deviation of each bus and channel, over training steps alone."
    future_covariate_policy: str = "Only the calendar of target steps is known ahead."

    def task(self, task_id: str) -> Task:
        for t in self.tasks:
            if t.task_id == task_id:
                return t
        raise IntegrityError(f"unknown task {task_id!r}")

    def primary(self) -> Task:
        return next(t for t in self.tasks if t.role == "primary")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def validate_contract(contract: Contract, expected_id: str = CONTRACT_ID, expected_version: int = SCHEMA_VERSION) -> None:
    """Every rule that needs no data; the policies and notes are text and have no rules."""

    def rule(ok: bool, what: str) -> None:
        if not ok:
            raise IntegrityError(f"contract: {what}")

    rule(contract.contract_id == expected_id, f"id {contract.contract_id!r} is not {expected_id!r}")
    rule(contract.schema_version == expected_version, f"schema version {contract.schema_version} is not {expected_version}")
    ids = [t.task_id for t in contract.tasks]
    rule(len(set(ids)) == len(ids), "task ids repeat")
    rule(sum(t.role == "primary" for t in contract.tasks) == 1, "there must be one primary task")
    q = contract.evaluation.quantiles
    rule(list(q) == sorted(set(q)), "quantiles must ascend without repeats")
    rule(all(0 < x < 1 for x in q), "quantiles must lie in (0, 1)")
    rule(contract.evaluation.central_quantile in q, "the central quantile is not among the quantiles")
    rule(all(x in q for x in contract.evaluation.primary_interval), "the interval's ends are not among the quantiles")
    for t in contract.tasks:
        rule(t.known_future_features == CALENDAR, f"{t.task_id}: known future features must be the calendar's")
        rule(bool(t.history_channels) and bool(t.target_channels), f"{t.task_id}: channels are missing")
        t.spec()
