"""Tree models: one point model and one model per quantile for each channel, on the 41-column matrix.

All models are boosted together on one binned sample (`boosting`); training rows are a sample of bounded size, scoring runs over all rows. A bundle is
a table of nodes and the ends of the bins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .contract import Contract, Split, Task
from .errors import IntegrityError
from .operators import features, metrics, naive, scaling, windows
from .schemas import CATEGORICAL, FEATURES
from .session import checkpoint_folder


@dataclass(frozen=True)
class Config:
    # --- fixed values: the learner's settings
    trees: int = 300
    learning_rate: float = 0.05
    leaves: int = 63
    min_rows: int = 100
    reg_lambda: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.9
    max_bins: int = 255
    max_rows: int = 150_000
    seed: int = 42

    def __post_init__(self):
        shares = 0 < self.learning_rate <= 1 and 0 < self.row_share <= 1 and 0 < self.column_share <= 1
        if min(self.trees, self.min_rows, self.max_rows) < 1 or self.leaves < 2 or not shares or self.reg_lambda < 0 or not 3 <= self.max_bins <= boosting.BINS or self.seed < 0:
            raise IntegrityError(f"invalid model settings: {self}")

    def growth(self) -> boosting.Growth:
        return boosting.Growth(self.leaves, self.min_rows, self.reg_lambda)


@dataclass
class Bundle:
    contract_id: str
    task_id: str
    fingerprint: str
    config: Config
    channels: tuple[str, ...]
    quantiles: tuple[float, ...]
    nodes: DataFrame
    ends: list[np.ndarray] = field(default_factory=list)
    engine: str = pyspark.__version__
    n_buses: int = 0

    def models(self) -> list[tuple[str, float | None]]:
        return [(c, q) for c in self.channels for q in (None, *self.quantiles)]


def training_sample(cube: DataFrame, split: Split, task: Task, static: DataFrame, calendar: DataFrame, config: Config) -> DataFrame:
    """The matrix of sampled training windows: rows are drawn first, so features are made for those alone."""
    features.audit_causality(task)
    n = windows.count_windows(split, task.spec())["train"]
    if not n:
        raise IntegrityError("there is no training window")
    n_buses = static.count()
    drawn = features.sample_rows(cube.sparkSession, n, n_buses, task.horizon_steps, max_rows=config.max_rows, seed=config.seed)
    first = task.history_steps - 1
    rows = features.matrix(cube, features.with_windows(drawn, first, task.spec()), static, calendar)
    return rows


def fit(cube: DataFrame, split: Split, static: DataFrame, calendar: DataFrame, *, contract: Contract, config: Config, fingerprint: str = "", quantiles: tuple[float, ...] | None = None, channels: tuple[str, ...] | None = None) -> Bundle:
    """All models of the primary task over one matrix, binned once."""
    task = contract.primary()
    channels = tuple(channels or task.target_channels)
    quantiles = tuple(contract.evaluation.quantiles if quantiles is None else quantiles)
    if not all(0 < q < 1 for q in quantiles):
        raise ValueError("quantiles must lie in (0, 1)")
    folder = f"{checkpoint_folder(cube.sparkSession)}/models-{uuid.uuid4().hex}"
    rows = training_sample(cube, split, task, static, calendar, config)
    for channel in channels:
        rows = features.target_vector(rows.select("row_id", "bus", "origin", "target_step", *FEATURES, *[f"y_{c}" for c in channels if f"y_{c}" in rows.columns]), cube, channel).withColumnRenamed("y", f"y_{channel}")
    rows.write.parquet(f"{folder}/rows")
    rows = cube.sparkSession.read.parquet(f"{folder}/rows")
    ends = boosting.edges(rows, FEATURES, config.max_bins - 1)  # one more for missing values
    out = Bundle(contract.contract_id, task.task_id, fingerprint, config, channels, quantiles, rows, ends, n_buses=static.count())
    nodes = boosting.fit(
        boosting.blocks(rows, FEATURES, ends, channels), out.models(), width=len(FEATURES), trees=config.trees, growth=config.growth(), learning_rate=config.learning_rate,
        row_share=config.row_share, column_share=config.column_share, nominal=tuple(FEATURES.index(x) for x in CATEGORICAL), seed=config.seed,
    )
    nodes.write.parquet(f"{folder}/nodes")
    out.nodes = cube.sparkSession.read.parquet(f"{folder}/nodes")
    return out


def require_compatible(bundle: Bundle, contract: Contract, fingerprint: str) -> None:
    if (bundle.contract_id, bundle.task_id, bundle.fingerprint) != (contract.contract_id, contract.primary().task_id, fingerprint):
        raise IntegrityError("the models belong to another contract, task or dataset")


def predict(bundle: Bundle, cube: DataFrame, split: Split, static: DataFrame, calendar: DataFrame, *, contract: Contract, name: str = "validation", max_windows: int | None = None) -> DataFrame:
    """(channel, window_index, horizon, bus, step, y, yhat, q05 ...) of a split's windows in order; only validation is open."""
    if name != "validation":
        raise IntegrityError(f"models are scored on the validation split; {name!r} is sealed")
    if max_windows is not None and max_windows < 1:
        raise IntegrityError("max_windows must be at least 1")
    task = contract.primary()
    spec = task.spec()
    n = windows.count_windows(split, spec)[name]
    n = n if max_windows is None else min(n, max_windows)
    if not n:
        raise IntegrityError("there is no window to score")
    first = naive.target_range(split, name, spec)[0] - spec.lead
    drawn = features.exhaustive_rows(cube.sparkSession, n, bundle.n_buses, spec.horizon)
    rows = features.matrix(cube, features.with_windows(drawn, first, spec), static, calendar).withColumn("horizon", (F.col("horizon_step") - 1).cast("int"))
    packed = boosting.pack(bundle.nodes)
    scored = boosting.score(rows, FEATURES, bundle.ends, {k: packed[k] for k in bundle.models()}, ("bus", "origin", "target_step", "horizon"))
    truth = cube.select("bus", F.col("step").alias("target_step"), *[F.col(c).cast("double").alias(f"y_{c}") for c in bundle.channels])
    m = 1 + len(bundle.quantiles)
    by_channel = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"y_{c}").alias("y"), F.slice("scores", k * m + 1, m).alias("s")) for k, c in enumerate(bundle.channels)])
    each = scored.join(truth, ["bus", "target_step"]).select("bus", "origin", F.col("target_step").alias("step"), "horizon", F.explode(by_channel).alias("c"))
    names = ["yhat", *[metrics.label(q) for q in bundle.quantiles]]
    return each.select("c.channel", "horizon", "bus", "origin", "step", "c.y", *[F.element_at("c.s", k).alias(x) for k, x in enumerate(names, 1)])


def evaluate(predictions: DataFrame, cube: DataFrame, split: Split, channel: str) -> DataFrame:
    """The four levels for one channel of predict()."""
    rows = predictions.where(F.col("channel") == channel).withColumn("baseline", F.lit("trees")).withColumn("w", F.lit(1))
    active = scaling.activity(cube, split, channel)
    return metrics.levels(rows, metrics.horizon_step(rows, ["baseline"]), active, ["baseline"])  # a step and a horizon name one origin


def importances(bundle: Bundle, channel: str, alpha: float | None = None) -> list[tuple[str, float]]:
    """Share of the gain by feature, the largest first; ties in the features' order."""
    own = bundle.nodes.where((F.col("channel") == channel) & F.col("alpha").eqNullSafe(F.lit(alpha).cast("double")) & (F.col("feature") >= 0))
    found = {r["feature"]: r["gain"] for r in own.groupBy("feature").agg(F.sum("gain").alias("gain")).collect()}
    gains = [found.get(k, 0.0) for k in range(len(FEATURES))]
    total = sum(gains)
    shares = [v / total if total > 0 else v for v in gains]
    return [(FEATURES[i], shares[i]) for i in sorted(range(len(shares)), key=lambda i: (-shares[i], i))]


def label(channel: str, q: float | None = None) -> str:
    """Name of a saved model: channel__point, channel__q0p05."""
    return f"{channel}__point" if q is None else f"{channel}__q" + f"{q:.2f}".replace(".", "p")


def save(bundle: Bundle, folder: str) -> list[str]:
    """Write each model as a table of its nodes, and the settings and ends of bins as text, through Spark's writers."""
    out = []
    for channel, q in bundle.models():
        own = bundle.nodes.where((F.col("channel") == channel) & F.col("alpha").eqNullSafe(F.lit(q).cast("double")))
        out.append(f"{folder}/{label(channel, q)}")
        own.coalesce(1).sortWithinPartitions("tree", "node").write.mode("overwrite").parquet(out[-1])
    head = {"contract_id": bundle.contract_id, "task_id": bundle.task_id, "fingerprint": bundle.fingerprint, "config": asdict(bundle.config), "channels": bundle.channels, "quantiles": bundle.quantiles, "ends": [x.tolist() for x in bundle.ends], "engine": bundle.engine, "n_buses": bundle.n_buses}
    bundle.nodes.sparkSession.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/bundle")
    return out


def load(spark: SparkSession, folder: str) -> Bundle:
    """A bundle that save() wrote; another engine's version is refused."""
    head = json.loads(spark.read.text(f"{folder}/bundle").first()["value"])
    if head["engine"] != pyspark.__version__:
        raise IntegrityError(f"the models were made by engine {head['engine']}; this is {pyspark.__version__}")
    channels, quantiles = tuple(head["channels"]), tuple(head["quantiles"])
    nodes = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{label(c, q)}") for c in channels for q in (None, *quantiles)])
    ends = [np.array(x, float) for x in head["ends"]]
    return Bundle(head["contract_id"], head["task_id"], head["fingerprint"], Config(**head["config"]), channels, quantiles, nodes, ends, head["engine"], head["n_buses"])
