"""Provenance: what ran where, seeds, and the artifacts of a model run.

A run record is a flat mapping. Each of its facts has a collector, registered by name below; Spark's own come from the
session, as they say more about a result than the driver's machine does. Seeding is a table as well, one entry for each
library; estimators and samplers take their seeds as parameters, and bitwise equal runs are not promised.
"""

from __future__ import annotations

import os
import platform
import random
import shutil
import subprocess
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from importlib import metadata, util
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from .artifacts import write_json
from .sources.files import sha256_file

PACKAGES = ("pyspark", "py4j", "numpy", "pandas", "pyarrow", "duckdb", "pytest")
ENVIRONMENT = ("SPARK_HOME", "JAVA_HOME", "PYSPARK_PYTHON", "OMP_NUM_THREADS", "MKL_NUM_THREADS", "CUDA_VISIBLE_DEVICES", "CUBLAS_WORKSPACE_CONFIG")
#: Settings of Spark that can change a result or its speed, by prefix.
SETTINGS = ("spark.sql.", "spark.executor.", "spark.master")


@dataclass(frozen=True)
class Run:
    """What the collectors look at."""

    experiment: str
    seed: int
    config: Path
    root: Path
    spark: SparkSession | None = None


Collector = Callable[[Run], Mapping[str, Any]]
COLLECTORS: list[Collector] = []


def collector(found: Collector) -> Collector:
    COLLECTORS.append(found)
    return found


@collector
def engine(run: Run) -> dict[str, Any]:
    """Version and settings of the session."""
    if run.spark is None:
        return {"spark_version": None, "spark_settings": {}}
    settings = run.spark.sparkContext.getConf().getAll()
    return {"spark_version": run.spark.version, "spark_settings": {k: v for k, v in sorted(settings) if k.startswith(SETTINGS)}}


@collector
def request(run: Run) -> dict[str, Any]:
    """What was asked for, and when."""
    return {
        "schema_version": "1.0", "created_utc": datetime.now(UTC).isoformat(), "experiment": run.experiment, "seed": run.seed,
        "config_path": str(run.config), "config_sha256": sha256_file(run.config),
    }


@collector
def code(run: Run) -> dict[str, Any]:
    """Commit and state of the working tree, from one report of git; null where there is none."""
    report = subprocess.run(["git", "-C", str(run.root), "status", "--porcelain=v2", "--branch"], capture_output=True, text=True, check=False) if shutil.which("git") else None
    if report is None or report.returncode:
        return {"git_commit": None, "git_dirty": None}
    lines = report.stdout.splitlines()
    commits = [x.split()[-1] for x in lines if x.startswith("# branch.oid ")]
    return {"git_commit": next((x for x in commits if x != "(initial)"), None), "git_dirty": any(not x.startswith("#") for x in lines)}


@collector
def host(run: Run) -> dict[str, Any]:
    """The driver's machine and interpreter."""
    own = platform.uname()
    return {
        "python_version": platform.python_version(), "platform": platform.platform(), "machine": own.machine, "processor": own.processor, "cpu_count": os.cpu_count(),
        "env": {x: os.environ.get(x) for x in ENVIRONMENT},
    }


@collector
def libraries(run: Run) -> dict[str, Any]:
    """Versions of the packages that are there, null for the others."""
    there = {(x.metadata["Name"] or "").lower(): x.version for x in metadata.distributions()}
    return {"packages": {x: there.get(x) for x in PACKAGES}}


def run_record(experiment: str, seed: int, config: str | Path, root: str | Path, spark: SparkSession | None = None) -> dict[str, Any]:
    """All facts about a run."""
    run = Run(experiment, seed, Path(config).resolve(), Path(root).resolve(), spark)
    return {k: v for found in COLLECTORS for k, v in found(run).items()}


# --- seeds


def _seed_torch(seed: int, strict: bool) -> dict[str, Any]:
    if util.find_spec("torch") is None:
        return {"torch_available": False, "torch_deterministic": False}
    import torch

    torch.manual_seed(seed)  # all devices
    torch.use_deterministic_algorithms(strict)
    return {"torch_available": True, "torch_deterministic": strict}


def _seed_python(seed: int, strict: bool) -> dict[str, Any]:
    random.seed(seed)
    os.environ["PYTHONHASHSEED"] = str(seed)  # for workers started from now on
    return {"python_hash_seed": os.environ["PYTHONHASHSEED"]}


def _seed_numpy(seed: int, strict: bool) -> dict[str, Any]:
    np.random.seed(seed & 0xFFFFFFFF)
    return {"numpy_seeded": True}


#: Each seeds one library and says what it did.
SEEDERS = (_seed_python, _seed_numpy, _seed_torch)


def seed_all(seed: int, *, strict: bool = True) -> dict[str, Any]:
    """Seed the driver's generators; `strict` also asks libraries for deterministic algorithms."""
    if seed < 0:
        raise ValueError("the seed must not be negative")
    state: dict[str, Any] = {"seed": seed}
    for seeder in SEEDERS:
        state.update(seeder(seed, strict))
    return state


# --- artifacts of a run


def write_results(results: Any, path: str | Path) -> tuple[Path, str]:
    """Validation results as JSON, with their digest."""
    out = write_json(results, path)
    return out, sha256_file(out)


def write_model_run(folder: str | Path, *, record: Mapping[str, Any], settings: Mapping[str, Any], results: Mapping[str, Any], models: list[str]) -> Path:
    """Settings, run record, results, and a list of every file of the models with its digest."""
    out = Path(folder)
    parts = {"effective_config.json": settings, "run_manifest.json": record, "validation.json": results}
    own = [write_json(dict(content), out / name) for name, content in parts.items()]
    files = sorted(f for m in models for f in Path(m.removeprefix("file://")).rglob("*") if f.is_file() and not f.name.startswith("."))
    listed = {str(f.relative_to(out) if f.is_relative_to(out) else f): sha256_file(f) for f in [*files, *own]}
    return write_json({"files": listed}, out / "model_manifest.json")
