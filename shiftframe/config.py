"""Experiment and data configurations: small mappings in YAML or JSON, read on the driver.

Where there is a YAML package it reads them; without one, `parse` reads JSON and a plain subset of YAML.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from .errors import ConfigError


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text in ("", "~", "null"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _value(text: str) -> Any:
    text = text.strip()
    if text.startswith("["):
        if not text.endswith("]"):
            raise ConfigError(f"unclosed list: {text}")
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return _scalar(text)


def parse(text: str) -> Any:
    """Top-level `key: value` pairs; values are scalars, lists in brackets, or lists of `- item` lines. Or JSON."""
    if text.lstrip().startswith(("{", "[")):
        return json.loads(text)
    out: dict[str, Any] = {}
    last: str | None = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip() or line.strip() == "---":
            continue
        item = line.strip()
        if item.startswith("- "):
            if last is None or not (out[last] is None or isinstance(out[last], list)):
                raise ConfigError(f"line {n}: an item outside a list")
            out[last] = [*(out[last] or []), _scalar(item[2:])]
        elif ":" in item and line == item:
            last, _, rest = (x.strip() for x in item.partition(":"))
            out[last] = _value(rest)
        else:
            raise ConfigError(f"line {n}: {raw!r} is neither a pair nor an item")
    return out


def _load(text: str) -> Any:
    try:
        import yaml
    except ImportError:
        return parse(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e


def read_mapping(path: str | Path) -> dict[str, Any]:
    try:
        found = _load(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: the top level must be a mapping")
    return found


def _rule(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _filled(items: tuple[str, ...]) -> bool:
    return bool(items) and all(x.strip() for x in items)


@dataclass(frozen=True)
class DataConfig:
    dataset: str
    grids: tuple[str, ...]
    resolution_minutes: int
    train_fraction: float
    val_fraction: float
    test_fraction: float
    seed: int

    def __post_init__(self):
        _rule(bool(self.dataset.strip()), "the dataset has no name")
        _rule(_filled(self.grids), "there must be grids, each with a name")
        _rule(self.resolution_minutes > 0 and 1440 % self.resolution_minutes == 0, "the resolution must divide a day")
        parts = (self.train_fraction, self.val_fraction, self.test_fraction)
        _rule(all(0 < x < 1 for x in parts), f"fractions must lie in (0, 1): {parts}")
        _rule(abs(sum(parts) - 1) <= 1e-12, f"fractions must sum to 1: {parts}")
        _rule(self.seed >= 0, "the seed must not be negative")

    @classmethod
    def of(cls, raw: dict[str, Any]) -> DataConfig:
        try:
            own = {f.name: raw[f.name] for f in fields(cls)}
            return cls(
                str(own["dataset"]), tuple(map(str, own["grids"])), int(own["resolution_minutes"]), float(own["train_fraction"]), float(own["val_fraction"]), float(own["test_fraction"]), int(own["seed"])
            )
        except (KeyError, TypeError, ValueError) as e:
            raise e if isinstance(e, ConfigError) else ConfigError(f"data configuration: {e!r}") from e


@dataclass(frozen=True)
class ExperimentConfig:
    experiment: str
    data_config: Path
    models: tuple[str, ...]
    shifts: tuple[str, ...]
    seeds: tuple[int, ...]
    metrics: tuple[str, ...]

    def __post_init__(self):
        _rule(bool(self.experiment.strip()), "the experiment has no name")
        for name in ("models", "metrics"):
            own = getattr(self, name)
            _rule(bool(own) and len(set(own)) == len(own), f"{name} must be there, each once")
        _rule(len(set(self.shifts)) == len(self.shifts), "shifts must differ")
        _rule(bool(self.seeds) and min(self.seeds) >= 0 and len(set(self.seeds)) == len(self.seeds), "seeds must be there, each once, and not negative")

    @classmethod
    def of(cls, raw: dict[str, Any], root: Path) -> ExperimentConfig:
        try:
            path = Path(str(raw["data_config"]))
            many = lambda k, kind, default=None: tuple(kind(x) for x in (raw[k] if default is None else raw.get(k) or default))
            return cls(str(raw["experiment"]), path if path.is_absolute() else (root / path).resolve(), many("models", str), many("shifts", str, ()), many("seeds", int), many("metrics", str))
        except (KeyError, TypeError, ValueError) as e:
            raise e if isinstance(e, ConfigError) else ConfigError(f"experiment configuration: {e!r}") from e


def load_experiment(path: str | Path, root: str | Path) -> tuple[ExperimentConfig, DataConfig]:
    """An experiment and its data configuration, whose path counts from the repository's root."""
    experiment = ExperimentConfig.of(read_mapping(path), Path(root).resolve())
    if not experiment.data_config.is_file():
        raise ConfigError(f"there is no data configuration {experiment.data_config}")
    return experiment, DataConfig.of(read_mapping(experiment.data_config))
