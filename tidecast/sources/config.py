"""Back-test settings from a YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Block:
    """One model: the steps ahead it forecasts, and its features."""

    forecast_horizon: tuple[int, ...]
    feature_cols: tuple[str, ...]


@dataclass(frozen=True)
class BacktestConfig:
    """Columns, hyperparameters, folds and horizon blocks of a back-test."""

    id_col: str
    target_col: str
    date_col: str
    date_frequency: str
    splits: int
    test_size: int
    models: Mapping[str, Block]
    hyperparameters: Mapping[str, Any] = field(default_factory=dict)
    output_file: str = "forecast"
    output_dir: str = "cv"
    #: Unit of the lags in feature names; the date frequency unless given.
    lag_frequency: str | None = None

    @classmethod
    def from_dict(cls, settings: Mapping[str, Any]) -> "BacktestConfig":
        data, cv, output = settings["data"], settings["cv"], settings.get("output", {})
        return cls(
            id_col=data["id_col"],
            target_col=data["target_col"],
            date_col=data["date_col"],
            date_frequency=data["date_frequency"],
            splits=cv["splits"],
            test_size=cv["test_size"],
            models={
                name: Block(tuple(block["forecast_horizon"]), tuple(block["feature_cols"]))
                for name, block in settings["models"].items()
            },
            hyperparameters=dict(settings.get("hyperparameters") or {}),
            output_file=output.get("file", "forecast"),
            output_dir=output.get("dir", "cv"),
            lag_frequency=data.get("lag_frequency"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> "BacktestConfig":
        try:
            import yaml
        except ImportError as missing:
            raise ImportError("reading a YAML config needs PyYAML; use from_dict without it") from missing
        with open(path) as file:
            return cls.from_dict(yaml.safe_load(file))
