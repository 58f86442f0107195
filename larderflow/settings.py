"""Typed settings; every field is read by some operator or plan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class DataSettings:
    raw_data_path: str = "data/raw"
    processed_data_path: str = "data/processed"
    train_end: str = "2016-03-27"
    val_end: str = "2016-04-24"
    test_end: str = "2016-05-22"


@dataclass(frozen=True)
class FeatureSettings:
    lag_periods: tuple[int, ...] = (1, 7, 14, 28)
    diff_periods: tuple[int, ...] = (1, 7)
    rolling_windows: tuple[tuple[int, tuple[str, ...]], ...] = (
        (7, ("mean", "std")),
        (14, ("mean", "std")),
        (28, ("mean", "std", "min", "max")),
    )


@dataclass(frozen=True)
class BoostingSettings:
    n_estimators: int = 100
    max_depth: int = 10
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    seed: int = 42
    validation_tol: float = 0.01
    patience: int = 10
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    local_rows: int = 262_144


@dataclass(frozen=True)
class ForecastSettings:
    horizon: int = 7
    max_horizon: int = 28
    season_length: int = 7
    averages: tuple[int, ...] = (7, 28)
    encoder_length: int = 28
    min_encoder_length: int = 14
    prediction_length: int = 7
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class MonitoringSettings:
    performance_threshold: float = 0.20
    drift_threshold: float = 0.15
    check_interval_days: int = 7
    retrain_interval_days: int = 30
    retrain_on_drift: bool = True
    retrain_on_performance_drop: bool = True
    min_improvement: float = 0.02


# Configuration keys and the fields they set.
KEYS = {
    **{f"data.{k}": f"data.{k}" for k in ("raw_data_path", "processed_data_path")},
    "data.train_end_date": "data.train_end",
    "data.validation_end_date": "data.val_end",
    "data.test_end_date": "data.test_end",
    **{f"features.{k}": f"features.{k}" for k in ("lag_periods", "diff_periods", "rolling_windows")},
    **{
        f"models.xgboost.{k}": f"boosting.{k}"
        for k in ("n_estimators", "max_depth", "learning_rate", "subsample", "validation_tol", "patience", "reg_lambda", "min_child_weight", "local_rows")
    },
    "models.xgboost.colsample_bytree": "boosting.colsample",
    "models.xgboost.random_state": "boosting.seed",
    "models.forecast_horizon": "forecast.horizon",
    **{f"models.{k}": f"forecast.{k}" for k in ("max_horizon", "season_length", "averages")},
    "models.tft.max_encoder_length": "forecast.encoder_length",
    "models.tft.min_encoder_length": "forecast.min_encoder_length",
    "models.tft.max_prediction_length": "forecast.prediction_length",
    "models.tft.quantiles": "forecast.quantiles",
    **{f"monitoring.{k}": f"monitoring.{k}" for k in ("performance_threshold", "drift_threshold", "check_interval_days")},
    **{f"mlops.{k}": f"monitoring.{k}" for k in ("retrain_interval_days", "retrain_on_drift", "retrain_on_performance_drop")},
    "mlops.min_improvement_threshold": "monitoring.min_improvement",
    "evaluation.baseline_model": "baseline_model",
}
# What lists and nested entries become.
SHAPES = {
    "data.train_end": str,
    "data.val_end": str,
    "data.test_end": str,
    **dict.fromkeys(("features.lag_periods", "features.diff_periods", "forecast.averages", "forecast.quantiles"), tuple),
    "features.rolling_windows": lambda windows: tuple((int(w["window"]), tuple(w["functions"])) for w in windows),
}
# Parts of a configuration file that belong to what is left out here: neural networks, serving, files outside of the flow.
IGNORED = ("models.lstm.", "models.tft.", "api.", "data.external_data_path", "data.m5_files.", "features.date_features", "evaluation.metrics", "mlops.model_registry_path", "logging.")


def _leaves(tree: Mapping[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    for key, value in tree.items():
        if isinstance(value, Mapping):
            yield from _leaves(value, f"{above}{key}.")
        else:
            yield f"{above}{key}", value


@dataclass(frozen=True)
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    boosting: BoostingSettings = field(default_factory=BoostingSettings)
    forecast: ForecastSettings = field(default_factory=ForecastSettings)
    monitoring: MonitoringSettings = field(default_factory=MonitoringSettings)
    baseline_model: str = "seasonal_naive"

    @classmethod
    def from_mapping(cls, tree: Mapping[str, Any] | None = None) -> Settings:
        """Settings from a nested mapping with the usual configuration file keys; missing keys keep defaults.

        A key that nothing reads raises, so that a slip of the pen does not pass as a default. Keys of parts that are
        not here (``IGNORED``) are left alone.
        """
        given = dict(_leaves(tree or {}))
        unknown = sorted(key for key in given if key not in KEYS and not key.startswith(IGNORED))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        parts: dict[str, dict[str, Any]] = {}
        for key, value in given.items():
            if key in KEYS:
                part, _, name = KEYS[key].rpartition(".")
                parts.setdefault(part, {})[name] = SHAPES.get(KEYS[key], lambda x: x)(value)
        forecast = parts.get("forecast", {})
        if "encoder_length" in forecast:
            forecast.setdefault("min_encoder_length", forecast["encoder_length"] // 2)
        base = cls()
        whole = {part: replace(getattr(base, part), **fields) for part, fields in parts.items() if part}
        return replace(base, **whole, **parts.get("", {}))

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        """Settings from a YAML file (needs PyYAML)."""
        try:
            import yaml
        except ImportError as error:
            raise ImportError("Settings.from_yaml needs PyYAML; use Settings.from_mapping instead") from error
        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(yaml.safe_load(handle))
