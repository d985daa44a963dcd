"""Settings of the engine: a frozen dataclass; unknown keys are dropped, wrong values refused."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from patternfold.errors import ConfigError

#: Inclusive bounds of the numeric settings.
RANGES = {
    "z_threshold": (0.1, 10), "min_support": (1, 1_000_000), "max_n": (2, 10), "window": (1, 1_000_000), "regime_size": (2, 10_000), "n_clusters": (1, 1000),
    "corr_threshold": (0, 1), "context_order": (0, 10), "mv_window": (2, 10_000), "mv_threshold": (0, 1), "evolve_drift": (0, 1), "max_period": (2, 1_000_000),
}


@dataclass(frozen=True)
class Config:
    z_threshold: float = 3.0
    min_support: int = 3
    max_n: int = 3
    window: int = 20
    weights: dict = field(default_factory=dict)
    regimes: bool = True
    regime_size: int = 8
    n_clusters: int = 2
    correlation: bool = True
    corr_threshold: float = 0.7
    seasonality: bool = True
    context_order: int = 2
    multivariate: bool = True
    mv_window: int = 5
    mv_threshold: float = 0.8
    evolve_drift: float = 0.4
    max_period: int = 256

    @classmethod
    def of(cls, settings: dict | Config | None = None) -> Config:
        """From a mapping. Whole floats pass for ints; booleans don't pass for numbers."""
        if settings is None:
            return cls()
        if isinstance(settings, cls):
            return settings
        if not isinstance(settings, dict):
            raise ConfigError("config", "must be a mapping")
        out = {}
        for f in fields(cls):
            if f.name not in settings:
                continue
            value, default = settings[f.name], f.default
            if f.name == "weights":
                if not isinstance(value, dict):
                    raise ConfigError(f.name, "must be a mapping")
            elif isinstance(default, bool):
                if not isinstance(value, bool):
                    raise ConfigError(f.name, "must be true or false")
            else:
                low, high = RANGES[f.name]
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                    raise ConfigError(f.name, "must be a finite number")
                if isinstance(default, int):
                    if value != int(value):
                        raise ConfigError(f.name, "must be whole")
                    value = int(value)
                if not low <= value <= high:
                    raise ConfigError(f.name, f"must be within {low} and {high}")
            out[f.name] = value
        return cls(**out)
