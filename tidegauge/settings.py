"""Settings of an analysis: defaults, a TOML file over them, and what follows from them."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tidegauge.functions.intervals import bar_count, describe_horizon, duration_seconds, normalise_interval, parse_time_range
from tidegauge.operators.features import Windows

MODES = ("two_stage", "fast", "detailed")
VIEWS = ("log_price", "log_return", "both")
GROUPS = ("mean", "trend", "volatility", "combined")


def _names(turn: Callable[[str], str], instead: tuple[str, ...] = ()) -> Callable[[Iterable[str]], tuple[str, ...]]:
    """Names without the empty ones; `instead` of none at all, which is an error without it."""

    def check(value: Iterable[str]) -> tuple[str, ...]:
        found = tuple(turn(name.strip()) for name in value if name.strip()) or instead
        if not found:
            raise ValueError("at least one name is needed")
        return found

    return check


def _one_of(allowed: tuple[str, ...]) -> Callable[[str], str]:
    def check(value: str) -> str:
        found = value.strip().lower().replace("-", "_")
        if found not in allowed:
            raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
        return found

    return check


def _at_least_one(value: int) -> int:
    if value < 1:
        raise ValueError(f"{value!r} is less than one")
    return value


def _range(value: str) -> str:
    return parse_time_range(value).name


def _raised_to_one(value: int) -> int:
    return max(1, int(value))


def _length(value: str) -> str:
    duration_seconds(value)
    return value


def _kind(default: object, check: Callable) -> Any:
    """A field whose values go through the check of its kind."""
    return field(default=default, metadata={"check": check})


@dataclass
class Settings:
    """Names and defaults are those of the settings file. Lengths are durations; their bars follow from the interval.

    Each value goes through the check of its kind, and an error names its field.
    """

    symbols: tuple[str, ...] = _kind(("BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "XRPUSDT"), _names(str.upper))
    interval: str = _kind("15m", normalise_interval)
    analysis_period: str = _kind("1y", _range)
    training_window: str = _kind("30d", _length)
    forecast_horizon_bars: int = _kind(1, _at_least_one)
    refit_stride_bars: int = _kind(1, _raised_to_one)
    search_mode: str = _kind("two_stage", _one_of(MODES))
    candidate_model_count: int = _kind(16, _raised_to_one)
    candidate_model_groups: tuple[str, ...] = _kind(GROUPS, _names(str.lower, GROUPS))
    target_view: str = _kind("both", _one_of(VIEWS))
    historical_days: int = 365
    bootstrap_limit: int = 1000
    dashboard_time_range: str = _kind("1d", _range)
    forecast_time_range: str = _kind("1w", _range)
    backtest_time_range: str = _kind("1y", _range)
    volatility_window: str = _kind("24h", _length)
    correlation_window: str = _kind("7d", _length)
    pca_window: str = _kind("30d", _length)
    trend_window: str = _kind("24h", _length)
    regime_threshold_window: str = _kind("90d", _length)
    garch_refit_frequency: int = _kind(672, _raised_to_one)
    severe_shock_threshold: float = 3.0
    moderate_shock_threshold: float = 2.0
    shock_breadth_threshold: float = 0.60
    data_dir: str = "data"

    def __post_init__(self) -> None:
        for f in fields(self):
            if check := f.metadata.get("check"):
                try:
                    setattr(self, f.name, check(getattr(self, f.name)))
                except (ValueError, TypeError, AttributeError) as e:
                    raise ValueError(f"{f.name}: {e}") from e

    def bars(self, name: str) -> int:
        """Bars of the duration of that name."""
        return bar_count(getattr(self, name), self.interval)

    @property
    def windows(self) -> Windows:
        return Windows(short=self.bars("volatility_window"), medium=self.bars("correlation_window"), long=self.bars("pca_window"), trend=self.bars("trend_window"))

    @property
    def horizon(self) -> str:
        return describe_horizon(self.forecast_horizon_bars, self.interval)


def load(path: str | Path) -> Settings:
    """The settings of a TOML file over the defaults; the defaults if there is no file. Names that aren't settings are an error."""
    path = Path(path)
    if not path.exists():
        return Settings()
    found = tomllib.loads(path.read_text(encoding="utf-8"))
    unknown = set(found) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**found)
