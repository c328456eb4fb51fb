"""Candle intervals, durations and time ranges."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Candle intervals in seconds; 1m is a minute, 1M is 30 days.
INTERVALS = {
    "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600,
    "8h": 28800, "12h": 43200, "1d": DAY, "3d": 3 * DAY, "1w": 7 * DAY, "1M": 30 * DAY,
}
# Units of durations in seconds; here m is a month of 30 days.
UNITS = {"s": 1, "m": 30 * DAY, "h": 3600, "d": DAY, "w": 7 * DAY, "y": 365 * DAY}
# Preset time ranges.
PRESETS = ("1d", "1w", "1m", "3m", "6m", "1y")


def normalise_interval(text: str) -> str:
    """The interval's token; case matters only between 1m and 1M."""
    t = str(text).strip()
    t = t if t in INTERVALS else t.lower()
    if t not in INTERVALS:
        raise ValueError(f"unknown candle interval: {text!r}")
    return t


def interval_seconds(text: str) -> int:
    return INTERVALS[normalise_interval(text)]


def duration_seconds(text: str) -> int:
    m = re.fullmatch(r"([1-9]\d*)([smhdwy])", str(text).strip().lower())
    if not m:
        raise ValueError(f"unknown duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def bars(duration: str, interval: str) -> int:
    """Bars that cover the duration, at least one."""
    return max(1, math.ceil(duration_seconds(duration) / interval_seconds(interval)))


def periods_per_year(interval: str) -> float:
    return 365 * DAY / interval_seconds(interval)


def seconds_label(seconds: float) -> str:
    """The largest unit that divides the seconds."""
    for name, size in (("day", DAY), ("hour", 3600), ("minute", 60)):
        if seconds >= size and seconds % size == 0:
            n = int(seconds // size)
            return f"{n} {name}{'s' * (n != 1)}"
    n = int(seconds)
    return f"{n} second{'s' * (n != 1)}"


def describe_horizon(horizon: int, interval: str) -> str:
    return f"{horizon} bar{'s' * (horizon != 1)} = next {seconds_label(horizon * interval_seconds(interval))}"


def latest_closed_open(now: datetime, interval: str) -> datetime:
    """Open time of the last bar that has closed by now."""
    size = interval_seconds(interval)
    at = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    return datetime.fromtimestamp(at.timestamp() // size * size - size, timezone.utc)


def floor_time(t: Column, seconds: int) -> Column:
    """A timestamp (without time zone) floored to bars counted from the epoch."""
    return F.window(t, f"{seconds} seconds")["start"]


def ceil_time(t: Column, seconds: int) -> Column:
    low = floor_time(t, seconds)
    return F.when(low == t, low).otherwise(low + F.expr(f"interval {seconds} seconds"))


@dataclass(frozen=True)
class TimeRange:
    name: str
    hours: int | None

    @property
    def expected_points(self) -> int | None:
        return self.hours


def parse_time_range(text: str | None) -> TimeRange:
    """A preset, a number of hours, days, weeks, months or years, or all."""
    t = (text or "all").strip().lower()
    if t == "all":
        return TimeRange("all", None)
    m = re.fullmatch(r"([1-9]\d*)([hdwmy])", t)
    if not m:
        raise ValueError(f"unknown time range: {text!r}")
    return TimeRange(t, int(m[1]) * UNITS[m[2]] // 3600)


def range_start(end: datetime, r: TimeRange) -> datetime | None:
    """Start of a range that ends with a bar of one hour at `end`."""
    return None if r.hours is None else end - timedelta(hours=r.hours - 1)


def bar_count(value: str | int, interval: str) -> int:
    """20, "20 bars", "20봉" or a duration, in bars."""
    if isinstance(value, int):
        n = value
    else:
        t = str(value).strip().lower()
        if not t:
            raise ValueError("a bar count is required")
        m = re.fullmatch(r"(\d+)\s*(?:bars?|봉)?", t)
        n = int(m[1]) if m else bars(t, interval)
    if n < 1:
        raise ValueError("a bar count must be positive")
    return n
