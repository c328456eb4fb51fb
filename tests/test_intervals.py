import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidegauge.functions import intervals as I


@given(st.sampled_from(list(I.INTERVALS)), st.integers(1, 400))
def test_whole_bars_make_their_duration(interval, n):
    size = I.interval_seconds(interval)
    assert I.bars(f"{n * size}s", interval) == n == I.bar_count(f"{n * size}s", interval) == I.bar_count(n, interval) == I.bar_count(f"{n} bars", interval)
    assert I.bars(f"{n * size + 1}s", interval) == n + 1


def test_a_month_is_no_minute():
    assert I.interval_seconds("1M") == 43200 * I.interval_seconds("1m") == I.duration_seconds("1m") == I.duration_seconds("30d")


@given(st.datetimes(datetime(1999, 1, 1), datetime(2080, 1, 1)), st.sampled_from(list(I.INTERVALS)))
def test_the_latest_closed_bar_is_the_last_that_ended(now, interval):
    now, size = now.replace(tzinfo=timezone.utc), I.interval_seconds(interval)
    opened = I.latest_closed_open(now, interval)
    assert opened.timestamp() % size == 0 and 0 <= now.timestamp() - (opened.timestamp() + size) < size


@given(st.integers(1, 50), st.sampled_from(["5m", "30m", "2h", "3d"]))
def test_horizon_text_names_bars_and_time(n, interval):
    text = I.describe_horizon(n, interval)
    count, unit = text.split(" = next ")[1].split()
    assert text.startswith(f"{n} bar") and int(count) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] == n * I.interval_seconds(interval)


@given(st.integers(1, 99), st.sampled_from("hdwmy"))
def test_time_ranges_are_hours(n, unit):
    assert I.parse_time_range(f" {n}{unit.upper()} ").hours * 3600 == n * {"h": 3600, "d": 86400, "w": 604800, "m": 2592000, "y": 31536000}[unit]
    assert I.parse_time_range(None).hours is None and I.parse_time_range("ALL").hours is None


@pytest.mark.parametrize("bad", ["", " ", "0", "0 bars", "bars", "-3", "1.5h", "7q"])
def test_bad_bar_counts(bad):
    with pytest.raises(ValueError):
        I.bar_count(bad, "1h")


@given(st.integers(1, 10_000), st.sampled_from("smhdwy"), st.sampled_from(list(I.INTERVALS)))
def test_bars_cover_the_duration(n, unit, interval):
    bars = I.bars(f"{n}{unit}", interval)
    assert bars * I.interval_seconds(interval) >= I.duration_seconds(f"{n}{unit}") > (bars - 1) * I.interval_seconds(interval) or bars == 1


def test_the_entry_module_needs_no_session_to_import():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert said.returncode == 0, said.stderr
