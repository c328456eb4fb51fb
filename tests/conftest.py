from __future__ import annotations

import math
import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def make_candles(spark):
    """Hourly bars: a seeded random walk for each symbol, with volumes and spreads of its own."""
    from tidegauge.sources.candles import CANDLE_SCHEMA

    def make(symbols=("AAA", "BBB", "CCC"), periods=60, skip=(), change=None, closed=True):
        rows = []
        for s in symbols:
            r = random.Random(f"bars of {s}")
            price = r.uniform(20, 400)
            for i in range(periods):
                first, price = price, price * math.exp(r.gauss(0, 0.02))
                last = change(s, i, price) if change else price
                spread = r.uniform(0, 0.01)
                at = datetime(2023, 3, 7) + timedelta(hours=i)
                if (s, i) not in skip:
                    high, low = max(first, last) * (1 + spread), min(first, last) * (1 - spread)
                    rows.append((s, "1h", at, at + timedelta(minutes=59, seconds=59), first, high, low, last, r.uniform(1, 9e4), closed))
        return spark.createDataFrame(rows, CANDLE_SCHEMA)

    return make
