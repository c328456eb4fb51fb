"""Series in blocks: the same results as window functions and pandas over whole series, with several tasks a series."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators import blocks

SCHEMA = "interval string, open_time timestamp_ntz, x double"
BY = ["interval"]


@pytest.fixture(scope="module")
def bars(spark):
    """Two series with gaps in time and in values, ties, and a level far from zero."""

    def make(n=700, level=0.0, seed=1):
        rows = []
        for name, step in (("1h", 3600), ("15m", 900)):
            r = random.Random(f"{seed}{name}")
            at = datetime(2024, 3, 1)
            for _ in range(n):
                at += timedelta(seconds=step * (1 if r.random() < 0.9 else r.randint(2, 400)))
                rows.append((name, at, None if r.random() < 0.1 else level + r.choice([r.gauss(0, 1), 0.5, -0.5])))
        return spark.createDataFrame(rows, SCHEMA).repartition(5)

    return make


def collected(df, *names):
    got = df.toPandas().sort_values(["interval", "open_time"]).reset_index(drop=True)
    return [got[n].to_numpy(dtype=float) for n in names]


def per_series(df, f):
    got = df.toPandas().sort_values(["interval", "open_time"])
    return np.concatenate([np.asarray(f(g["x"].astype(float).reset_index(drop=True)), float) for _, g in got.groupby("interval", sort=True)])


def tasks_a_series(df):
    """Partitions that rows of one series come from."""
    found = df.select("interval").rdd.mapPartitionsWithIndex(lambda i, rows: [(i, r[0]) for r in rows]).distinct().collect()
    return min(sum(name == s for _, s in found) for name in ("1h", "15m"))


def test_places_are_row_numbers(bars):
    df = bars()
    w = Window.partitionBy("interval").orderBy("open_time")
    got = blocks.numbered(df, BY, size=16, length="n").withColumn("want", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(Window.partitionBy("interval")))
    assert got.count() == df.count() and got.where("_place <> want OR n <> all").count() == 0


@pytest.mark.parametrize("n", [1, 5, 40])
def test_windows_in_blocks_are_windows(bars, n):
    df = bars()

    def make(keys, rows):
        w = R.trailing(n, *keys)
        return rows.withColumns({"s": R.std(F.col("x"), w, min(3, n)), "m": F.max("x").over(w), "k": F.count("x").over(w)})

    whole = collected(make(("interval",), df), "s", "m", "k")
    got = blocks.windowed(df, BY, n - 1, make, size=32)
    assert got.columns == [*df.columns, "s", "m", "k"]
    for a, b in zip(whole, collected(got, "s", "m", "k"), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-15)


def test_a_series_is_several_tasks(spark, bars):
    coalesce = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks_a_series(blocks.windowed(bars(), BY, 3, lambda keys, rows: rows.withColumn("m", F.max("x").over(R.trailing(4, *keys))), size=32)) > 1
        assert tasks_a_series(blocks.ewma_variance(bars(), BY, "x", 24, "v", "k", size=32)) > 1
        assert tasks_a_series(blocks.sliding(bars(), BY, "x", 8, 2, shares="s", size=32)) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", coalesce)


@pytest.mark.parametrize("span", [2, 24, 5000])
def test_ewma_by_composition(bars, span):
    df = bars()
    got = collected(blocks.ewma_variance(df, BY, "x", span, "v", "k", size=32), "v", "k")
    want = per_series(df, lambda x: (x * x).ewm(alpha=2 / (span + 1), adjust=False, ignore_na=True).mean())
    np.testing.assert_allclose(got[0], want, rtol=1e-12)
    np.testing.assert_array_equal(got[1], per_series(df, lambda x: x.notna().cumsum()))


def test_recurrence_with_its_own_factors(spark, bars):
    df = bars().withColumns({"a": F.sin(F.col("x") * 3) * 0.9, "b": F.col("x"), "s": F.lit(9.0)})
    got = df.transform(lambda d: blocks.recurrence(d, BY, "a", "b", "s", "y", size=16)).toPandas().sort_values(["interval", "open_time"])
    for _, g in got.groupby("interval"):
        y = None
        for a, b, out in g[["a", "b", "y"]].itertuples(index=False):
            if not np.isnan(b):
                y = 9.0 if y is None else a * y + b
            assert (y is None and np.isnan(out)) or out == pytest.approx(y, rel=1e-12, abs=1e-12)


def test_last_value_over_many_blocks(bars):
    df = bars()
    kept = F.when(F.abs("x") > 1.8, F.col("x"))
    whole = df.withColumn("l", F.last(kept, ignorenulls=True).over(R.expanding("interval")))
    got = blocks.running_last(df, BY, {"l": kept, "m": F.col("x")}, size=16)
    np.testing.assert_array_equal(*(collected(d, "l")[0] for d in (whole, got)))
    np.testing.assert_array_equal(collected(got, "m")[0], per_series(df, lambda x: x.ffill()))


@pytest.mark.parametrize(("n", "least"), [(1, 1), (7, 3), (60, 20)])
def test_sliding_ranks_and_quantiles(bars, n, least):
    df = bars()
    got = collected(blocks.sliding(df, BY, "x", n, least, shares="s", quantiles={"q4": 0.4, "q1": 1.0}, size=32), "s", "q4", "q1")

    def share(x):
        out = []
        for i in range(len(x)):
            a = x.iloc[max(0, i - n + 1) : i + 1].dropna()
            out.append((a <= a.iloc[-1]).mean() if len(a) >= least else np.nan)
        return out

    np.testing.assert_allclose(got[0], per_series(df, share), rtol=1e-14)
    np.testing.assert_allclose(got[1], per_series(df, lambda x: x.rolling(n, least).quantile(0.4)), rtol=1e-12, atol=1e-14)
    np.testing.assert_allclose(got[2], per_series(df, lambda x: x.rolling(n, least).max()), rtol=1e-14)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 9)), max_size=120), st.integers(1, 6))
def test_buckets_are_a_sorted_multiset(steps, load):
    held, plain = blocks.SortedBuckets(load), []
    for add, x in steps:
        if add or x not in plain:
            held.add(x)
            plain.append(x)
        else:
            held.remove(x)
            plain.remove(x)
        plain.sort()
        assert [held.select(i) for i in range(held.size)] == plain
        assert [held.at_most(k) for k in range(-1, 11)] == [sum(p <= k for p in plain) for k in range(-1, 11)]


@pytest.mark.parametrize("parts", [3, 16])
@pytest.mark.parametrize("until", [0, -1])
def test_expanding_quantiles_read_a_part_of_the_past(bars, parts, until):
    df = bars()
    limits = {"q75": ("x", 0.75), "q40": ("x", 0.4), "q0": ("x", 0.0), "q1": ("x", 1.0)}
    got = collected(blocks.expanding_quantiles(df, BY, limits, 10, until, parts=parts, size=32), *limits)
    for values, (_, q) in zip(got, limits.values(), strict=True):
        want = per_series(df, lambda x, q=q: x.expanding(10).quantile(q).shift(-until))
        np.testing.assert_allclose(values, want, rtol=1e-12, atol=1e-14)


def test_expanding_quantiles_of_constant_and_trending_series(spark):
    at = datetime(2024, 1, 1)
    for kind, value in {"constant": lambda i: 5.0, "rising": float, "falling": lambda i: -float(i), "jump": lambda i: float(i % 7 + 1000 * (i > 200)), "none": lambda i: None}.items():
        df = spark.createDataFrame([("1h", at + timedelta(hours=i), value(i)) for i in range(400)], SCHEMA)
        got = collected(blocks.expanding_quantiles(df, BY, {"q": ("x", 0.75)}, 3, parts=8, size=20), "q")[0]
        np.testing.assert_allclose(got, per_series(df, lambda x: x.expanding(3).quantile(0.75)), rtol=1e-12, err_msg=kind)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=40), st.lists(st.integers(0, 8), min_size=1, max_size=30), st.sampled_from([0.0, 0.25, 0.4, 0.75, 1.0]))
def test_past_quantiles_walk_the_chain(past, xs, q):
    got = blocks.past_quantiles(np.sort(np.array(past, float)), 0, len(past), np.array(xs, float), q)
    want = [np.quantile(np.array(past + xs[: j + 1], float), q) for j in range(len(xs))]
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("level", [0.0, 1e6, -3e9])
def test_lag_correlation_does_not_see_the_level(bars, level):
    df = bars(level=level)

    def plain(x, n=24, least=8):
        out = []
        for i in range(len(x)):
            a = x.iloc[max(0, i - n + 1) : i + 1].dropna().to_numpy()
            if len(a) < least:
                out.append(np.nan)
                continue
            p, q = a[:-1] - a[:-1].mean(), a[1:] - a[1:].mean()
            out.append(p @ q / np.sqrt((p @ p) * (q @ q)) if np.ptp(a[:-1]) and np.ptp(a[1:]) else 0.0)
        return out

    got = collected(blocks.lag_correlation(df, BY, "x", 24, 8, "c", size=32), "c")[0]
    np.testing.assert_allclose(got, per_series(df, plain), atol=1e-9 if abs(level) < 1e7 else 1e-6)


def test_lag_correlation_after_an_outlier_and_on_constants():
    x = np.array([1e8, *np.sin(np.arange(60.0)), *[0.25] * 40, *np.cos(np.arange(30.0))])
    got = blocks.lagged(x, 10, 4)
    for i in range(9, len(x)):
        a = x[i - 9 : i + 1]
        want = np.corrcoef(a[:-1], a[1:])[0, 1] if np.ptp(a[:-1]) and np.ptp(a[1:]) else 0.0
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_times_are_cut_the_same_in_every_zone(spark, bars):
    df = bars()
    before = spark.conf.get("spark.sql.session.timeZone")
    want = collected(blocks.numbered(df, BY, size=16), "_place")[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # a night in March lacks an hour there
    try:
        got = collected(blocks.numbered(df, BY, size=16), "_place")[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    np.testing.assert_array_equal(got, want)


def test_a_million_bars_in_linear_time(spark):
    n = 300_000
    df = spark.range(0, n, 1, 8).select(F.lit("1m").alias("interval"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("open_time"), F.randn(7).alias("x"))
    x = pd.Series(collected(df, "x")[0])
    got = collected(blocks.ewma_variance(df, BY, "x", 48, "v", "k"), "v")[0]
    np.testing.assert_allclose(got, (x * x).ewm(alpha=2 / 49, adjust=False).mean(), rtol=1e-12)
    got = collected(blocks.expanding_quantiles(df, BY, {"q": ("x", 0.75)}, 30), "q")[0]
    np.testing.assert_allclose(got, x.expanding(30).quantile(0.75), rtol=1e-12)
