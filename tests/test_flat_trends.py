"""A trend of slope zero forecasts the variance of the means' residuals, so its losses and ranks are theirs."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegauge.operators import lab, simulation
from tidegauge.plans.models import CHOSEN, STRIDE, H, T

NAIVE, CONSTANT, TREND = "naive_mean:log_return", "constant_mean:log_return", "rolling_ols_trend:log_return"


def mirrored(seed, turns):
    """Blocks of half a window; where the turn is true a block is the last one, reversed, so that the window has no slope."""
    r, out = np.random.default_rng(seed), []
    for turn in turns:
        out.append(out[-1][::-1] if turn else np.round(r.normal(0, 1, T // 2), 6))
    return np.concatenate([*out, out[-1][:H]])


def windows(values):
    at = np.arange(T - 1, len(values) - H, STRIDE)
    return at, np.lib.stride_tricks.sliding_window_view(values, T)[at - T + 1]


def frame(spark, values):
    rows = [("BASKET", "log_return", datetime(2022, 8, 1) + timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, target string, open_time timestamp_ntz, y double")


def fitted(returns, chosen):
    points = lab.indexed(returns, ["symbol", "target"])
    origins = lab.origin_frame(points, ["symbol"], T, H, STRIDE)
    return lab.with_losses(lab.fits(points, chosen, ["symbol"], origins, T, H))


@pytest.fixture(scope="module")
def values():
    """At sixteen of twenty-three origins the window has no slope; at three of these the loss differs in its last bits with the variance of the line's residuals."""
    return mirrored(68, [k % 3 != 0 for k in range(24)])


@pytest.fixture(scope="module")
def returns(spark, values):
    return frame(spark, values)


@pytest.fixture(scope="module")
def lines(returns):
    return lab.timeline(fitted(returns, CHOSEN), ["symbol"]).cache()


@pytest.fixture(scope="module")
def ranks(values):
    """Ranks by QLIKE at each origin, with one variance for the means and a trend without slope."""
    out = {s.candidate: [] for s in CHOSEN}
    for i, window in zip(*windows(values)):
        forecast = {s.candidate: float(lab.fit(s.model_id, window[None, :])["variance"][0]) for s in CHOSEN}
        if (window == window[::-1]).all():
            forecast[TREND] = forecast[NAIVE]
        losses = {c: values[i + H] ** 2 / v + np.log(v) for c, v in forecast.items()}
        order = sorted(set(losses.values()))
        for c, x in losses.items():
            out[c].append(1 + order.index(x))
    return out


def by_candidate(rows, *order):
    out = {}
    for x in rows.orderBy(*order).collect():
        out.setdefault(x["candidate"], []).append(x["rank"])
    return out


def test_variance_of_a_steep_line_is_that_of_its_residuals():
    t = np.arange(T, dtype=float)
    e = np.where(np.arange(T) % 2 == 0, 1e-3, -1e-3)
    got, line = lab.fit("rolling_ols_trend", (1e3 + 5 * t + e)[None, :]), np.polyfit(t, e, 1)
    assert got["variance"][0] == pytest.approx((e - np.polyval(line, t)).var(ddof=1), rel=1e-6)


def test_evaluation_with_a_flat_trend(returns, ranks):
    got = {x["candidate"]: x["rank_stability"] for x in simulation.model_evaluation(simulation.steps(returns, CHOSEN, T, H, STRIDE)).collect()}
    assert got == pytest.approx({c: 1 / (1 + np.std(r)) for c, r in ranks.items()}, abs=1e-12)


def test_uncertainty_of_a_flat_trend(spark):
    """No window has a slope, so the constant mean and the trend differ in three criteria only; by rounding the line of every other window would rank alone."""
    two = [s for s in CHOSEN if s.candidate in (CONSTANT, TREND)]
    rows = fitted(frame(spark, mirrored(7, [k > 0 for k in range(9)])), two)
    board = lab.leaderboard(lab.evaluate(rows, ["symbol"]), lab.rank_stability(lab.timeline(rows, ["symbol"]), ["symbol"]), ["symbol"], lab.specs_frame(spark, two))
    (got,) = lab.model_uncertainty(board, ["symbol"]).collect()
    assert (got["candidate"], got["gap"], got["uncertainty"]) == (CONSTANT, 3.0, "moderate")


def test_heatmap_ranks_a_flat_trend_with_the_means(lines, ranks):
    assert by_candidate(lab.rank_heatmap(lines, ["symbol"]), "realization_time") == ranks


def test_stability_with_a_flat_trend(lines, ranks):
    got = {x["candidate"]: x["rank_stability"] for x in lab.rank_stability(lines, ["symbol"]).collect()}
    assert got == pytest.approx({c: 1 / (1 + np.abs(np.diff(r)).mean()) for c, r in ranks.items()}, abs=1e-12)


def test_simulation_steps_rank_a_flat_trend_with_the_means(returns, values, ranks):
    steps = simulation.steps(returns, CHOSEN, T, H, STRIDE)
    assert by_candidate(steps, "origin") == ranks
    at, seen = windows(values)
    flat = {int(i) for i, w in zip(at, seen) if (w == w[::-1]).all()}
    losses = {(x["origin"], x["candidate"]): x["rmse_loss"] for x in steps.collect()}
    assert len(flat) == 16 and all(losses[i, TREND] == losses[i, NAIVE] for i in flat)
