"""Candidates with equal losses share a rank, as in SQL: naive and constant mean forecast the same variance."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import lab, simulation
from tidegauge.plans.models import CHOSEN, STRIDE, H, T

NAIVE, CONSTANT = "naive_mean:log_return", "constant_mean:log_return"


@pytest.fixture(scope="module")
def values():
    """A series in which, at two of its twenty-one origins, the two variances differ in their last bit if each is taken from its residuals."""
    return np.round(np.random.default_rng(46).normal(0, 0.01, T + 20 * STRIDE + 1), 6)


@pytest.fixture(scope="module")
def returns(spark, values):
    rows = [("BASKET", "log_return", datetime(2021, 5, 1) + timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, target string, open_time timestamp_ntz, y double")


@pytest.fixture(scope="module")
def lines(returns):
    points = lab.indexed(returns, ["symbol", "target"])
    origins = lab.origin_frame(points, ["symbol"], T, H, STRIDE)
    return lab.timeline(lab.with_losses(lab.fits(points, CHOSEN, ["symbol"], origins, T, H)), ["symbol"]).cache()


@pytest.fixture(scope="module")
def ranks(values):
    """Ranks by QLIKE at each origin, one variance for both candidates."""
    out = {s.candidate: [] for s in CHOSEN}
    for i in range(T - 1, len(values) - H, STRIDE):
        window, change = values[i - T + 1 : i + 1][None, :], values[i + H] ** 2
        forecast = {s.candidate: float(lab.fit(s.model_id, window)["variance"][0]) for s in CHOSEN}
        forecast[CONSTANT] = forecast[NAIVE]
        losses = {c: change / v + np.log(v) for c, v in forecast.items()}
        order = sorted(set(losses.values()))
        for c, x in losses.items():
            out[c].append(1 + order.index(x))
    return out


def by_candidate(rows, *order):
    out = {}
    for x in rows.orderBy(*order).collect():
        out.setdefault(x["candidate"], []).append(x["rank"])
    return out


def test_timeline_ranks_equal_losses_alike(lines, ranks):
    assert by_candidate(lines, "origin") == ranks


def test_heatmap_ranks_equal_losses_alike(lines, ranks):
    assert by_candidate(lab.rank_heatmap(lines, ["symbol"]), "realization_time") == ranks


def test_stability_of_equal_losses(lines, ranks):
    got = {x["candidate"]: x["rank_stability"] for x in lab.rank_stability(lines, ["symbol"]).collect()}
    assert got == pytest.approx({c: 1 / (1 + np.abs(np.diff(r)).mean()) for c, r in ranks.items()}, abs=1e-12)


def test_simulation_steps_rank_equal_losses_alike(returns, ranks):
    steps = simulation.steps(returns, CHOSEN, T, H, STRIDE)
    assert by_candidate(steps, "origin") == ranks
    pairs = steps.where(F.col("candidate").isin(NAIVE, CONSTANT)).groupBy("origin").agg(F.countDistinct("rmse_loss").alias("n"))
    assert pairs.where("n <> 1").count() == 0


def test_evaluation_of_equal_losses(returns, ranks):
    got = {x["candidate"]: x["rank_stability"] for x in simulation.model_evaluation(simulation.steps(returns, CHOSEN, T, H, STRIDE)).collect()}
    assert got == pytest.approx({c: 1 / (1 + np.std(r)) for c, r in ranks.items()}, abs=1e-12)


@pytest.fixture(scope="module")
def board(spark):
    """Three candidates; the means of the first two are the same values added up in two orders."""
    forth, back = ((0.1 + 0.2) + 0.3) / 3, ((0.3 + 0.2) + 0.1) / 3
    assert forth != back
    rows = [
        ("BASKET", NAIVE, "naive_mean", True, 3.0, 3.0, 3.0, max(forth, back), max(forth, back), max(forth, back)),
        ("BASKET", CONSTANT, "constant_mean", True, 3.0, 3.0, 3.0, min(forth, back), min(forth, back), min(forth, back)),
        ("BASKET", "realized_vol:log_return", "realized_vol", True, 4.0, 4.0, 4.0, 0.5, None, 0.5),
    ]
    names = "symbol string, candidate string, model_id string, converged boolean, aic double, bic double, hqic double, avg_qlike double, avg_rmse double, avg_mae double"
    stage, stability = spark.createDataFrame(rows, names), spark.createDataFrame([("BASKET", r[1], 0.5) for r in rows], "symbol string, candidate string, rank_stability double")
    return lab.leaderboard(stage, stability, ["symbol"], lab.specs_frame(spark, CHOSEN))


def test_leaderboard_ranks_equal_means_alike(board):
    got = {x["candidate"]: (x["rank"], x["composite_rank_score"]) for x in board.collect()}
    assert got == {NAIVE: (1, 8.0), CONSTANT: (2, 8.0), "realized_vol:log_return": (3, 2 + 2 + 2 + 2 * 2 + 3 + 2 + 1)}


def test_uncertainty_of_equal_means_is_high(board):
    (got,) = lab.model_uncertainty(board, ["symbol"]).collect()
    assert (got["candidate"], got["gap"], got["uncertainty"]) == (NAIVE, 0.0, "high")
