"""Registered queries of the lab agree with their SQL on drawn closes, where two variances differ in their last bit if each is taken from its residuals."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegauge.plans import models  # noqa: F401  registers the queries
from tidegauge.plans.base import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """One close of one symbol in each of a thousand hours: no mean over symbols, whose order of addition is open."""
    closes = np.round(np.random.default_rng(388).lognormal(3.5, 0.8, 1000), 2)
    rows = [(i, datetime(2020, 2, 1) + timedelta(hours=i, minutes=7), 1, "view", float(x), "{}") for i, x in enumerate(closes)]
    d = str(tmp_path_factory.mktemp("drawn"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def differences(spark, events, name):
    """(rows of the query, rows of its SQL) that the other one lacks, and how many rows the SQL has."""
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
    want = {tuple(round(x, 5) if isinstance(x, float) else x for x in row) for row in db.execute(SQL[name]).fetchall()}
    got = {tuple(round(x, 5) if isinstance(x, float) else x for x in row) for row in QUERIES[name](spark, events).collect()}
    return got - want, want - got, len(want)


def test_model_uncertainty(spark, events):
    assert differences(spark, events, "model_uncertainty") == (set(), set(), 1)


def test_rank_heatmap(spark, events):
    assert differences(spark, events, "rank_heatmap") == (set(), set(), 160)


def test_rank_stability(spark, events):
    assert differences(spark, events, "rank_stability") == (set(), set(), 4)


def test_simulation_steps(spark, events):
    assert differences(spark, events, "simulation_steps") == (set(), set(), 160)
