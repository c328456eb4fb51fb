"""Read-models, ranges, settings, history before live bars, logs and runs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import settings
from tidegauge.operators import evaluation, lab, views
from tidegauge.sources import store
from tidegauge.streaming import live

START = datetime(2022, 8, 1)


@pytest.fixture(scope="module")
def frame(spark):
    """Ninety bars of returns and forecasts, regimes and shocks."""
    r = np.random.default_rng(11)
    rows = [
        (
            "1h", START + timedelta(hours=i), float(r.normal(0, 0.02)), *(float(v) for v in r.uniform(0.01, 0.03, 3)), float(r.uniform(90, 110)),
            "CALM" if i % 3 else "WILD", "NORMAL" if i % 10 else "BIG", None if i == 80 else float(i),
        )
        for i in range(90)
    ]
    schema = "interval string, open_time timestamp_ntz, basket_return double, garch_vol double, ewma_vol double, market_vol double, basket_price double, regime string, shock_type string, shock_score double"
    return spark.createDataFrame(rows, schema).withColumn("forecast_vol", F.col("garch_vol"))


def test_series_end_with_their_last_values(frame):
    got = views.series_tails(views.derived(frame), ["shock_score", "log_price", "standardized_residual", "absent"], 12).toPandas()
    scores = got[got["name"] == "shock_score"].sort_values("time")["value"].tolist()
    assert scores == [float(i) for i in range(77, 90) if i != 80]
    assert set(got["name"]) == {"shock_score", "log_price", "standardized_residual"} and set(got.groupby("name").size()) == {12}
    codes = views.label_codes(frame, "regime", 5).toPandas()
    assert set(zip(codes["label"], codes["value"])) == {("CALM", 1), ("WILD", 2)} and len(codes) == 5
    only = views.label_codes(frame.withColumn("regime", F.when(F.hour("open_time") > 0, F.col("regime"))).where("regime = 'WILD'"), "regime", 5).toPandas()
    assert set(only["value"]) == {1}


def test_json_has_no_nan(spark):
    df = spark.sql("select timestamp_ntz'2022-08-01 05:06:07' as t, double('nan') as a, array(1.5D, double('inf')) as b, map('k', double('nan')) as c, named_struct('x', double('nan'), 'y', 2) as d, cast(null as struct<z:double>) as e, 'ä' as f")
    got = json.loads(views.json_rows(df).first()["value"])
    assert got == {"t": "2022-08-01T05:06:07+00:00", "a": None, "b": [1.5, None], "c": {"k": None}, "d": {"x": None, "y": 2}, "e": None, "f": "ä"}
    assert views.json_rows(df.limit(0)).count() == 0


def test_board_view_filters(spark):
    board = spark.createDataFrame([("a", "mean", 1, 3.0), ("b", "trend", 2, float("nan")), ("c", "mean", 3, 1.0), ("d", "mean", 4, None)], "candidate string, family string, rank int, avg_qlike double")
    names = lambda df: [r["candidate"] for r in df.orderBy("rank").collect()]
    assert names(views.board_view(board, 3, family="mean")) == ["a", "c"]
    assert names(views.board_view(board, 0, family="")) == names(views.board_view(board)) == ["a", "b", "c", "d"]
    assert names(evaluation.qlike_ranking(board)) == ["c", "a", "b", "d"]


def test_a_range_uses_nothing_from_before_it(frame):
    view = views.on_range(frame, "1d", {"garch": "garch_vol", "ewma": "ewma_vol", "naive": "market_vol"})
    assert view.rows.count() == 24 and view.pairs.count() == 23
    rows = {r["view"]: r for r in views.range_status(frame, {"day": "1d", "year": "1y", "whole": "all"}).collect()}
    assert (rows["day"]["actual_points"], rows["day"]["expected_points"], rows["day"]["start"]) == (24, 24, START + timedelta(hours=66))
    assert (rows["year"]["actual_points"], rows["year"]["expected_points"]) == (90, 8760) and rows["whole"]["expected_points"] is None
    none = views.range_status(frame.limit(0), {"day": "1d"}).first()
    assert none["actual_points"] == 0 and none["end"] is None


def test_tests_in_one_pass_agree_with_each_alone(frame):
    """The diagnostics against the functions for one test each."""
    pairs = evaluation.aligned(frame)
    z = pairs.withColumn("z", F.col("return") / F.col("garch")).withColumn("z2", F.col("z") * F.col("z"))
    loss = evaluation.losses(pairs).withColumn("e", F.col("garch_qlike") - F.col("ewma_qlike")).withColumn("v", F.col("garch_qlike") - F.col("naive_qlike"))
    alone = {
        "Ljung-Box residuals": evaluation.with_p_value(evaluation.ljung_box(z, "z", 10), "chi2", "10"),
        "Ljung-Box squared residuals": evaluation.with_p_value(evaluation.ljung_box(z, "z2", 10), "chi2", "10"),
        "ARCH-LM": evaluation.arch_lm(z, "z", 10), "Diebold-Mariano vs EWMA": evaluation.with_p_value(evaluation.hac_mean(loss, "e"), "normal"),
        "GARCH vs naive QLIKE": evaluation.with_p_value(evaluation.hac_mean(loss, "v"), "normal"),
        "Mincer-Zarnowitz": evaluation.with_p_value(evaluation.mincer_zarnowitz(pairs), "t", "n - 2"), "Kupiec VaR coverage": evaluation.with_p_value(evaluation.kupiec(pairs), "chi2", "1"),
    }
    got = {r["name"]: r for r in evaluation.diagnostics(frame, {"alpha[1]": 0.1, "beta[1]": 0.8, "nu": 1.5}, labelled=frame).collect()}
    for name, df in alone.items():
        one = df.first()
        assert got[name]["statistic"] == pytest.approx(one["statistic"], rel=1e-7), name
        assert got[name]["p_value"] == pytest.approx(one["p_value"], rel=1e-6), name
        assert got[name]["n"] == one["n"], name
    for r in evaluation.forecast_losses(pairs).collect():
        assert got[r["name"]]["statistic"] == pytest.approx(r["statistic"])
    assert (got["Regime concentration"]["statistic"], got["Shock count"]["statistic"]) == (60 / 90, 9.0)
    assert got["alpha + beta < 1"]["decision"] == "pass diagnostic" and got["nu > 2"]["decision"] == "fail diagnostic"
    few = {r["decision"] for r in evaluation.diagnostics(frame.where(f"open_time < timestamp_ntz'{START + timedelta(hours=6)}'")).collect()}
    assert few == {"insufficient sample"} and evaluation.diagnostics(frame.limit(0)).count() == 0


def test_concentration(frame):
    got = evaluation.concentration(frame.withColumn("regime", F.when(F.col("shock_score") > 9, F.col("regime"))), "regime", "CALM").first()
    assert (got["n"], got["rows"]) == (79, 90) and got["unusual"] == 26 and got["max_share"] == 53 / 79


def test_snapshot_is_bounded_and_json(frame, make_candles):
    full = frame.withColumn("avg_pairwise_corr", F.lit(0.5)).withColumn("pca1_share", F.lit(float("nan")))
    got = json.loads(views.snapshot(make_candles(periods=40), full, "1h", losses=evaluation.losses(evaluation.aligned(frame))).as_json())
    assert len(got["recent_candles"]) == 80 and len(got["market_rows"]) == 3 and len(got["validation_losses"]) == 89
    assert got["data_quality"] == [{"status": "ok", "is_valid": True, "issue_count": 0}]
    assert got["latest"][0]["pca1_share"] is None and not [x for x in got["series"] if x["name"] == "pca1_share"]
    steps = {r["stage"]: r for r in views.method_steps(full).collect()}
    assert [steps[s]["value"] for s in ("shock", "regime")] == [89.0, None] and steps["regime"]["label"] == "CALM" and len(steps) == 6


@pytest.mark.parametrize("name, value", [("symbols", [" "]), ("interval", "7m"), ("analysis_period", "ever"), ("forecast_horizon_bars", 0), ("search_mode", "slow"), ("target_view", 3), ("pca_window", "30"), ("symbols", 5)])
def test_an_error_names_the_setting(name, value):
    with pytest.raises(ValueError, match=f"^{name}: "):
        settings.Settings(**{name: value})


def test_settings_are_normalised():
    got = settings.Settings(symbols=[" abc ", ""], interval="1H", search_mode=" Two-Stage", candidate_model_groups=[], refit_stride_bars=-3)
    assert got.symbols == ("ABC",) and got.interval == "1h" and got.search_mode == "two_stage" and got.refit_stride_bars == 1
    assert got.candidate_model_groups == settings.GROUPS


def test_settings_from_a_file(tmp_path):
    file = tmp_path / "s.toml"
    assert settings.load(file) == settings.Settings()
    file.write_text('symbols = [" aaa ", ""]\ninterval = "1H"\nsearch_mode = "Two-Stage"\nvolatility_window = "2d"\nrefit_stride_bars = 0\n')
    got = settings.load(file)
    assert (got.symbols, got.interval, got.search_mode, got.windows.short, got.refit_stride_bars) == (("AAA",), "1h", "two_stage", 48, 1)
    assert settings.Settings().windows.medium == 672
    for bad in ('colour = "red"', "symbols = []", 'search_mode = "slow"', 'target_view = "x"', "forecast_horizon_bars = 0", 'backtest_time_range = "soon"'):
        file.write_text(bad)
        with pytest.raises(ValueError):
            settings.load(file)


def test_history_is_fetched_from_where_the_store_ends(spark, make_candles, tmp_path):
    root = str(tmp_path / "bars")
    bars = make_candles(("AAA", "BBB"), periods=30)
    first, last = (bars.agg(f("open_time")).first()[0] for f in (F.min, F.max))
    store.upsert(spark, root, bars.where("symbol = 'AAA'").where(F.col("open_time") < first + timedelta(hours=12)), 0)
    asked = []

    def fetch(names, start, end):
        asked.append((tuple(names), start))
        return bars.where(F.col("symbol").isin(names) & F.col("open_time").between(start, end))

    assert live.backfill(spark, root, ["aaa", "bbb"], "1h", first, last, fetch) == "LIVE"
    assert sorted(asked) == [(("AAA",), first + timedelta(hours=12)), (("BBB",), first)]
    assert store.read_candles(spark, root).count() == 60
    assert live.backfill(spark, root, ["aaa", "bbb"], "1h", first, last, fetch) == "LIVE" and len(asked) == 2

    def broken(*_):
        raise OSError("no network")

    assert live.backfill(spark, root, ["ccc"], "1h", first, last, broken) == "DEGRADED"
    assert live.backfill(spark, str(tmp_path / "none"), ["ccc"], "1h", first, last, lambda *_: bars.limit(0)) == "DEGRADED"


def test_logs_runs_and_artifacts(spark, tmp_path):
    log = store.Log(spark, str(tmp_path))
    assert log.tail().count() == 0
    log.write("one", "two")
    log.write("three")
    assert [r["message"] for r in log.tail(2).collect()] == ["three", "two"]
    runs = store.Runs(spark, str(tmp_path / "runs"))
    run = runs.create({"bars": 5})
    runs.mark(run, "running")
    runs.append("scores", run, spark.range(3).withColumnRenamed("id", "step"))
    assert runs.load(run) == {"run_id": run, "status": "running", "spec": {"bars": 5}}
    assert runs.latest("scores", run, "step")["step"] == 2
    with pytest.raises(KeyError):
        runs.load("nothing")
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))
    assert store.save_artifacts({"a/a.parquet": spark.range(2), "b.parquet": None, "c.parquet": bad}, str(tmp_path / "out")) == ["a/a.parquet"]
    assert store.load_frame(spark, str(tmp_path / "out/a/a.parquet")).count() == 2


def test_forecasts_of_symbols_and_basket(spark):
    r = np.random.default_rng(3).normal(0, 0.02, (30, 2))
    rows = [(s, START + timedelta(hours=i), float(r[i, j]) if i else None) for i in range(30) for j, s in enumerate("AB")]
    got = {x["symbol"]: x for x in lab.forecast_service(spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, log_return double"), 12).collect()}
    assert set(got) == {"A", "B", "BASKET"} and {x["refit_countdown"] for x in got.values()} == {7} and all(x["degraded"] for x in got.values())
    now = datetime(2022, 8, 20)
    assert lab.selection_due(None, now) and lab.selection_due(now - timedelta(days=7), now) and not lab.selection_due(now - timedelta(days=6), now)
