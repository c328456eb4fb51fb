"""The lab, tests and tails against numpy; stores and streams."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.operators import evaluation, lab, labels, quality
from tidegauge.sources import rest, store
from tidegauge.streaming import live

START = datetime(2021, 5, 1)


def series(spark, y, **more):
    rows = [(START + timedelta(hours=i), float(v), *more.values()) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "open_time timestamp_ntz, y double" + "".join(f", {k} string" for k in more))


@pytest.fixture(scope="module")
def walk():
    return np.random.default_rng(4).normal(0.1, 1.0, 90)


def recursion(e, base):
    v = base
    for x in e:
        v = 0.05 * base + 0.08 * x * x + 0.90 * v
    return v


def test_fits_match_plain_formulas(walk):
    """Forecasts of all eighteen candidates, each written out for one window."""
    y, n = walk, len(walk)
    ones = np.ones(n)

    def regress(z, p):
        x = np.column_stack([np.ones(len(z) - p), *(z[p - k : len(z) - k] for k in range(1, p + 1))])
        b = np.linalg.lstsq(x, z[p:], rcond=None)[0]
        return b[0] + sum(b[k] * z[-k] for k in range(1, p + 1)), z[p:] - x @ b

    def smooth(z):
        e, before = [], 0.0
        for v in z - z.mean():
            before = v - 0.35 * before
            e.append(before)
        return z.mean() + 0.35 * before, np.array(e)

    a1, e1 = regress(y, 1)
    d1, ed = regress(np.diff(y), 1)
    s1, es = regress(y[24:] - y[:-24], 1)
    both, eb = smooth(e1)
    t = np.polyfit(np.arange(n), y, 1)
    want = {
        "constant_mean": (y.mean(), y - y.mean()), "ar_1": (a1, e1), "ar_2": regress(y, 2), "ma_1": smooth(y), "arma_1_1": (a1 + both, eb),
        "arima_1_1_0": (y[-1] + d1, ed), "rolling_ols_trend": (np.polyval(t, n), y - np.polyval(t, np.arange(n))), "seasonal_ar_1": (y[-24] + s1, es),
        "stl_trend": (y[-24], y - y[-24:].mean()),
    }
    for model, (mean, e) in want.items():
        got = lab.fit(model, y[None, :])
        assert got["mean"][0] == pytest.approx(mean, abs=1e-9) and got["variance"][0] == pytest.approx(e.var(ddof=1), rel=1e-9), model
    for model, (mean, e) in {"ar_1_garch": (0.0, y), "arima_1_1_0_garch": (y[-1] + d1, ed), "arch_1": (0.0, y), "garch_1_1": (0.0, y)}.items():
        got = lab.fit(model, y[None, :])
        if model.startswith("ar_") or model.startswith("arima"):
            mean, e = lab.mean_model(model, y[None, :])[:2]
            mean, e = mean[0], e[0]
        assert got["variance"][0] == pytest.approx(recursion(e, e.var(ddof=1)), rel=1e-9), model
    span = min(30, max(4, n // 3))
    assert lab.fit("realized_vol", y[None, :])["variance"][0] == pytest.approx(y[-span:].var(ddof=1))
    assert lab.fit("ewma_vol", y[None, :])["variance"][0] == pytest.approx(pd.Series(y * y).ewm(span=span, adjust=False).mean().iloc[-1])
    assert not lab.fit("ar_1", ones[None, :3])["ok"][0]


def test_tails_match_known_quantiles():
    """Points at which the tails are known: two degrees of freedom are exponential, one degree of t is Cauchy, many are normal."""
    for x in (0.1, 1.0, 7.5, 40.0):
        assert tails.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert tails.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert tails.chi2_sf_approx(x, 10) == pytest.approx(tails.chi2_sf(x, 10), abs=6e-3)
        assert tails.t_sf(x, 1) == pytest.approx(0.5 - math.atan(x) / math.pi, rel=1e-9)
        assert tails.t_sf(x, 2) == pytest.approx(0.5 - x / (2 * math.sqrt(2 + x * x)), rel=1e-9)


def test_pacf_and_arch_lm_match_numpy(spark, walk):
    df = series(spark, walk, interval="1h")
    d = walk - walk.mean()
    rho = np.array([1.0] + [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 5)])
    want = [1.0] + [np.linalg.solve(rho[np.abs(np.subtract.outer(range(k), range(k)))], rho[1 : k + 1])[-1] for k in range(1, 5)]
    got = [r["pacf"] for r in evaluation.pacf(df, "y", 4).orderBy("lag").collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)
    s = walk**2
    x = np.column_stack([np.ones(len(s) - 3), s[2:-1], s[1:-2], s[:-3]])
    left = s[3:] - x @ np.linalg.lstsq(x, s[3:], rcond=None)[0]
    lm = len(left) * (1 - left @ left / ((s[3:] - s[3:].mean()) ** 2).sum())
    row = evaluation.arch_lm(df, "y", 3).first()
    assert row["statistic"] == pytest.approx(lm, rel=1e-8) and row["p_value"] == pytest.approx(tails.chi2_sf(lm, 3), rel=1e-8)


def test_garch_history(spark):
    r = np.random.default_rng(1)
    y, v = [], 1.0
    for _ in range(400):
        y.append(r.standard_t(8) * math.sqrt(v * 6 / 8))
        v = 0.05 + 0.15 * y[-1] ** 2 + 0.8 * v
    df = series(spark, [*y[:200], float("nan"), *y[200:]], symbol="a").union(series(spark, y[:50], symbol="b"))
    fits = lab.garch_fits(df, ["symbol"], every=30).persist()
    made = {x["refit"]: x for x in fits.collect()}
    assert set(made) == {*range(99, 400, 30), 399} and {x["symbol"] for x in made.values()} == {"a"}
    got = lab.garch_history(df, fits, ["symbol"]).orderBy("symbol", "open_time").collect()
    a, b = ([x for x in got if x["symbol"] == s] for s in "ab")
    smooth = np.sqrt(pd.Series(np.square(y)).ewm(span=24, adjust=False).mean())
    assert len(a) == 400 and len(b) == 50 and not any(x["fitted"] for x in b)
    last = None
    for i, x in enumerate(a):
        last = made[i]["volatility"] if i in made else last
        assert x["volatility"] == pytest.approx(smooth[i] if last is None else last)
    p, _ = lab.garch_t(np.array(y))
    assert 0 < p["alpha[1]"] + p["beta[1]"] < 1 and p["nu"] > 2
    full, cut = (lab.garch_t(np.array(z))[1] for z in (y[:160], [*y[:160]]))
    assert full == cut and lab.garch_t(np.array(y[:99])) is None


def test_each_series_keeps_its_own_candidates(spark):
    """Two series of opposite kinds: in the second stage each has only its own best of the first."""
    r = np.random.default_rng(7)
    wave = np.sin(np.arange(160) * 2 * math.pi / 24) + r.normal(0, 0.01, 160)
    noise = r.normal(0, 1, 160)
    df = series(spark, wave, symbol="wave", target="log_return").union(series(spark, noise, symbol="noise", target="log_return"))
    chosen = lab.specs(["mean", "trend"], "log_return", 10)
    got = lab.run_lab(df, ["symbol"], chosen, 60, 1, 4, "two_stage")
    first = got.stage1.select("symbol", "target", "candidate", "composite_rank_score", "avg_qlike", "ordinal")
    kept = {(x["symbol"], x["candidate"]) for x in lab.top_candidates(first, 5, ["symbol", "target"]).collect()}
    assert {(x["symbol"], x["candidate"]) for x in got.stage2.collect()} == kept
    assert len({c for _, c in kept}) > 5, "the two series chose alike, so this shows nothing"


def test_expanding_quantiles_in_one_pass(spark, walk):
    df = series(spark, walk, interval="1h").withColumn("z", F.when(F.col("y") > 0, F.col("y")))
    got = labels.expanding_quantiles(df, {"a": ("y", 0.75), "b": ("z", 0.4)}, 10, until=-1).orderBy("open_time").toPandas()
    y = pd.Series(walk)
    np.testing.assert_allclose(got["a"].astype(float), y.expanding(10).quantile(0.75).shift(1), atol=1e-12)
    np.testing.assert_allclose(got["b"].astype(float), y.where(y > 0).expanding(10).quantile(0.4).shift(1), atol=1e-12)


def test_validation_names_what_is_wrong(make_candles):
    bars = make_candles(periods=30, skip={("BBB", 9)})
    assert [(x["check"], x["symbol"], x["count"]) for x in quality.validate(bars, "1h", ["AAA", "BBB", "CCC"]).collect()] == [("missing", "BBB", 1)]
    bad = bars.withColumn("volume", F.when(F.col("symbol") == "AAA", -1.0).otherwise(F.col("volume")))
    got = {(x["check"], x["symbol"], x["count"]) for x in quality.validate(bad, "1h", ["AAA", "DDD"]).collect()}
    assert got == {("volume", None, 30), ("missing", "BBB", 1), ("coverage", "DDD", 1)}
    assert [x["check"] for x in quality.validate(bars.where("close < 0"), "1h").collect()] == ["empty"]


def test_store_keeps_the_last_and_runs_are_resumed(spark, make_candles, tmp_path):
    root = str(tmp_path / "bars")
    assert store.read_candles(spark, root).count() == 0
    bars = make_candles(periods=5)
    store.upsert(spark, root, bars, 0)
    fixed = bars.where("symbol = 'BBB'").limit(1).withColumn("close", F.lit(1.5))
    store.upsert(spark, root, fixed.unionByName(fixed.withColumn("is_closed", F.lit(False)).withColumn("close", F.lit(9.0))), 1)
    got = store.read_candles(spark, root)
    assert got.count() == 15 and [r["close"] for r in got.where("ingest_seq = 1").collect()] == [1.5]
    assert store.read_candles(spark, root, ["bbb"], "1h").count() == 5
    both = fixed.withColumn("volume", F.lit(1.0)).unionByName(fixed.withColumn("volume", F.lit(2.0))).withColumn("ingest_seq", F.lit(5))
    assert [r["volume"] for r in store.keep_last(both.repartition(2)).collect()] == [2.0]

    runs = store.Runs(spark, str(tmp_path / "runs"))
    done, left = runs.create({"n": 1}), runs.create({"n": 2})
    runs.mark(done, "completed")
    runs.append("steps", done, spark.range(4).withColumnRenamed("id", "step"))
    assert runs.interrupt_unfinished() == 1
    assert {r["run_id"]: r["status"] for r in runs.list().collect()} == {done: "completed", left: "interrupted"}
    assert [r["step"] for r in runs.tail("steps", done, 2, "step").collect()] == [3, 2]


def test_pages_move_on_and_stop():
    asked = []

    def fetch(url):
        asked.append(url)
        start, end, limit = (int(dict(p.split("=") for p in url.split("?")[1].split("&"))[k]) for k in ("startTime", "endTime", "limit"))
        return json.dumps([[t, "1"] for t in range(0, 1000, 10) if start <= t <= end][:limit])

    assert [r[0] for r in rest.pages(fetch, "u", "A", "1h", 15, 300, 7)] == list(range(20, 301, 10)) and len(asked) == 5
    assert list(rest.pages(lambda u: "[]", "u", "A", "1h", 0, 9)) == []


def test_a_stream_stores_what_a_batch_would(spark, tmp_path):
    """Messages in two files, with a correction, an open bar and a late bar; then a new checkpoint with another correction."""
    def message(i, close, closed=True):
        at = 1_600_000_000_000 // 3_600_000 * 3_600_000 + i * 3_600_000
        return json.dumps({"k": {"s": "abc", "i": "1h", "t": at, "T": at + 3_599_999, "o": "1", "h": "9", "l": "1", "c": str(close), "v": "3", "x": closed}})

    source, root = tmp_path / "in", str(tmp_path / "bars")
    source.mkdir()
    (source / "a").write_text("\n".join([message(2, 5), message(3, 6), message(4, 7, False)]))
    seen = []
    run = lambda name: live.store_closed(live.messages(spark, str(source)), root, str(tmp_path / name), lambda df, i: seen.append(df.count())).awaitTermination(120)
    run("first")
    (source / "b").write_text("\n".join([message(3, 8), message(1, 4)]))
    run("first")
    closes = lambda: [r["close"] for r in store.read_candles(spark, root).orderBy("open_time").collect()]
    assert closes() == [4.0, 5.0, 8.0] and seen == [2, 3]
    other = tmp_path / "late"
    other.mkdir()
    (other / "c").write_text(message(2, 2))
    live.store_closed(live.messages(spark, str(other)), root, str(tmp_path / "second")).awaitTermination(120)
    assert closes() == [4.0, 2.0, 8.0]
