import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators import features, labels
from tidegauge.operators.features import Windows

W = Windows(short=12, medium=16, long=24, trend=12)


def wide(candles):
    f = candles.toPandas().pivot(index="open_time", columns="symbol", values="close").sort_index()
    return f, np.log(f).diff()


def column(df, name):
    return df.toPandas().sort_values("open_time")[name].to_numpy(float)


@pytest.fixture(scope="module")
def gappy(make_candles):
    return make_candles(skip={("BBB", 20), ("BBB", 21), ("CCC", 40)}).cache()


def test_a_missing_bar_leaves_no_return_beside_it(gappy):
    got = features.log_returns(gappy).toPandas().pivot(index="open_time", columns="symbol", values="log_return").sort_index()
    _, want = wide(gappy)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), atol=1e-12)


def test_features_match_pandas(gappy):
    close, ret = wide(gappy)
    f = features.feature_bundle(gappy, "AAA", W).features.toPandas().sort_values("open_time").reset_index(drop=True)
    b = ret.mean(axis=1).reset_index(drop=True)
    vol = b.rolling(12, min_periods=3).std()
    np.testing.assert_allclose(f["market_vol"], vol, atol=1e-12)
    np.testing.assert_allclose(f["avg_asset_vol_short"], ret.rolling(12, min_periods=3).std().mean(axis=1), atol=1e-12)
    pairs = [("AAA", "BBB"), ("AAA", "CCC"), ("BBB", "CCC")]
    corr = pd.concat([ret[a].rolling(24, min_periods=6).corr(ret[c]) for a, c in pairs], axis=1).mean(axis=1).ffill()
    np.testing.assert_allclose(f["avg_pairwise_corr"], corr, atol=1e-9)
    beta = pd.concat([ret[s].rolling(16, min_periods=5).cov(ret["AAA"]) / ret["AAA"].rolling(16, min_periods=5).var() for s in ("BBB", "CCC")], axis=1).mean(axis=1)
    np.testing.assert_allclose(f["avg_btc_beta"], beta, atol=1e-9)
    np.testing.assert_allclose(f["vol_of_vol"], vol.rolling(16, min_periods=10).std(), atol=1e-12)
    share = vol.rolling(24, min_periods=10).apply(lambda x: (x[~np.isnan(x)] <= x[~np.isnan(x)][-1]).mean(), raw=True)
    np.testing.assert_allclose(f["vol_percentile"].astype(float), share, atol=1e-12)
    y = np.log(close.mean(axis=1)).to_numpy()
    slopes = [np.nan if i < 3 else np.polyfit(np.arange(min(12, i + 1)), y[max(0, i - 11) : i + 1], 1)[0] for i in range(len(y))]
    np.testing.assert_allclose(f["trend_slope"], slopes, atol=1e-9)


def test_pca_share_matches_numpy(gappy):
    _, ret = wide(gappy)
    got = column(features.pca_share(features.log_returns(gappy), 24, block=17), "pca1_share")
    want, last = [], np.nan
    for i in range(len(ret)):
        x = ret.iloc[max(0, i - 23) : i + 1].dropna(axis=1, how="all").dropna().to_numpy()
        if x.shape[1] >= 2 and len(x) >= 6:
            e = np.linalg.eigvalsh(np.cov(x, rowvar=False))
            last = e[-1] / e.sum()
        want.append(last)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_nothing_looks_ahead(make_candles):
    change = lambda s, i, p: p * (2 + (i * 7 + len(s)) % 5) if i >= 45 else p
    cut = F.lit("2023-03-08 20:00:00").cast("timestamp_ntz")

    def early(candles):
        b = features.feature_bundle(candles, "AAA", W)
        frame = labels.regimes(labels.forecast_series(b.features), 5)
        out = labels.shocks(frame, b.returns, 12).where(F.col("open_time") <= cut)
        return out.toPandas().sort_values("open_time").reset_index(drop=True)

    pd.testing.assert_frame_equal(early(make_candles()), early(make_candles(change=change)))


def test_constant_prices_give_nulls_not_errors(make_candles):
    f = features.feature_bundle(make_candles(change=lambda s, i, p: 5.0), "AAA", W).features.toPandas()
    assert f["avg_pairwise_corr"].isna().all() and (f["market_vol"].dropna() == 0).all() and (f["up_down_ratio"].dropna() == 0.5).all()


def test_missing_benchmark_and_single_symbol(make_candles):
    f = features.feature_bundle(make_candles(symbols=("AAA",)), "ZZZ", W).features.toPandas()
    assert f["avg_btc_beta"].isna().sum() >= len(f) - 60 and f["pca1_share"].isna().all()


def test_stride_is_exact_at_the_last_row(gappy):
    r = features.log_returns(gappy)
    exact, strided = (column(features.average_correlation(r, 24, s), "avg_pairwise_corr") for s in (None, 7))
    assert exact[-1] == strided[-1]


def test_shock_score_uses_the_forecast_before(spark):
    rows = [("1h", f"2026-01-01 0{i}:00:00", b, v) for i, (b, v) in enumerate([(0.0, 0.01), (0.02, 0.5), (0.01, 0.5)])]
    frame = spark.createDataFrame(rows, "interval string, open_time string, basket_return double, forecast_vol double").withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    frame = frame.withColumns({"avg_pairwise_corr": F.lit(0.5), "dispersion": F.lit(0.0)})
    returns = frame.select("interval", "open_time", F.lit("A").alias("symbol"), F.col("basket_return").alias("log_return"))
    assert column(labels.shocks(frame, returns), "shock_score")[1] == pytest.approx(2.0)


def test_expanding_quantiles_equal_window_functions(gappy):
    b = features.basket(features.log_returns(gappy))
    for until in (0, -1):
        w = R.expanding("interval", until=until)
        want = b.withColumn("q", F.when(F.count("basket_return").over(w) >= 10, F.percentile("basket_return", F.lit(0.75)).over(w)))
        a, c = (column(x, "q") for x in (labels.expanding_quantile(b, "basket_return", "q", 0.75, 10, until), want))
        np.testing.assert_allclose(a, c, atol=1e-12)
