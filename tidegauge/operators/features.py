"""The nineteen rolling features of a market, from candles.

All frames are long: returns by (interval, open_time, symbol), market series by (interval, open_time). Windows run on
blocks of a series with the rows that they reach back to (see blocks.py), so a long series is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import log_price, parkinson
from tidegauge.operators import blocks
from tidegauge.sources.candles import closed_only
from tidegauge.sources.scratch import settled

AT = ("interval", "open_time")
FEATURES = (
    "basket_return", "market_vol", "avg_asset_vol_short", "avg_asset_vol_medium", "avg_asset_vol_long", "ewma_vol", "range_vol",
    "vol_percentile", "vol_z_score", "vol_of_vol", "avg_pairwise_corr", "avg_btc_beta", "pca1_share", "dispersion", "trend_slope",
    "trend_tstat", "trend_strength", "trend_autocorr", "up_down_ratio",
)


@dataclass(frozen=True)
class Windows:
    """Window lengths in bars: short (volatility), medium (correlation), long (PCA) and trend."""

    short: int = 24
    medium: int = 168
    long: int = 720
    trend: int = 24


@dataclass(frozen=True)
class FeatureBundle:
    close: DataFrame
    returns: DataFrame
    features: DataFrame


def dense_closes(candles: DataFrame) -> DataFrame:
    """Every symbol at every bar time of its interval; a missing bar has a NULL close."""
    closed = closed_only(candles)
    times = closed.select(*AT).distinct()
    symbols = closed.select("interval", "symbol").distinct()
    one = closed.groupBy(*AT, "symbol").agg(F.max_by("close", "close_time").alias("close"))
    return times.join(symbols, "interval").join(one, [*AT, "symbol"], "left")


def close_matrix(candles: DataFrame, symbols: list[str]) -> DataFrame:
    return dense_closes(candles).groupBy(*AT).pivot("symbol", symbols).agg(F.first("close"))


def returns_of(closes: DataFrame) -> DataFrame:
    """Adds log_price and log_return to dense closes."""
    w = R.ordered("interval", "symbol")
    price = log_price(F.col("close"))
    return closes.withColumn("log_price", price).withColumn("log_return", F.col("log_price") - F.lag("log_price").over(w))


def log_returns(candles: DataFrame) -> DataFrame:
    return returns_of(dense_closes(candles))


def basket(returns: DataFrame) -> DataFrame:
    """basket_return and basket_price, means over the symbols that have one."""
    return returns.groupBy(*AT).agg(F.avg("log_return").alias("basket_return"), F.avg("close").alias("basket_price"))


def asset_vols(returns: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Mean over symbols of their rolling standard deviation, a column per window."""
    x = F.col("log_return")

    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: R.std(x, R.trailing(n, *keys), R.least("basic", n)) for name, n in windows.items()})

    per = blocks.windowed(returns, ["interval", "symbol"], max(windows.values()) - 1, make)
    return per.groupBy(*AT).agg(*(F.avg(n).alias(n) for n in windows))


def range_volatility(candles: DataFrame, n: int, include_unclosed: bool = False) -> DataFrame:
    rows = candles if include_unclosed else closed_only(candles)
    bar = rows.groupBy(*AT).agg(F.avg(parkinson(F.col("high"), F.col("low"))).alias("_bar"))
    mean = lambda keys, x: x.withColumn("range_vol", R.mean(F.col("_bar"), R.trailing(n, *keys), R.least("basic", n)))
    return blocks.windowed(bar, ["interval"], n - 1, mean).select(*AT, "range_vol")


def ewma(df: DataFrame, value: str, out: str, span: int, by: list[str], emit_from: int = 3) -> DataFrame:
    """EWMA variance of a series, alpha 2 / (span + 1), seeded with the first square; gaps are skipped and stay NULL."""
    v = blocks.ewma_variance(df.select(*by, "open_time", value), by, value, span, "_y", "_n")
    return v.select(*by, "open_time", F.when(F.col(value).isNotNull() & (F.col("_n") >= emit_from), F.col("_y")).alias(out))


def pairs(returns: DataFrame) -> DataFrame:
    """Both returns of every pair of symbols at every bar."""
    a = returns.select(*AT, F.col("symbol").alias("a"), F.col("log_return").alias("x"))
    b = returns.select(*AT, F.col("symbol").alias("b"), F.col("log_return").alias("y"))
    return a.join(b, list(AT)).where("a < b")


def rolling_pairs(returns: DataFrame, n: int) -> DataFrame:
    """Rolling covariance and correlation of each pair, over bars that have both."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y, at_least = F.when(both, F.col("x")), F.when(both, F.col("y")), R.least("basic", n)

    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        w = R.trailing(n, *keys)
        return rows.withColumns({"cov": R.rolled(F.covar_samp(x, y), x, w, at_least), "corr": R.correlation(x, y, w, at_least)})

    return blocks.windowed(pairs(returns), ["interval", "a", "b"], n - 1, make).select(*AT, "a", "b", "cov", "corr")


def average_correlation(returns: DataFrame, n: int, stride: int | None = None) -> DataFrame:
    """Mean pair correlation, carried forward; with a stride only every so many bars and the last are computed."""
    mean = rolling_pairs(returns, n).groupBy(*AT).agg(F.avg("corr").alias("_c"))
    return _carried(mean, returns, "_c", "avg_pairwise_corr", stride)


def _carried(values: DataFrame, spine: DataFrame, col: str, out: str, stride: int | None) -> DataFrame:
    at = spine.select(*AT).distinct().join(values, list(AT), "left")
    x = F.col(col)
    if stride and stride > 1:
        at = blocks.numbered(at, ["interval"], length="_n")
        x = F.when((F.col(blocks.PLACE) % stride == 0) | (F.col(blocks.PLACE) == F.col("_n") - 1), x)
    return blocks.running_last(at, ["interval"], {out: x}).select(*AT, out)


def stride_for(rows: int, n: int) -> int | None:
    """The step that longer series use in place of every bar."""
    return max(1, min(96, n // 24)) if rows > 2000 else None


def beta(returns: DataFrame, benchmark: str, n: int) -> DataFrame:
    """Rolling beta of each other symbol: pairwise covariance over the benchmark's own variance."""
    bench = returns.where(F.col("symbol") == benchmark).select(*AT, F.col("log_return").alias("m"))
    both = F.col("log_return").isNotNull() & F.col("m").isNotNull()
    x, y, at_least = F.when(both, F.col("log_return")), F.when(both, F.col("m")), R.least("pair", n)

    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        w = R.trailing(n, *keys)
        return rows.withColumn("beta", R.ratio(R.rolled(F.covar_samp(x, y), x, w, at_least), R.rolled(F.var_samp("m"), F.col("m"), w, at_least)))

    others = returns.where(F.col("symbol") != benchmark).join(bench, list(AT), "left")
    return blocks.windowed(others, ["interval", "symbol"], n - 1, make).select(*AT, "symbol", "beta")


def pca_share(returns: DataFrame, n: int, stride: int | None = None, block: int = 2000) -> DataFrame:
    """Largest eigenvalue's share of the trace of the rolling covariance, carried forward.

    Windows are computed in blocks of bars, each with the bars before it that its windows reach back to.
    """
    spine = blocks.numbered(returns.select(*AT).distinct(), ["interval"]).withColumnRenamed(blocks.PLACE, "i")
    reach = F.explode(F.sequence(F.floor(F.col("i") / block).cast("long"), F.floor((F.col("i") + n - 1) / block).cast("long")))
    rows = returns.select(*AT, "symbol", "log_return").join(spine, list(AT)).withColumn("block", reach)
    at_least = R.least("pair", n)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot(index="i", columns="symbol", values="log_return").sort_index()
        x, at = wide.to_numpy(dtype=float), wide.index.to_numpy()
        first = int(f["block"].iloc[0]) * block
        out = []
        for k in np.flatnonzero((at >= first) & (at < first + block)):
            part = x[max(0, k - n + 1) : k + 1]
            part = part[:, ~np.isnan(part).all(axis=0)]
            part = part[~np.isnan(part).any(axis=1)] if part.size else part
            share = None
            if part.ndim == 2 and part.shape[1] >= 2 and len(part) >= at_least:
                values = np.linalg.eigvalsh(np.cov(part, rowvar=False))
                share = float(values[-1] / values.sum()) if values.sum() > 0 else None
            out.append((f["interval"].iloc[0], int(at[k]), share))
        return pd.DataFrame(out, columns=["interval", "i", "_s"]).astype({"i": "int64", "_s": "float64"})

    got = rows.groupBy("interval", "block").applyInPandas(run, "interval string, i long, _s double")
    return _carried(spine.join(got, ["interval", "i"]).select(*AT, F.when(~F.isnan("_s"), F.col("_s")).alias("_s")), returns, "_s", "pca1_share", stride)


def slope_and_t(y: Column, n: int, by: tuple[str, ...] = ("interval",)) -> tuple[Column, Column]:
    """Columns of the rolling OLS slope on 0, 1, .. over the values there are, and its t statistic; _i numbers the values."""
    w, at_least = R.trailing(n, *by), R.least("trend", n)
    i = F.col("_i")  # the number of values so far: consecutive over gaps
    x = F.when(y.isNotNull(), i)
    seen = F.count(y).over(w)
    sxx, syy, sxy = (f(y, x).over(w) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    slope = F.when(seen >= at_least, R.ratio(sxy, sxx))
    se = F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / F.greatest(seen - 2, F.lit(1)) / F.nullif(sxx, F.lit(0.0)))
    return slope, F.when((seen >= at_least) & (seen >= 4), F.when(se == 0, 0.0).otherwise(slope / F.nullif(se, F.lit(0.0))))


def up_down(x: Column, n: int, by: tuple[str, ...] = ("interval",)) -> Column:
    w = R.trailing(n, *by)
    share = F.count_if(x > 0).over(w) / F.nullif(F.count_if(x != 0).over(w), F.lit(0))
    return F.when(F.count(x).over(w) >= R.least("trend", n), F.coalesce(share, F.lit(0.5)))


def volatility_block(market: DataFrame, w: Windows) -> DataFrame:
    """market_vol and what follows from it, from basket_return."""
    v = F.col("market_vol")

    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        s, m, lo = (R.trailing(n, *keys) for n in (w.short, w.medium, w.long))
        least = R.least("vol", w.long)
        z = R.ratio(v - R.mean(v, lo, least), R.std(v, lo, least))
        rows = rows.withColumn("market_vol", R.std(F.col("basket_return"), s, R.least("basic", w.short)))
        return rows.withColumns({"vol_z_score": z, "vol_of_vol": R.std(v, m, R.least("vol", w.medium))})

    placed = blocks.numbered(market, ["interval"])
    rolled = blocks.windowed(placed, ["interval"], w.short + max(w.medium, w.long) - 2, make)
    out = blocks.sliding(rolled, ["interval"], "market_vol", w.long, R.least("rank", w.long), shares="vol_percentile")
    return out if blocks.PLACE in market.columns else out.drop(blocks.PLACE)


def trend_block(market: DataFrame, w: Windows) -> DataFrame:
    """Trend features from basket_price, basket_return and market_vol."""
    y, b = log_price(F.col("basket_price")), F.col("basket_return")

    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        slope, t = slope_and_t(y, w.trend, keys)
        rows = rows.withColumn("_i", F.count(y).over(R.expanding(*keys)).cast("double"))
        return rows.withColumns({"trend_slope": slope, "trend_tstat": t, "up_down_ratio": up_down(b, w.trend, keys)}).drop("_i")

    placed = blocks.numbered(market, ["interval"])
    rolled = blocks.windowed(placed, ["interval"], w.trend - 1, make)
    out = blocks.lag_correlation(rolled, ["interval"], "basket_return", w.trend, R.least("trend", w.trend), "trend_autocorr")
    out = out.withColumn("trend_strength", R.ratio(F.col("trend_slope"), F.col("market_vol")))
    return out if blocks.PLACE in market.columns else out.drop(blocks.PLACE)


def feature_bundle(candles: DataFrame, benchmark: str, w: Windows = Windows(), stride: int | None = None) -> FeatureBundle:
    """All features on the spine of bar times. Returns and the market's series are written once, as every part reads them."""
    closes = settled(dense_closes(candles))
    returns = settled(returns_of(closes))
    market = settled(trend_block(volatility_block(blocks.numbered(basket(returns), ["interval"]), w), w))
    vols = asset_vols(returns, {"avg_asset_vol_short": w.short, "avg_asset_vol_medium": w.medium, "avg_asset_vol_long": w.long})
    smooth = ewma(market, "basket_return", "_v", w.short, ["interval"]).withColumn("ewma_vol", F.sqrt("_v")).drop("_v")
    betas = beta(returns, benchmark, w.medium).groupBy(*AT).agg(F.avg("beta").alias("avg_btc_beta"))
    parts = (vols, smooth, range_volatility(candles, w.short), average_correlation(returns, w.long, stride), betas, pca_share(returns, w.long, stride))
    for part in parts:
        market = market.join(part, list(AT), "left")
    market = market.withColumn("dispersion", F.col("avg_asset_vol_short") - F.col("market_vol"))
    return FeatureBundle(closes, returns, market.select(*AT, *FEATURES))
