"""Volatility forecasts, and the shock and regime labels that use them; nothing looks ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import regime, shock
from tidegauge.operators import blocks
from tidegauge.operators.features import AT, ewma
from tidegauge.sources.scratch import settled


def forecast_series(market: DataFrame, span: int = 24, history: DataFrame | None = None) -> DataFrame:
    """forecast_vol, carried over gaps, market_vol before the first: the volatility of `history` (interval, open_time, volatility, such as
    lab.garch_history), or without one the EWMA volatility of the basket."""
    if history is None:
        history = ewma(market, "basket_return", "_v", span, ["interval"], emit_from=1).withColumn("volatility", F.sqrt("_v"))
    joined = market.join(history.select(*AT, F.col("volatility").alias("_f")), list(AT), "left")
    filled = blocks.running_last(joined, ["interval"], {"_f": F.col("_f")})
    return filled.withColumn("forecast_vol", F.coalesce("_f", "market_vol")).drop("_f")


def expanding_quantiles(df: DataFrame, limits: dict[str, tuple[str, float]], at_least: int, until: int = 0) -> DataFrame:
    """Adds linear quantiles, name: (column, q), of all values up to the row (until=0) or before it (until=-1)."""
    return blocks.expanding_quantiles(df, ["interval"], limits, at_least, until)


def expanding_quantile(df: DataFrame, col: str, out: str, q: float, at_least: int, until: int = 0) -> DataFrame:
    return expanding_quantiles(df, {out: (col, q)}, at_least, until)


def rolling_quantile(df: DataFrame, col: str, out: str, q: float, n: int, at_least: int) -> DataFrame:
    return blocks.sliding(df, ["interval"], col, n, at_least, quantiles={out: q})


def regimes(frame: DataFrame, at_least: int = 30) -> DataFrame:
    """Adds regime from forecast_vol, market_vol, avg_pairwise_corr, pca1_share and dispersion.

    Limits are expanding quantiles up to the row itself; unless all seven exist the market counts as quiet.
    """
    limits = {
        "forecast_vol": ("forecast_vol", 0.75), "market_vol": ("market_vol", 0.75), "corr": ("avg_pairwise_corr", 0.75), "corr_low": ("avg_pairwise_corr", 0.40),
        "pca": ("pca1_share", 0.75), "pca_low": ("pca1_share", 0.40), "dispersion": ("dispersion", 0.75),
    }
    out = expanding_quantiles(frame, {f"_{name}": limit for name, limit in limits.items()}, at_least)
    values = {"forecast_vol": "forecast_vol", "market_vol": "market_vol", "corr": "avg_pairwise_corr", "pca": "pca1_share", "dispersion": "dispersion"}
    all_there = F.array_size(F.array_compact(F.array(*(f"_{n}" for n in limits)))) == len(limits)
    found = regime({k: F.col(c) for k, c in values.items()}, {n: F.col(f"_{n}") for n in limits})
    return out.withColumn("regime", F.when(all_there, found).otherwise("QUIET_CORRELATED")).drop(*(f"_{n}" for n in limits))


def shocks(frame: DataFrame, returns: DataFrame, n: int = 24, severe: float = 3.0, moderate: float = 2.0, broad: float = 0.60) -> DataFrame:
    """Adds shock_score, rv_jump_ratio, shock_breadth and shock_type from basket_return, forecast_vol, avg_pairwise_corr, dispersion."""
    b = F.col("basket_return")

    def hits(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        scale = F.lag(R.std(F.col("log_return"), R.trailing(n, *keys), R.least("basic", n))).over(R.ordered(*keys))
        return rows.withColumn("_scale", scale).withColumn("_hit", F.coalesce((R.ratio(F.abs("log_return"), F.col("_scale")) > moderate).cast("double"), F.lit(0.0)))

    breadth = blocks.windowed(returns, ["interval", "symbol"], n, hits).groupBy(*AT).agg(F.avg("_hit").alias("shock_breadth"))

    def scores(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        score = R.ratio(F.abs(b), F.lag("forecast_vol").over(R.ordered(*keys)))
        return rows.withColumns({"shock_score": score, "_rv": R.std(b, R.trailing(6, *keys), 3)})

    placed = settled(blocks.numbered(frame.join(breadth, list(AT), "left"), ["interval"]))
    out = blocks.sliding(blocks.windowed(placed, ["interval"], 6, scores), ["interval"], "_rv", max(n, 30), 6, quantiles={"_base": 0.5})
    jump = lambda keys, rows: rows.withColumn("rv_jump_ratio", R.ratio(F.col("_rv"), F.lag("_base").over(R.ordered(*keys))))
    out = blocks.windowed(out, ["interval"], 1, jump).drop(blocks.PLACE)
    out = expanding_quantiles(out, {"_limit": ("dispersion", 0.75)}, 10, until=-1)
    found = shock(F.col("shock_score"), F.col("rv_jump_ratio"), F.col("shock_breadth"), F.col("avg_pairwise_corr"), F.col("dispersion"), F.col("_limit"), severe, moderate, broad)
    return out.withColumn("shock_type", found).drop("_rv", "_base", "_limit")
