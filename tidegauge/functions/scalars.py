"""Scalar expressions on prices, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def log_price(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def parkinson(high: Column, low: Column) -> Column:
    """Range volatility of one bar."""
    r = F.ln(F.when((high > 0) & (low > 0), high / low))
    return F.sqrt(r * r / (4 * F.ln(F.lit(2.0))))


def qlike(realised: Column, forecast: Column) -> Column:
    f = F.when(forecast > 0, forecast)
    return realised / f + F.ln(f)


def bad_ohlc(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.coalesce((h < F.greatest(o, c, low)) | (low > F.least(o, c, h)) | (F.least(o, h, low, c) <= 0), F.lit(False))


def information_criteria(log_likelihood: Column, k: Column, n: Column) -> tuple[Column, Column, Column]:
    """AIC, BIC, and the HQ criterion whose sample size is max(3, k + 2)."""
    hq = 2 * k * F.ln(F.greatest(F.ln(F.greatest(k + 2, F.lit(3)).cast("double")), F.lit(1.0)))
    return -2 * log_likelihood + 2 * k, -2 * log_likelihood + F.ln(F.greatest(n, F.lit(2)).cast("double")) * k, -2 * log_likelihood + hq


def regime(values: dict[str, Column], limits: dict[str, Column]) -> Column:
    """The regime label; missing values count as 0."""
    v = {k: F.coalesce(x, F.lit(0.0)) for k, x in values.items()}
    high_vol = (v["forecast_vol"] >= limits["forecast_vol"]) | (v["market_vol"] >= limits["market_vol"])
    high_corr = v["corr"] >= limits["corr"]
    return (
        F.when(high_vol & high_corr & (v["pca"] >= limits["pca"]), "SYSTEMIC_RISK")
        .when(high_vol & ~high_corr & (v["dispersion"] >= limits["dispersion"]), "IDIOSYNCRATIC_HIGH_VOL")
        .when((v["forecast_vol"] <= limits["forecast_vol"]) & (v["corr"] <= limits["corr_low"]) & (v["pca"] <= limits["pca_low"]), "ASSET_SPECIFIC")
        .otherwise("QUIET_CORRELATED")
    )


def shock(score: Column, jump: Column, breadth: Column, corr: Column, dispersion: Column, dispersion_limit: Column, severe: float = 3.0, moderate: float = 2.0, broad: float = 0.60) -> Column:
    """The shock label of one bar; missing inputs are 0, a missing jump is 1, a missing limit is never reached."""
    z = lambda x, d=0.0: F.coalesce(x, F.lit(d))
    high, wide = z(score) >= severe, z(breadth) >= broad
    return (
        F.when(high & wide & (z(corr) >= 0.5), "SYSTEMIC_VOL_SHOCK")
        .when(high & ~wide & F.coalesce(z(dispersion) >= dispersion_limit, F.lit(False)), "IDIOSYNCRATIC_VOL_SHOCK")
        .when(z(jump, 1.0) >= 2.0, "VOL_REGIME_BUILDUP")
        .when(z(score) >= moderate, "MODERATE_SHOCK")
        .otherwise("NORMAL")
    )


# Labels of the four scores, from the lowest bucket up.
NO_LABEL = "산출 불가"
VOLATILITY_LABELS = ("매우 낮은 변동성", "낮은 변동성", "보통 변동성", "높은 변동성", "극단적 변동성")
EXPECTATION_LABELS = ("강한 하방 기대", "약한 하방 기대", "중립", "약한 상방 기대", "강한 상방 기대")
TREND_LABELS = ("강한 하락 추세", "약한 하락 추세", "중립 추세", "약한 상승 추세", "강한 상승 추세")
SEASONALITY_LABELS = ("계절성 거의 없음", "약한 계절성", "보통 계절성", "강한 계절성", "매우 강한 계절성")


def label(score: Column, names: tuple[str, ...], limits: tuple[float, ...] = (20, 40, 60, 80), closed: int = 0) -> Column:
    """The name of the score's bucket; the first `closed` limits belong to the bucket below."""
    out = F.when(score.isNull(), NO_LABEL)
    for i, (name, limit) in enumerate(zip(names, limits)):
        out = out.when(score <= limit if i < closed else score < limit, name)
    return out.otherwise(names[-1])


def trend_label(score: Column) -> Column:
    return label(score, TREND_LABELS, (-60, -20, 20, 60), closed=2)


def decision(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), "unavailable").when(p < alpha, "reject").otherwise("fail to reject")
