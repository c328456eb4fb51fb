"""Queries on the model lab and simulated runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegauge.functions.scalars import log_price
from tidegauge.operators import features, lab, simulation
from tidegauge.plans.base import CANDLES, RETURNS, hourly, query, r

T, H, STRIDE = 48, 1, 24
CLOSED = ("naive_mean", "constant_mean", "rolling_ols_trend", "realized_vol")
CHOSEN = [lab.Spec(m, f, "log_return") for m, f in zip(CLOSED, ("mean", "mean", "trend", "volatility"))]


def _series(spark, d):
    """symbol, target, open_time, y: the basket's returns and log prices."""
    market = features.basket(features.log_returns(hourly(spark, d)))
    both = F.array(
        F.struct(F.lit("log_return").alias("target"), F.col("basket_return").alias("y")),
        F.struct(F.lit("log_price").alias("target"), log_price(F.col("basket_price")).alias("y")),
    )
    return market.select(F.lit("BASKET").alias("symbol"), "open_time", F.explode(both).alias("x")).select("symbol", "open_time", "x.*")


def _returns_only(spark, d):
    return _series(spark, d).where("target = 'log_return'")


def _fits(spark, d):
    points = lab.indexed(_returns_only(spark, d), ["symbol", "target"])
    origins = lab.origin_frame(points, ["symbol"], T, H, STRIDE)
    return lab.fits(points, CHOSEN, ["symbol"], origins, T, H)


def _w(n: int) -> str:
    return f"OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_LN = repr(2 * math.pi)
FITS = f"""
ys AS (SELECT open_time, basket_return AS y, row_number() OVER (ORDER BY open_time) - 1 AS i FROM b WHERE basket_return IS NOT NULL),
ws AS (SELECT i, open_time, lead(open_time) OVER (ORDER BY i) AS realization_time, lead(y) OVER (ORDER BY i) AS realized, avg(y) {_w(T)} AS m, var_samp(y) {_w(T)} AS v, sum(y * y) {_w(T)} AS q, var_samp(y) {_w(16)} AS v16,
 regr_slope(y, CAST(i AS DOUBLE)) {_w(T)} AS s, regr_syy(y, CAST(i AS DOUBLE)) {_w(T)} AS syy, regr_sxy(y, CAST(i AS DOUBLE)) {_w(T)} AS sxy FROM ys),
og AS (SELECT * FROM ws WHERE i >= {T - 1} AND (i - {T - 1}) % {STRIDE} = 0 AND realized IS NOT NULL),
cf AS (SELECT 0 AS ordinal, 'naive_mean' AS model_id, 'mean' AS family, i, open_time, realization_time, realized, 0.0 AS fm, v AS fv, q AS sse, 1 AS k FROM og
 UNION ALL SELECT 1, 'constant_mean', 'mean', i, open_time, realization_time, realized, m, v, {T - 1} * v, 2 FROM og
 UNION ALL SELECT 2, 'rolling_ols_trend', 'trend', i, open_time, realization_time, realized, m + s * {T - (T - 1) / 2}, (syy - s * sxy) / {T - 1}, syy - s * sxy, 3 FROM og
 UNION ALL SELECT 3, 'realized_vol', 'volatility', i, open_time, realization_time, realized, 0.0, v16, q, 1 FROM og),
ft AS (SELECT *, model_id || ':log_return' AS candidate, ln(2 * pi() * fv) * {T} + sse / fv AS m2ll FROM cf),
fi AS (SELECT *, m2ll + 2 * k AS aic, m2ll + ln({T}) * k AS bic, m2ll + 2 * k * ln(greatest(ln(greatest(k + 2, 3)), 1)) AS hqic, realized * realized / fv + ln(fv) AS qlike FROM ft),
tl AS (SELECT *, dense_rank() OVER (PARTITION BY i ORDER BY qlike) AS rank FROM fi)"""


@query("rolling_origins", f"WITH {CANDLES}, {RETURNS}, {FITS} SELECT CAST(i AS INTEGER) AS origin FROM og")
def rolling_origins(spark, d):
    points = lab.indexed(_returns_only(spark, d), ["symbol", "target"])
    return lab.origin_frame(points, ["symbol"], T, H, STRIDE).select(F.col("origin").cast("int").alias("origin"))


_DEFAULT = ("naive_mean", "rolling_ols_trend", "realized_vol", "ar_1_garch", "constant_mean", "seasonal_ar_1", "ewma_vol", "arma_1_1_garch")


@query("candidate_specs", "SELECT * FROM (VALUES " + ", ".join(f"({2 * i + j}, '{m}', '{t}')" for i, m in enumerate(_DEFAULT) for j, t in enumerate(("log_return", "log_price"))) + ") AS t(ordinal, model_id, target)")
def candidate_specs(spark, d):
    return lab.specs_frame(spark, lab.specs()).select("ordinal", "model_id", "target")


@query("lab_timeline_closed_form", f"WITH {CANDLES}, {RETURNS}, {FITS} SELECT open_time AS origin_time, realization_time, candidate, round(fm, 7) + 0.0 AS forecast_mean, round(fv, 7) AS forecast_variance, round(aic, 4) AS aic, round(bic, 4) AS bic, round(hqic, 4) AS hqic, round(qlike, 5) AS qlike, CAST(rank AS INTEGER) AS rank FROM tl")
def lab_timeline_closed_form(spark, d):
    lines = lab.timeline(lab.with_losses(_fits(spark, d)), ["symbol"])
    return lines.select("origin_time", "realization_time", "candidate", r("forecast_mean", 7), r("forecast_variance", 7), r("aic", 4), r("bic", 4), r("hqic", 4), r("qlike", 5), "rank")


@query("rank_heatmap", f"WITH {CANDLES}, {RETURNS}, {FITS} SELECT candidate, realization_time, CAST(min(rank) AS INTEGER) AS rank FROM tl GROUP BY candidate, realization_time")
def rank_heatmap(spark, d):
    return lab.rank_heatmap(lab.timeline(lab.with_losses(_fits(spark, d)), ["symbol"]), ["symbol"]).drop("symbol")


STABILITY = "rs AS (SELECT candidate, 1 / (1 + coalesce(avg(dr), 0)) AS rank_stability FROM (SELECT candidate, abs(rank - lag(rank) OVER (PARTITION BY candidate ORDER BY i)) AS dr FROM tl) GROUP BY candidate)"


@query("rank_stability", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY} SELECT candidate, round(rank_stability, 7) AS rank_stability FROM rs")
def rank_stability(spark, d):
    lines = lab.timeline(lab.with_losses(_fits(spark, d)), ["symbol"])
    return lab.rank_stability(lines, ["symbol"]).select("candidate", r("rank_stability", 7))


@query("origin_dense_rank", f"WITH {CANDLES}, {RETURNS}, {FITS} SELECT CAST(i AS INTEGER) AS origin, candidate, dense_rank() OVER (PARTITION BY i ORDER BY aic) AS aic_rank, dense_rank() OVER (PARTITION BY i ORDER BY bic) AS bic_rank FROM fi")
def origin_dense_rank(spark, d):
    f = _fits(spark, d)
    at = ["symbol", "target", "origin"]
    return f.select("origin", "candidate", lab.dense_rank_or_last("aic", at).cast("long").alias("aic_rank"), lab.dense_rank_or_last("bic", at).cast("long").alias("bic_rank"))


EVALUATION = f"""ev AS (SELECT candidate, ordinal, arg_max(aic, i) AS aic, arg_max(bic, i) AS bic, arg_max(hqic, i) AS hqic, sqrt(avg(pow(realized * realized - fv, 2))) AS avg_rmse, avg(abs(realized * realized - fv)) AS avg_mae, avg(qlike) AS avg_qlike,
 avg(fv - realized * realized) AS forecast_bias, avg(CASE WHEN sign(fm) = sign(realized) THEN 1.0 ELSE 0.0 END) AS directional_agreement_rate, count(*) AS evaluation_origins FROM fi GROUP BY candidate, ordinal),
lb AS (SELECT ev.*, rank_stability, CAST(dense_rank() OVER (ORDER BY aic) + dense_rank() OVER (ORDER BY bic) + dense_rank() OVER (ORDER BY hqic) + 2 * dense_rank() OVER (ORDER BY avg_qlike) + dense_rank() OVER (ORDER BY avg_rmse) + dense_rank() OVER (ORDER BY avg_mae)
 + dense_rank() OVER (ORDER BY rank_stability DESC) AS DOUBLE) AS composite_rank_score FROM ev JOIN rs USING (candidate))"""


def _board(spark, d):
    fitted = lab.with_losses(_fits(spark, d))
    stability = lab.rank_stability(lab.timeline(fitted, ["symbol"]), ["symbol"])
    return lab.leaderboard(lab.evaluate(fitted, ["symbol"]), stability, ["symbol"], lab.specs_frame(spark, CHOSEN))


@query("leaderboard", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY}, {EVALUATION} SELECT CAST(row_number() OVER (ORDER BY composite_rank_score, avg_qlike, aic, ordinal) AS INTEGER) AS rank, candidate, composite_rank_score, round(aic, 4) AS aic, round(avg_qlike, 5) AS avg_qlike, round(avg_rmse, 7) AS avg_rmse, round(avg_mae, 7) AS avg_mae, round(forecast_bias, 7) AS forecast_bias, round(directional_agreement_rate, 7) AS directional_agreement_rate, round(rank_stability, 7) AS rank_stability, evaluation_origins FROM lb")
def leaderboard(spark, d):
    return _board(spark, d).select("rank", "candidate", "composite_rank_score", r("aic", 4), r("avg_qlike", 5), r("avg_rmse", 7), r("avg_mae", 7), r("forecast_bias", 7), r("directional_agreement_rate", 7), r("rank_stability", 7), "evaluation_origins")


@query("model_uncertainty", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY}, {EVALUATION}, o AS (SELECT *, row_number() OVER (ORDER BY composite_rank_score, avg_qlike, aic, ordinal) AS rk, lead(composite_rank_score) OVER (ORDER BY composite_rank_score, avg_qlike, aic, ordinal) - composite_rank_score AS gap FROM lb) SELECT candidate, gap, CASE WHEN gap <= 1 THEN 'high' WHEN gap <= 3 THEN 'moderate' ELSE 'low' END AS uncertainty FROM o WHERE rk = 1")
def model_uncertainty(spark, d):
    return lab.model_uncertainty(_board(spark, d), ["symbol"]).drop("symbol")


@query("selected_model", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY}, {EVALUATION} SELECT arg_min(candidate, aic) AS candidate, round(min(aic), 4) AS aic FROM lb")
def selected_model(spark, d):
    return lab.select_model(_board(spark, d), ["symbol"]).select("candidate", r("aic", 4))


@query("model_lab")
def model_lab(spark, d):
    got = lab.run_lab(_series(spark, d), ["symbol"], lab.specs(limit=36), 120, 1, 24, "detailed")
    return got.leaderboard.select("rank", "candidate", "composite_rank_score", r("avg_qlike", 4), "evaluation_origins")


@query("garch_forecasts")
def garch_forecasts(spark, d):
    returns = features.log_returns(hourly(spark, d)).select("symbol", "open_time", F.col("log_return").alias("y"))
    return lab.garch_forecasts(returns, ["symbol"]).select("symbol", "model", "degraded", r("volatility", 4))


# ---- simulated runs ----

STEPS = f"""
s0 AS (SELECT *, greatest(realized * realized, 1e-12) AS rv FROM fi),
s1 AS (SELECT *, sqrt(fv) AS vol, rv / fv + ln(fv) AS ql, abs(rv - fv) AS lo FROM s0),
sp AS (SELECT *, dense_rank() OVER (PARTITION BY i ORDER BY ql) AS rk, CAST(dense_rank() OVER (PARTITION BY i ORDER BY aic) + dense_rank() OVER (PARTITION BY i ORDER BY bic) + dense_rank() OVER (PARTITION BY i ORDER BY hqic)
 + 2 * dense_rank() OVER (PARTITION BY i ORDER BY ql) + 2 * dense_rank() OVER (PARTITION BY i ORDER BY lo) AS DOUBLE) AS score FROM s1),
wt AS (SELECT *, exp(-0.5 * least(bic - min(bic) OVER (PARTITION BY i), 700)) AS raw FROM sp),
wg AS (SELECT *, raw / sum(raw) OVER (PARTITION BY i) AS weight FROM wt)"""


def _steps(spark, d):
    rows = simulation.steps(_returns_only(spark, d), CHOSEN, T, H, STRIDE)
    return simulation._by_ordinal(rows, lab.specs_frame(spark, CHOSEN))


@query("simulation_steps", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS} SELECT open_time AS origin_time, candidate, round(ql, 5) AS qlike, round(lo, 7) AS rmse_loss, round(vol, 7) AS forecast_volatility, CAST(rk AS BIGINT) AS rank, score AS composite_rank_score FROM sp")
def simulation_steps(spark, d):
    return _steps(spark, d).select("origin_time", "candidate", r("qlike", 5), r("rmse_loss", 7), r("forecast_volatility", 7), F.col("rank").cast("long").alias("rank"), "composite_rank_score")


@query("ic_weights", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS} SELECT open_time AS origin_time, candidate, round(weight, 6) AS weight FROM wg")
def ic_weights(spark, d):
    return simulation.weights(_steps(spark, d)).select("origin_time", "candidate", r("weight", 6))


SCORES = f"""
hs AS (SELECT *, list(vol) OVER (PARTITION BY candidate ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM wg),
pk AS (SELECT *, coalesce(len(hist), 0) AS hn, CASE WHEN coalesce(len(hist), 0) > 0 THEN (len(list_filter(hist, lambda v: v <= vol)) + 0.5 * len(list_filter(hist, lambda v: v = vol))) / len(hist) ELSE 0.5 END AS pr FROM hs),
so AS (SELECT i, open_time, arg_min(candidate, (-weight, ordinal)) AS selected, CAST(round_even(least(greatest(100 * sum(weight * pr), 0), 100), 0) AS INTEGER) AS volatility_score,
 sum(weight * (50 + 50 * tanh(fm / greatest(vol, 1e-12)))) / sum(weight) AS expectation_score,
 sum(weight * 100 * tanh(CASE WHEN family IN ('trend', 'combined') THEN 1.25 ELSE 1 END * fm / greatest(vol, 1e-12))) / sum(weight) AS trend_score,
 least(1.0, max(hn) / 10) AS cal, 1 / (1 + stddev_pop(vol) FILTER (weight > 0) / avg(vol) FILTER (weight > 0)) AS agree FROM pk GROUP BY i, open_time)"""


@query("origin_scores", f"""WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS}, {SCORES} SELECT open_time AS origin_time, selected AS selected_candidate, volatility_score, round(expectation_score, 4) AS expectation_score, round(trend_score, 4) AS trend_score, 0.0::DOUBLE AS seasonality_score,
 round(0.3 + 0.25 + 0.2 * agree + 0.15 * cal + 0.1, 4) AS confidence, CASE WHEN volatility_score < 20 THEN '매우 낮은 변동성' WHEN volatility_score < 40 THEN '낮은 변동성' WHEN volatility_score < 60 THEN '보통 변동성' WHEN volatility_score < 80 THEN '높은 변동성' ELSE '극단적 변동성' END AS volatility_label FROM so""")
def origin_scores(spark, d):
    return simulation.score_origins(_steps(spark, d)).select("origin_time", "selected_candidate", "volatility_score", r("expectation_score", 4), r("trend_score", 4), r("seasonality_score", 4), r("confidence", 4), "volatility_label")


@query("conclusion", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS}, {SCORES} SELECT 'BASKET' AS symbol, 'BASKET, volatility ' || volatility_score || ', model ' || selected AS headline FROM so ORDER BY i DESC LIMIT 1")
def conclusion(spark, d):
    return simulation.conclusion(simulation.score_origins(_steps(spark, d))).select("symbol", "headline")


@query("model_evaluation", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS} SELECT candidate, count(*) AS origin_count, 1.0::DOUBLE AS convergence_rate, round(avg(aic), 4) AS avg_aic, round(avg(ql), 5) AS avg_qlike, round(avg(lo), 7) AS rmse, round(1 / (1 + stddev_pop(rk)), 7) AS rank_stability, round(avg(score), 6) AS composite_rank_score FROM sp GROUP BY candidate")
def model_evaluation(spark, d):
    return simulation.model_evaluation(_steps(spark, d)).select("candidate", "origin_count", "convergence_rate", r("avg_aic", 4), r("avg_qlike", 5), r("rmse", 7), r("rank_stability", 7), r("composite_rank_score", 6))


@query("metric_series", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STEPS} SELECT candidate, open_time AS time, 'bic' AS metric, round(bic, 4) AS value FROM sp UNION ALL SELECT candidate, open_time, 'qlike', round(ql, 4) FROM sp")
def metric_series(spark, d):
    return simulation.metric_series(_steps(spark, d), ["bic", "qlike"]).select("candidate", "time", "metric", r("value", 4))


@query("simulation_run")
def simulation_run(spark, d):
    spec = simulation.SimulationSpec.from_mapping({"run_name": "sample", "symbols": "basket", "interval": "1h", "data_start": "2024-01-01", "data_end": "2024-02-01", "T": "120 bars", "dT": "24h", "S": "30 bars", "candidate_limit": 36})
    rows, scores = simulation.run(_series(spark, d), spec)
    return scores.select("symbol", "target", "origin_time", "selected_candidate", "volatility_score", r("expectation_score", 3), r("trend_score", 3), r("seasonality_score", 3))
