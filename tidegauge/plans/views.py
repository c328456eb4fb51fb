"""Queries on read-models and ranges, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import evaluation, features, labels, lab, views
from tidegauge.plans import market, models
from tidegauge.plans.base import CANDLES, RETURNS, W, hourly, query, r
from tidegauge.plans.market import ALIGNED, FORECASTS, LABELS, REGIMES, SHOCKS
from tidegauge.plans.models import EVALUATION, FITS, STABILITY
from tidegauge.sources.scratch import settled

FORECAST_COLUMNS = {"forecast": "forecast_vol", "ewma": "ewma_vol", "naive": "market_vol"}
SERIES = ("basket_return", "market_vol", "forecast_vol", "avg_pairwise_corr", "dispersion", "pca1_share", "log_price", "standardized_residual")


@query("series_tails", f"""WITH {LABELS}, x AS (SELECT fr.open_time, {', '.join('fr.' + c for c in SERIES[:6])}, CASE WHEN basket_price > 0 THEN ln(basket_price) END AS log_price,
 fr.basket_return / nullif(lag(forecast_vol) OVER (ORDER BY fr.open_time), 0) AS standardized_residual FROM fr JOIN b USING (open_time)),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, open_time AS time, {c} AS value FROM x" for c in SERIES)})
SELECT name, time, round(value, 6) AS value FROM u WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY time DESC) <= 160""")
def series_tails(spark, d):
    frame, returns = market._frame(spark, d)
    prices = features.basket(returns).select(*features.AT, "basket_price")
    return views.series_tails(views.derived(frame.join(prices, list(features.AT))), list(SERIES)).select("name", "time", r("value", 6))


@query("regime_codes", f"WITH {LABELS}, {REGIMES} SELECT open_time AS time, regime AS label, CAST(dense_rank() OVER (ORDER BY regime) AS INTEGER) AS value FROM (SELECT * FROM rg ORDER BY open_time DESC LIMIT 160)")
def regime_codes(spark, d):
    return views.label_codes(labels.regimes(market._frame(spark, d)[0]), "regime").select("time", "label", "value")


@query("leaderboard_view", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY}, {EVALUATION}, o AS (SELECT *, CAST(row_number() OVER (ORDER BY composite_rank_score, avg_qlike, aic, ordinal) AS INTEGER) AS rank FROM lb) SELECT rank, candidate FROM o WHERE candidate LIKE '%mean:log_return' AND rank <= 3")
def leaderboard_view(spark, d):
    return views.board_view(models._board(spark, d), 3, family="mean", target="log_return", symbol="BASKET").select("rank", "candidate")


@query("qlike_ranking", f"WITH {CANDLES}, {RETURNS}, {FITS}, {STABILITY}, {EVALUATION} SELECT candidate, round(avg_qlike, 5) AS avg_qlike, CAST(row_number() OVER (ORDER BY avg_qlike NULLS LAST, ordinal) AS INTEGER) AS rank FROM lb")
def qlike_ranking(spark, d):
    return evaluation.qlike_ranking(models._board(spark, d), ["symbol"], "ordinal").select("candidate", r("avg_qlike", 5), "rank")


@query("data_quality_status", f"""WITH {CANDLES}, {market.BROKEN}, {market.ISSUES}, f AS (SELECT * FROM i WHERE "count" > 0)
SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'issues' WHEN count(*) > 0 THEN 'warnings' ELSE 'ok' END AS status, count(*) FILTER (severity = 'error') = 0 AS is_valid, count(*) AS issue_count FROM f""")
def data_quality_status(spark, d):
    return views.quality_status(market._issues(spark, d))


@query("method_steps", f"""WITH {LABELS}, {REGIMES}, {SHOCKS}, n AS (SELECT st.*, regime FROM st JOIN rg USING (open_time) ORDER BY open_time DESC LIMIT 1)
SELECT step, stage, rule, open_time, round(value, 6) AS value, label, CASE WHEN step = 2 THEN round(avg_pairwise_corr, 7) END AS corr, CASE WHEN step = 2 THEN round(pca1_share, 6) END AS share FROM (
 SELECT 1 AS step, 'returns' AS stage, 'log of a close over the close before' AS rule, basket_return AS value, NULL AS label, n.* FROM n
 UNION ALL SELECT 2, 'features', 'windows that end with this bar', market_vol, NULL, n.* FROM n
 UNION ALL SELECT 3, 'forecast', 'EWMA of squared returns, for the next bar', forecast_vol, NULL, n.* FROM n
 UNION ALL SELECT 4, 'shock', 'size of the return over the forecast of the bar before', score, NULL, n.* FROM n
 UNION ALL SELECT 5, 'regime', 'limits are quantiles of all bars up to this one', NULL, regime, n.* FROM n
 UNION ALL SELECT 6, 'validation', 'squared return against the forecast of the bar before', NULL, 'updated', n.* FROM n)""")
def method_steps(spark, d):
    frame, returns = market._frame(spark, d)
    detail = F.from_json("detail", "avg_pairwise_corr double, pca1_share double")
    got = views.method_steps(labels.regimes(labels.shocks(frame, returns)))
    return got.select("step", "stage", "rule", "open_time", r("value", 6), "label", r(detail["avg_pairwise_corr"], 7, "corr"), r(detail["pca1_share"], 6, "share"))


@query("label_concentration", f"""WITH {LABELS}, {REGIMES}, {SHOCKS}, k AS (SELECT regime, count(*) AS n FROM rg WHERE regime IS NOT NULL GROUP BY regime)
SELECT 'regime' AS name, sum(n)::BIGINT AS n, round(max(n) / sum(n), 8) AS max_share, CAST(0 AS BIGINT) AS unusual FROM k
UNION ALL SELECT 'shock', (SELECT count(*) FROM st), round(max(c) / sum(c), 8), CAST(coalesce(sum(c) FILTER (shock_type <> 'NORMAL'), 0) AS BIGINT) FROM (SELECT shock_type, count(*) AS c FROM st GROUP BY shock_type)""")
def label_concentration(spark, d):
    frame, returns = market._frame(spark, d)
    by_regime = evaluation.concentration(labels.regimes(frame), "regime").withColumn("name", F.lit("regime"))
    by_shock = evaluation.concentration(labels.shocks(frame, returns), "shock_type", "NORMAL").withColumn("name", F.lit("shock"))
    return by_regime.unionByName(by_shock).select("name", "n", r("max_share"), "unusual")


@query("forecast_loss_rows", f"""WITH {LABELS}, {ALIGNED}, m AS (SELECT count(*) AS n, avg(forecast_se) AS a, avg(forecast_ae) AS b, avg(forecast_q) AS c FROM ls)
SELECT 'MSE' AS name, round(a, 8) AS statistic, n FROM m WHERE n >= 10 UNION ALL SELECT 'MAE', round(b, 8), n FROM m WHERE n >= 10 UNION ALL SELECT 'QLIKE', round(c, 5), n FROM m WHERE n >= 10""")
def forecast_loss_rows(spark, d):
    x = F.col("statistic")
    got = evaluation.forecast_losses(market._pairs(spark, d), "forecast")
    return got.select("name", r(F.when(F.col("name") == "QLIKE", F.round(x, 5)).otherwise(F.round(x, 8)), 8, "statistic"), "n")


#: The pairs of the last week alone.
WEEK = "sl AS (SELECT * FROM fr WHERE open_time >= (SELECT max(open_time) FROM fr) - INTERVAL 167 HOUR), " + ALIGNED.replace("FROM fr LEFT JOIN ew", "FROM sl AS fr LEFT JOIN ew")


@query("range_metrics", f"WITH {LABELS}, {WEEK}, u AS (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, sqrt(avg({m}_se)) AS rmse, avg({m}_ae) AS mae, avg({m}_q) AS qlike, count(*) AS n FROM ls""" for m in FORECASTS
) + ") SELECT model, round(rmse, 7) AS rmse, round(mae, 7) AS mae, round(qlike, 6) AS qlike, n FROM u")
def range_metrics(spark, d):
    frame, _ = market._frame(spark, d)
    smooth = features.ewma(frame, "basket_return", "_v", W.short, ["interval"]).select(*features.AT, r(F.sqrt("_v"), 9, "ewma_vol"))
    view = views.on_range(frame.join(smooth, list(features.AT), "left"), "1w", FORECAST_COLUMNS)
    return view.metrics.select("model", r("rmse", 7), r("mae", 7), r("qlike", 6), "n")


RANGES = {"dashboard": "1d", "forecast": "1w", "backtest": "1y", "everything": "all"}


@query("range_status", f"WITH {CANDLES}, {RETURNS}, t AS (SELECT max(open_time) AS m FROM b) " + " UNION ALL ".join(
    f"""SELECT '{v}' AS "view", '{t}' AS "range", min(open_time) AS "start", max(open_time) AS "end", CAST({h} AS INTEGER) AS expected_points, count(*) AS actual_points FROM b, t""" + ("" if h == "NULL" else f" WHERE open_time >= m - INTERVAL {h - 1} HOUR")
    for (v, t), h in zip(RANGES.items(), (24, 168, 8760, "NULL"))
))
def range_status(spark, d):
    return views.range_status(features.basket(features.log_returns(hourly(spark, d))), RANGES)


@query("json_rows", f"""WITH {CANDLES}, {RETURNS} SELECT symbol, strftime(open_time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS open_time, CASE WHEN close > 50 THEN close END AS close, log_return FROM rt""")
def json_rows(spark, d):
    nan = F.when(F.col("close") > 50, F.col("close")).when(F.hour("open_time") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    text = views.json_rows(features.log_returns(hourly(spark, d)).select("symbol", "open_time", nan.alias("close"), "log_return"))
    return text.select(F.from_json("value", "symbol string, open_time string, close double, log_return double").alias("x")).select("x.*")


@query("snapshot_tables")
def snapshot_tables(spark, d):
    """Every row of a snapshot as JSON beside its table's name."""
    candles = settled(hourly(spark, d))
    frame, _, returns = market._garch(spark, d)
    prices = features.basket(returns).select(*features.AT, "basket_price")
    full = settled(labels.regimes(labels.shocks(frame, returns)).join(prices, list(features.AT)))
    tables = views.snapshot(candles, full, "1h", losses=settled(evaluation.losses(market._pairs(spark, d, frame.drop("ewma_vol")), FORECASTS))).tables
    parts = [views.json_rows(df).select(F.lit(name).alias("name"), "value") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("forecast_service")
def forecast_service(spark, d):
    returns = features.log_returns(hourly(spark, d))
    return lab.forecast_service(returns).select("symbol", "model", "degraded", r("volatility", 4), "refit_countdown")
