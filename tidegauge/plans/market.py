"""Queries on candles, features, labels, evaluation and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import intervals as I
from tidegauge.functions import rolling as R
from tidegauge.functions.scalars import log_price
from tidegauge.functions.tails import normal_ppf
from tidegauge.operators import evaluation, features, lab, labels, quality
from tidegauge.plans.base import BENCHMARK, CANDLES, EWMA, LINE, MARKET, RETURNS, W, daily, hourly, query, r, rounded, sql_std, win
from tidegauge.sources import candles as C
from tidegauge.sources import store
from tidegauge.sources.scratch import settled

T = ["open_time"]
TS = ["open_time", "symbol"]
ALL = ["symbol", "interval", "open_time", "close_time", "open", "high", "low", "close", "volume", "is_closed"]
_ALL = ", ".join(f'"{c}"' for c in ALL)


@query("candles_from_events", f"WITH {CANDLES} SELECT {_ALL} FROM c")
def candles_from_events(spark, d):
    return hourly(spark, d).select(ALL)


@query("candles_from_lineitem", f'WITH {LINE} SELECT symbol, interval, open_time, close_time, round(open, 8) AS "open", round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS "close", volume, is_closed FROM c')
def candles_from_lineitem(spark, d):
    return daily(spark, d).select("symbol", "interval", "open_time", "close_time", *(r(c) for c in ("open", "high", "low", "close")), "volume", "is_closed")


@query("normalised_candles", f"WITH {CANDLES} SELECT {_ALL} FROM c")
def normalised_candles(spark, d):
    as_text = hourly(spark, d).select(F.lower("symbol").alias("symbol"), "interval", "open_time", "close_time", *(F.col(c).cast("string").alias(c) for c in C.PRICES), "is_closed")
    return C.normalise(as_text).withColumn("symbol", F.lower("symbol"))


@query("closed_range_filter", f"WITH {CANDLES} SELECT {_ALL} FROM c WHERE is_closed AND interval = '1h' AND symbol IN ('click', 'view') AND open_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def closed_range_filter(spark, d):
    bars = hourly(spark, d).withColumn("symbol", F.upper("symbol"))
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-09 12:00:00"))
    return C.closed_range(bars, "1h", start, end, ["click", "view"]).withColumn("symbol", F.lower("symbol")).select(ALL)


@query("time_range_slice", f"WITH {CANDLES} SELECT {_ALL} FROM c WHERE open_time >= (SELECT max(open_time) - INTERVAL 23 HOUR FROM c)")
def time_range_slice(spark, d):
    return C.latest_range(hourly(spark, d), I.parse_time_range("1d").hours).select(ALL)


@query("recent_candles_tail", f"WITH {CANDLES} SELECT {_ALL} FROM c ORDER BY open_time DESC, symbol DESC LIMIT 80")
def recent_candles_tail(spark, d):
    return hourly(spark, d).orderBy(F.desc("open_time"), F.desc("symbol")).limit(80).select(ALL)


@query("latest_market_rows", f"WITH {CANDLES} SELECT {_ALL} FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1")
def latest_market_rows(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return hourly(spark, d).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(ALL)


@query("active_interval", f"WITH {CANDLES} SELECT symbol, count(*) AS n FROM c WHERE interval = '1h' AND is_closed GROUP BY symbol")
def active_interval(spark, d):
    return C.closed_only(C.of_interval(hourly(spark, d), "1h")).groupBy("symbol").agg(F.count("*").alias("n"))


def _corrected(bars):
    """The bars, and later corrections of those on even hours: a close one higher."""
    even = F.hour("open_time") % 2 == 0
    fixed = bars.where(even).withColumn("close", F.col("close") + 1).withColumn("high", F.greatest("high", "close"))
    return bars.withColumn("ingest_seq", F.lit(0)).unionByName(fixed.withColumn("ingest_seq", F.lit(1)))


@query("upsert_keep_last", f"""WITH {CANDLES} SELECT symbol, open_time,
 CASE WHEN hour(open_time) % 2 = 0 THEN close + 1 ELSE close END AS "close" FROM c""")
def upsert_keep_last(spark, d):
    return store.keep_last(_corrected(hourly(spark, d))).select("symbol", "open_time", "close")


@query("duplicate_detection", f"WITH {CANDLES} SELECT symbol, CAST(2 * count(*) AS BIGINT) AS n FROM c WHERE hour(open_time) % 2 = 0 GROUP BY symbol")
def duplicate_detection(spark, d):
    return quality.duplicates(_corrected(hourly(spark, d))).groupBy("symbol").agg(F.count("*").alias("n"))


def _broken(bars):
    """Bars of hour 3 with high and low swapped, bars of hour 5 with a negative volume, bars of hour 7 still open."""
    h = F.hour("open_time")
    swap = h == 3
    return bars.withColumns({"high": F.when(swap, F.col("low")).otherwise(F.col("high")), "low": F.when(swap, F.col("high")).otherwise(F.col("low")), "volume": F.when(h == 5, -F.col("volume")).otherwise(F.col("volume")), "is_closed": h != 7})


BROKEN = """
k AS (SELECT symbol, interval, open_time, open, close, CASE WHEN hour(open_time) = 3 THEN low ELSE high END AS high, CASE WHEN hour(open_time) = 3 THEN high ELSE low END AS low,
             CASE WHEN hour(open_time) = 5 THEN -volume ELSE volume END AS volume, hour(open_time) <> 7 AS is_closed FROM c)"""
BAD = "(high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0)"


@query("ohlc_violations", f'WITH {CANDLES}, {BROKEN} SELECT symbol, open_time, "open", high, low, "close" FROM k WHERE {BAD}')
def ohlc_violations(spark, d):
    return _broken(hourly(spark, d)).where(quality.broken()).select("symbol", "open_time", "open", "high", "low", "close")


GAPS = "SELECT symbol, open_time, previous_open_time FROM (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS previous_open_time FROM {0}) WHERE open_time - previous_open_time > INTERVAL 1 HOUR"


@query("gap_detection", f"WITH {CANDLES} {GAPS.format('c')}")
def gap_detection(spark, d):
    return quality.gaps(hourly(spark, d), 3600).select("symbol", "open_time", "previous_open_time")


@query("missing_grid_anti_join", f"""WITH {CANDLES}, e AS (SELECT s.symbol, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-20', INTERVAL 1 HOUR)) AS open_time FROM (SELECT DISTINCT symbol FROM c) s)
SELECT e.symbol, e.open_time FROM e ANTI JOIN c ON e.symbol = c.symbol AND e.open_time = c.open_time""")
def missing_grid_anti_join(spark, d):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02 00:00:00", "2024-01-20 00:00:00"))
    return quality.missing_bars(hourly(spark, d), start, end, 3600)


OUTLIERS = """SELECT symbol, open_time, round(r, 8) AS r FROM (
 SELECT *, avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS s FROM (
  SELECT symbol, open_time, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY open_time) AS r FROM (
   SELECT symbol, open_time, CASE WHEN close > 0 THEN ln(close) END AS lp FROM {0}))) WHERE s > 0 AND abs(r - m) / s > {1}"""


@query("return_outliers", f"WITH {CANDLES} {OUTLIERS.format('c', 3.0)}")
def return_outliers(spark, d):
    return quality.return_outliers(hourly(spark, d), 3.0).select("symbol", "open_time", r("r"))


ISSUES = f"""
q AS (SELECT * FROM k WHERE is_closed),
i AS (SELECT 'error' AS severity, 'unclosed' AS "check", CAST(NULL AS VARCHAR) AS symbol, count(*) AS "count" FROM k WHERE NOT is_closed
      UNION ALL SELECT 'error', 'ohlc', NULL, count(*) FROM q WHERE {BAD}
      UNION ALL SELECT 'error', 'volume', NULL, count(*) FROM q WHERE volume < 0
      UNION ALL SELECT 'error', 'coverage', 'ABSENT', 1
      UNION ALL SELECT 'warning', 'missing', symbol, count(*) FROM ({GAPS.format('q')}) GROUP BY symbol
      UNION ALL SELECT 'warning', 'outlier', symbol, count(*) FROM ({OUTLIERS.format('q', 8.0)}) GROUP BY symbol)"""


def _issues(spark, d):
    bars = settled(_broken(hourly(spark, d)))
    names = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW", "ABSENT"]
    found = quality.validate(bars, "1h", names)
    return found.withColumn("symbol", F.when(F.col("symbol") == "ABSENT", "ABSENT").otherwise(F.lower("symbol")))


@query("candle_issues", f'WITH {CANDLES}, {BROKEN}, {ISSUES} SELECT severity, "check", symbol, "count" FROM i WHERE "count" > 0')
def candle_issues(spark, d):
    return _issues(spark, d).select("severity", "check", "symbol", "count")


@query("issue_counts_by_check", f'WITH {CANDLES}, {BROKEN}, {ISSUES} SELECT "check", CAST(sum(greatest("count", 1)) AS BIGINT) AS "count" FROM i WHERE "count" > 0 GROUP BY "check"')
def issue_counts_by_check(spark, d):
    return quality.issue_counts(_issues(spark, d), "check")


@query("issue_counts_by_symbol", f"""WITH {CANDLES}, {BROKEN}, {ISSUES} SELECT coalesce(symbol, 'ALL') AS symbol, CAST(sum(greatest("count", 1)) AS BIGINT) AS "count" FROM i WHERE "count" > 0 GROUP BY 1""")
def issue_counts_by_symbol(spark, d):
    return quality.issue_counts(_issues(spark, d), "symbol")


@query("data_accumulation", f"""WITH {CANDLES}, {BROKEN}, x AS (SELECT *, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) > INTERVAL 1 HOUR AS gap FROM k)
SELECT symbol, count(*) AS "rows", min(open_time) AS first_open_time, max(open_time) AS latest_open_time, count(*) FILTER (is_closed) AS closed_rows, count(*) FILTER (NOT is_closed) AS unclosed_rows,
 count(*) FILTER (gap) AS missing_gap_count, CAST(0 AS BIGINT) AS duplicate_rows, count(*) FILTER ({BAD}) AS ohlc_issue_rows, datediff('hour', min(open_time), max(open_time)) + 1 AS expected_rows,
 greatest(datediff('hour', min(open_time), max(open_time)) + 1 - count(DISTINCT open_time), 0) AS estimated_missing_candles FROM x GROUP BY symbol""")
def data_accumulation(spark, d):
    return quality.accumulation(_broken(hourly(spark, d)), "1h")


@query("coverage", f"WITH {CANDLES} SELECT CAST(datediff('hour', min(open_time), max(open_time)) AS DOUBLE) AS coverage_hours, count(*) AS total_rows FROM c")
def coverage(spark, d):
    return quality.coverage_hours(hourly(spark, d))


@query("simulation_data_quality", f"""WITH {CANDLES}, z AS (SELECT * FROM c WHERE open_time BETWEEN TIMESTAMP '2024-01-03 00:30:00' AND TIMESTAMP '2024-01-19 23:10:00'),
e AS (SELECT s.symbol, unnest(generate_series(TIMESTAMP '2024-01-03 01:00:00', TIMESTAMP '2024-01-19 23:00:00', INTERVAL 1 HOUR)) AS open_time FROM (SELECT DISTINCT symbol FROM c) s),
m AS (SELECT symbol, count(*) AS n FROM (SELECT e.symbol FROM e ANTI JOIN z ON e.symbol = z.symbol AND e.open_time = z.open_time) GROUP BY symbol),
gp AS (SELECT symbol, count(*) AS n FROM ({GAPS.format('z')}) GROUP BY symbol),
h AS (SELECT symbol, count(*) AS n, min(open_time) AS a, max(open_time) AS o FROM z GROUP BY symbol)
SELECT h.symbol, h.n AS "rows", a AS first_open_time, o AS latest_open_time, CAST(407 AS BIGINT) AS expected_rows, coalesce(m.n, 0) AS missing_candle_count, coalesce(gp.n, 0) AS gap_count,
 round(coalesce(m.n, 0) / 407.0, 8) AS missing_rate, round_even(100 * (1 - coalesce(m.n, 0) / 407.0), 4) AS coverage_pct,
 CASE WHEN h.n - 1 > 101 THEN CAST(floor((h.n - 1 - 1 - 1 - 99) / 5) + 1 AS BIGINT) ELSE 0 END AS origin_count
FROM h LEFT JOIN m USING (symbol) LEFT JOIN gp USING (symbol)""")
def simulation_data_quality(spark, d):
    bars = hourly(spark, d).withColumn("symbol", F.upper("symbol"))
    out = quality.simulation_quality(bars, "1h", "2024-01-03 00:30:00", "2024-01-19 23:10:00", 100, 1, 5, ["click", "error", "purchase", "signup", "view"])
    return out.withColumn("missing_rate", r("missing_rate")).withColumn("symbol", F.lower("symbol"))


@query("close_matrix_pivot", f"WITH {CANDLES}, {RETURNS} SELECT open_time, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM d GROUP BY open_time")
def close_matrix_pivot(spark, d):
    return features.close_matrix(hourly(spark, d), ["click", "error", "purchase", "signup", "view"]).drop("interval")


@query("log_returns", f"WITH {CANDLES}, {RETURNS} SELECT open_time, symbol, round(log_return, 8) AS log_return FROM rt")
def log_returns(spark, d):
    return rounded(features.log_returns(hourly(spark, d)), TS, ["log_return"])


@query("log_price", f"WITH {CANDLES}, {RETURNS} SELECT open_time, symbol, round(lp, 8) AS log_price FROM rt")
def log_price_query(spark, d):
    return rounded(features.log_returns(hourly(spark, d)), TS, ["log_price"])


@query("basket_return", f"WITH {CANDLES}, {RETURNS} SELECT open_time, round(basket_return, 8) AS basket_return, round(basket_price, 6) AS basket_price FROM b")
def basket_return(spark, d):
    return features.basket(features.log_returns(hourly(spark, d))).select("open_time", r("basket_return"), r("basket_price", 6))


@query("seasonal_difference", f"WITH {LINE} SELECT open_time, symbol, round(close - lag(close, 7) OVER (PARTITION BY symbol ORDER BY open_time), 6) AS diff7, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time), 6) AS diff1 FROM c")
def seasonal_difference(spark, d):
    w = R.ordered("symbol")
    x = F.col("close")
    return daily(spark, d).select("open_time", "symbol", r(x - F.lag(x, 7).over(w), 6, "diff7"), r(x - F.lag(x).over(w), 6, "diff1"))


def _returns(spark, d):
    """Dense returns of hourly bars, written once a query: ticks are resampled once."""
    return settled(features.log_returns(hourly(spark, d)))


def _market(spark, d):
    return features.volatility_block(features.basket(_returns(spark, d)), W)


@query("realized_vol", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, round(market_vol, 8) AS market_vol FROM mv")
def realized_vol(spark, d):
    market = features.basket(_returns(spark, d))
    vol = R.std(F.col("basket_return"), R.trailing(W.short, "interval"), R.least("basic", W.short))
    return market.select("open_time", r(vol, 8, "market_vol"))


@query("asset_vol_mean", f"WITH {CANDLES}, {RETURNS}, v AS (SELECT *, {sql_std('log_return', W.short, 6, 'symbol')} AS s, {sql_std('log_return', W.medium, 18, 'symbol')} AS m FROM rt) SELECT open_time, round(avg(s), 8) AS short, round(avg(m), 8) AS medium FROM v GROUP BY open_time")
def asset_vol_mean(spark, d):
    return rounded(features.asset_vols(_returns(spark, d), {"short": W.short, "medium": W.medium}), T, ["short", "medium"])


@query("rolling_mean", f"WITH {CANDLES}, {RETURNS} SELECT open_time, symbol, round(CASE WHEN count(log_return) {win(24, 'symbol')} >= 6 THEN avg(log_return) {win(24, 'symbol')} END, 8) AS mean FROM rt")
def rolling_mean(spark, d):
    return _returns(spark, d).select(*TS, r(R.mean(F.col("log_return"), R.trailing(24, "interval", "symbol"), 6), 8, "mean"))


@query("ewma_vol", f"WITH {CANDLES}, {RETURNS}, {EWMA} SELECT b.open_time, CASE WHEN ew.k >= 3 THEN round(sqrt(ew.v), 8) END AS ewma_vol FROM b LEFT JOIN ew USING (open_time)")
def ewma_vol(spark, d):
    v = features.ewma(features.basket(_returns(spark, d)), "basket_return", "v", 24, ["interval"])
    return v.select("open_time", r(F.sqrt("v"), 8, "ewma_vol"))


@query("range_vol", f"""WITH {CANDLES}, x AS (SELECT open_time, avg(CASE WHEN high > 0 AND low > 0 THEN sqrt(pow(ln(high / low), 2) / (4 * ln(2))) END) AS v FROM c GROUP BY open_time)
SELECT open_time, round(CASE WHEN count(v) {win(24)} >= 6 THEN avg(v) {win(24)} END, 8) AS range_vol FROM x""")
def range_vol(spark, d):
    return rounded(features.range_volatility(hourly(spark, d), W.short), T, ["range_vol"])


LISTED = f"(SELECT open_time, list(market_vol) FILTER (market_vol IS NOT NULL) {win(W.long)} AS a FROM mv)"


@query("vol_percentile", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, CASE WHEN len(a) >= 42 THEN round(len(list_filter(a, lambda v: v <= a[len(a)])) / len(a), 8) END AS vol_percentile FROM {LISTED}")
def vol_percentile(spark, d):
    return rounded(_market(spark, d), T, ["vol_percentile"])


@query("vol_z_score", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, round((market_vol - CASE WHEN count(market_vol) {win(W.long)} >= 10 THEN avg(market_vol) {win(W.long)} END) / nullif({sql_std('market_vol', W.long, 10)}, 0), 6) AS vol_z_score FROM mv")
def vol_z_score(spark, d):
    return rounded(_market(spark, d), T, ["vol_z_score"], 6)


@query("vol_of_vol", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, round({sql_std('market_vol', W.medium, 10)}, 8) AS vol_of_vol FROM mv")
def vol_of_vol(spark, d):
    return rounded(_market(spark, d), T, ["vol_of_vol"])


MOMENTS = f"""x AS (SELECT open_time, symbol, count(log_return) {win(48, 'symbol')} AS n, list(log_return) FILTER (log_return IS NOT NULL) {win(48, 'symbol')} AS a FROM rt),
y AS (SELECT *, list_avg(a) AS m FROM x), z AS (SELECT *, list_avg(list_transform(a, lambda v: pow(v - m, 2))) AS v2, list_avg(list_transform(a, lambda v: pow(v - m, 3))) AS v3, list_avg(list_transform(a, lambda v: pow(v - m, 4))) AS v4 FROM y)"""


@query("rolling_skew", f"WITH {CANDLES}, {RETURNS}, {MOMENTS} SELECT open_time, symbol, CASE WHEN n >= 12 THEN round(CASE WHEN v2 > 0 THEN v3 / pow(v2, 1.5) ELSE 0 END, 5) + 0.0 END AS skew FROM z")
def rolling_skew(spark, d):
    w, x = R.trailing(48, "interval", "symbol"), F.col("log_return")
    return _returns(spark, d).select(*TS, r(R.rolled(F.skewness(x), x, w, 12), 5, "_s"), F.count(x).over(w).alias("_n")).select(*TS, F.when(F.col("_n") >= 12, F.coalesce("_s", F.lit(0.0))).alias("skew"))


@query("rolling_kurtosis", f"WITH {CANDLES}, {RETURNS}, {MOMENTS} SELECT open_time, symbol, CASE WHEN n >= 12 THEN round(CASE WHEN v2 > 0 THEN v4 / (v2 * v2) - 3 ELSE 0 END, 5) + 0.0 END AS kurtosis FROM z")
def rolling_kurtosis(spark, d):
    w, x = R.trailing(48, "interval", "symbol"), F.col("log_return")
    return _returns(spark, d).select(*TS, r(R.rolled(F.kurtosis(x), x, w, 12), 5, "_s"), F.count(x).over(w).alias("_n")).select(*TS, F.when(F.col("_n") >= 12, F.coalesce("_s", F.lit(0.0))).alias("kurtosis"))


PAIRS = f"""pr AS (SELECT x.open_time, x.symbol AS a, y.symbol AS b, CASE WHEN y.log_return IS NOT NULL THEN x.log_return END AS x, CASE WHEN x.log_return IS NOT NULL THEN y.log_return END AS y FROM rt x JOIN rt y ON x.open_time = y.open_time AND x.symbol < y.symbol),
pc AS (SELECT open_time, a, b, CASE WHEN count(x) {win(W.long, 'a', 'b')} >= 42 THEN covar_samp(x, y) {win(W.long, 'a', 'b')} END AS cov,
 CASE WHEN count(x) {win(W.long, 'a', 'b')} >= 42 THEN covar_samp(x, y) {win(W.long, 'a', 'b')} / nullif(stddev_samp(x) {win(W.long, 'a', 'b')} * stddev_samp(y) {win(W.long, 'a', 'b')}, 0) END AS corr FROM pr)"""


@query("rolling_cov", f"WITH {CANDLES}, {RETURNS}, {PAIRS} SELECT open_time, a, b, round(cov, 8) AS cov, round(corr, 6) AS corr FROM pc")
def rolling_cov(spark, d):
    return features.rolling_pairs(_returns(spark, d), W.long).select("open_time", "a", "b", r("cov"), r("corr", 6))


AVG_CORR = f"ac AS (SELECT open_time, last_value(m IGNORE NULLS) OVER (ORDER BY open_time) AS avg_pairwise_corr FROM (SELECT open_time, avg(corr) AS m FROM pc GROUP BY open_time))"


@query("avg_pairwise_corr", f"WITH {CANDLES}, {RETURNS}, {PAIRS}, {AVG_CORR} SELECT open_time, round(avg_pairwise_corr, 7) AS avg_pairwise_corr FROM ac")
def avg_pairwise_corr(spark, d):
    return rounded(features.average_correlation(_returns(spark, d), W.long), T, ["avg_pairwise_corr"], 7)


@query("rolling_beta", f"""WITH {CANDLES}, {RETURNS}, m AS (SELECT open_time, log_return AS m FROM rt WHERE symbol = '{BENCHMARK}'),
x AS (SELECT rt.symbol, rt.open_time, m, CASE WHEN m IS NOT NULL THEN log_return END AS x, CASE WHEN log_return IS NOT NULL THEN m END AS y FROM rt LEFT JOIN m USING (open_time) WHERE symbol <> '{BENCHMARK}'),
bt AS (SELECT symbol, open_time, CASE WHEN count(x) {win(72, 'symbol')} >= 18 THEN covar_samp(x, y) {win(72, 'symbol')} END / nullif(CASE WHEN count(m) {win(72, 'symbol')} >= 18 THEN var_samp(m) {win(72, 'symbol')} END, 0) AS beta FROM x)
SELECT open_time, round(avg(beta), 7) AS avg_beta FROM bt GROUP BY open_time""")
def rolling_beta(spark, d):
    return features.beta(_returns(spark, d), BENCHMARK, W.medium).groupBy("open_time").agg(F.avg("beta").alias("avg_beta")).select("open_time", r("avg_beta", 7))


PCA_TWO = f"""p2 AS (SELECT p.open_time, CASE WHEN q.log_return IS NOT NULL THEN p.log_return END AS x, CASE WHEN p.log_return IS NOT NULL THEN q.log_return END AS y
 FROM rt p JOIN rt q ON p.open_time = q.open_time AND p.symbol = 'click' AND q.symbol = 'view'),
p3 AS (SELECT open_time, count(x) {win(72)} AS n, var_samp(x) {win(72)} AS a, var_samp(y) {win(72)} AS e, covar_samp(x, y) {win(72)} AS v FROM p2),
ps AS (SELECT open_time, round(last_value(CASE WHEN n >= 18 AND a + e > 0 THEN ((a + e) / 2 + sqrt(pow((a - e) / 2, 2) + v * v)) / (a + e) END IGNORE NULLS) OVER (ORDER BY open_time), 7) AS pca1_share FROM p3)"""


@query("pca1_share_two_symbols", f"WITH {CANDLES}, {RETURNS}, {PCA_TWO} SELECT open_time, pca1_share FROM ps")
def pca1_share_two_symbols(spark, d):
    full = _returns(spark, d).where(F.col("symbol").isin("click", "view"))
    return rounded(features.pca_share(full, W.medium), T, ["pca1_share"], 7)




@query("dispersion", f"WITH {CANDLES}, {RETURNS}, {MARKET}, v AS (SELECT *, {sql_std('log_return', W.short, 6, 'symbol')} AS s FROM rt), a AS (SELECT open_time, avg(s) AS s FROM v GROUP BY open_time) SELECT open_time, round(s - market_vol, 8) AS dispersion FROM mv JOIN a USING (open_time)")
def dispersion(spark, d):
    returns = _returns(spark, d)
    vols = features.asset_vols(returns, {"_s": W.short})
    both = features.volatility_block(features.basket(returns), W).join(vols, list(features.AT))
    return both.select("open_time", r(F.col("_s") - F.col("market_vol"), 8, "dispersion"))


TREND = f"""y AS (SELECT open_time, CASE WHEN basket_price > 0 THEN ln(basket_price) END AS y, CASE WHEN basket_price > 0 THEN CAST(row_number() OVER (ORDER BY open_time) AS DOUBLE) END AS i FROM b),
f AS (SELECT open_time, count(y) {win(24)} AS n, regr_sxx(y, i) {win(24)} AS sxx, regr_syy(y, i) {win(24)} AS syy, regr_sxy(y, i) {win(24)} AS sxy FROM y),
tr AS (SELECT open_time, n, CASE WHEN n >= 8 THEN sxy / nullif(sxx, 0) END AS slope, CASE WHEN n >= 8 THEN sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2) / nullif(sxx, 0)) END AS se FROM f)"""


def _trend(spark, d, bars):
    returns = settled(features.log_returns(bars(spark, d)))
    return features.trend_block(features.volatility_block(features.basket(returns), W), W)


@query("trend_slope", f"WITH {LINE}, {RETURNS}, {TREND} SELECT open_time, round(slope, 7) AS trend_slope FROM tr")
def trend_slope(spark, d):
    return rounded(_trend(spark, d, daily), T, ["trend_slope"], 7)


@query("trend_tstat", f"WITH {LINE}, {RETURNS}, {TREND} SELECT open_time, round(CASE WHEN se = 0 THEN 0 ELSE slope / nullif(se, 0) END, 5) AS trend_tstat FROM tr")
def trend_tstat(spark, d):
    return rounded(_trend(spark, d, daily), T, ["trend_tstat"], 5)


@query("trend_strength", f"WITH {LINE}, {RETURNS}, {TREND}, {MARKET} SELECT open_time, round(slope / nullif(market_vol, 0), 6) AS trend_strength FROM tr JOIN mv USING (open_time)")
def trend_strength(spark, d):
    return rounded(_trend(spark, d, daily), T, ["trend_strength"], 6)


@query("trend_autocorr", f"""WITH {LINE}, {RETURNS}, w AS (SELECT open_time, list(basket_return) FILTER (basket_return IS NOT NULL) {win(24)} AS a FROM b),
u AS (SELECT open_time, len(a) AS n, a[1:len(a)-1] AS p, a[2:len(a)] AS q FROM w),
v AS (SELECT open_time, n, list_transform(p, lambda e: e - list_avg(p)) AS p, list_transform(q, lambda e: e - list_avg(q)) AS q FROM u)
SELECT open_time, CASE WHEN n >= 8 THEN round(CASE WHEN list_dot_product(p, p) * list_dot_product(q, q) > 0 THEN list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)) ELSE 0 END, 6) END AS trend_autocorr FROM v""")
def trend_autocorr(spark, d):
    return rounded(_trend(spark, d, daily), T, ["trend_autocorr"], 6)


@query("up_down_ratio", f"WITH {LINE}, {RETURNS} SELECT open_time, CASE WHEN count(basket_return) {win(24)} >= 8 THEN round(coalesce(count(*) FILTER (basket_return > 0) {win(24)} / nullif(count(*) FILTER (basket_return <> 0) {win(24)}, 0), 0.5), 8) END AS up_down_ratio FROM b")
def up_down_ratio(spark, d):
    return rounded(_trend(spark, d, daily), T, ["up_down_ratio"])


def bundle(spark, d):
    return features.feature_bundle(hourly(spark, d), BENCHMARK, W)


@query("feature_bundle")
def feature_bundle(spark, d):
    return rounded(bundle(spark, d).features, T, list(features.FEATURES), 6)


@query("forecast_vol", f"WITH {CANDLES}, {RETURNS}, {EWMA}, {MARKET} SELECT mv.open_time, round(coalesce(last_value(sqrt(v) IGNORE NULLS) OVER (ORDER BY mv.open_time), market_vol), 8) AS forecast_vol FROM mv LEFT JOIN ew USING (open_time)")
def forecast_vol(spark, d):
    return rounded(labels.forecast_series(_market(spark, d)), T, ["forecast_vol"])


@query("expanding_quantile", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, CASE WHEN count(market_vol) OVER (ORDER BY open_time) >= 30 THEN round(quantile_cont(market_vol, 0.75) OVER (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) END AS q75 FROM mv")
def expanding_quantile(spark, d):
    return rounded(labels.expanding_quantile(_market(spark, d), "market_vol", "q75", 0.75, 30), T, ["q75"])


@query("rolling_quantile", f"WITH {CANDLES}, {RETURNS}, {MARKET} SELECT open_time, CASE WHEN count(market_vol) {win(72)} >= 10 THEN round(quantile_cont(market_vol, 0.4) {win(72)}, 8) END AS q40 FROM mv")
def rolling_quantile(spark, d):
    return rounded(labels.rolling_quantile(_market(spark, d), "market_vol", "q40", 0.4, 72, 10), T, ["q40"])


SYMBOLS = ("click", "error", "purchase", "signup", "view")
_CELLS = [(i, j) for i in range(5) for j in range(i, 5)]


def _cell(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


def _pca_all() -> str:
    """The share of all symbols in SQL: their covariance matrix is squared and scaled until its powers are those of the
    largest eigenvalue alone; the error is below 2 ** -24 of it."""
    wide = ", ".join(f"max(log_return) FILTER (symbol = '{s}') AS x{i}" for i, s in enumerate(SYMBOLS))
    all_there = " AND ".join(f"x{i} IS NOT NULL" for i in range(5))
    whole = ", ".join(f"CASE WHEN {all_there} THEN x{i} END AS x{i}" for i in range(5))
    cov = ", ".join(f"covar_pop(x{i}, x{j}) {win(W.long)} AS {_cell(i, j)}" for i, j in _CELLS)
    out = f"""pw AS (SELECT open_time, {whole} FROM (SELECT open_time, {wide} FROM rt GROUP BY open_time)),
pm AS (SELECT open_time, count(x0) {win(W.long)} AS n, {cov} FROM pw),
p0 AS (SELECT open_time, {', '.join(f'{_cell(i, j)} / nullif(' + ' + '.join(f'm{k}{k}' for k in range(5)) + f', 0) AS {_cell(i, j)}' for i, j in _CELLS)} FROM pm WHERE n >= {R.least('pair', W.long)}),
q0 AS (SELECT * FROM p0)"""
    for k in range(1, 25):
        square = lambda i, j: " + ".join(f"{_cell(i, c)} * {_cell(c, j)}" for c in range(5))
        trace = " + ".join(f"({square(i, i)})" for i in range(5))
        out += f""",
q{k} AS (SELECT open_time, {', '.join(f'({square(i, j)}) / nullif({trace}, 0) AS {_cell(i, j)}' for i, j in _CELLS)} FROM q{k - 1})"""
    rayleigh = " + ".join(f"{2 if i != j else 1} * p0.{_cell(i, j)} * q24.{_cell(i, j)}" for i, j in _CELLS)
    return out + f""",
ps AS (SELECT b.open_time, round(last_value(v IGNORE NULLS) OVER (ORDER BY b.open_time), 6) AS pca1_share FROM b LEFT JOIN (SELECT p0.open_time, {rayleigh} AS v FROM p0 JOIN q24 USING (open_time)) USING (open_time))"""


PCA_ALL = _pca_all()


@query("pca1_share", f"WITH {CANDLES}, {RETURNS}, {PCA_ALL} SELECT open_time, pca1_share FROM ps")
def pca1_share(spark, d):
    return rounded(features.pca_share(_returns(spark, d), W.long), T, ["pca1_share"], 6)


SPINE = f"""sv AS (SELECT open_time, avg(s) AS s FROM (SELECT *, {sql_std('log_return', W.short, 6, 'symbol')} AS s FROM rt) GROUP BY open_time),
fr AS (SELECT mv.open_time, basket_return, round(market_vol, 9) AS market_vol, round(coalesce(last_value(sqrt(v) IGNORE NULLS) OVER (ORDER BY mv.open_time), market_vol), 9) AS forecast_vol,
 round(avg_pairwise_corr, 9) AS avg_pairwise_corr, round(s - market_vol, 9) AS dispersion, pca1_share FROM mv LEFT JOIN ew USING (open_time) JOIN ac USING (open_time) JOIN sv USING (open_time) LEFT JOIN ps USING (open_time))"""


def _frame(spark, d):
    """The columns that labels need, rounded so that equal inputs are compared with limits, written once; and the returns."""
    returns = _returns(spark, d)
    market = labels.forecast_series(features.volatility_block(features.basket(returns), W))
    corr = features.average_correlation(returns, W.long)
    vols = features.asset_vols(returns, {"_s": W.short})
    share = features.pca_share(returns, W.long)
    joined = market.join(corr, list(features.AT)).join(vols, list(features.AT)).join(share, list(features.AT), "left").withColumn("dispersion", F.col("_s") - F.col("market_vol"))
    cols = ["market_vol", "forecast_vol", "avg_pairwise_corr", "dispersion"]
    return settled(joined.select("interval", "open_time", "basket_return", *(r(c, 9) for c in cols), r("pca1_share", 6))), returns


def _q(x: str, q: float) -> str:
    frame = "OVER (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= 30 THEN quantile_cont({x}, {q}) {frame} END"


REGIMES = f"""th AS (SELECT *, {_q('forecast_vol', .75)} AS a, {_q('market_vol', .75)} AS m, {_q('avg_pairwise_corr', .75)} AS ch, {_q('avg_pairwise_corr', .4)} AS cl, {_q('dispersion', .75)} AS dh, {_q('pca1_share', .75)} AS ph, {_q('pca1_share', .4)} AS pl FROM fr),
rg AS (SELECT open_time, CASE WHEN a IS NULL OR m IS NULL OR ch IS NULL OR cl IS NULL OR dh IS NULL OR ph IS NULL OR pl IS NULL THEN 'QUIET_CORRELATED'
 WHEN (coalesce(forecast_vol, 0) >= a OR coalesce(market_vol, 0) >= m) AND coalesce(avg_pairwise_corr, 0) >= ch AND coalesce(pca1_share, 0) >= ph THEN 'SYSTEMIC_RISK'
 WHEN (coalesce(forecast_vol, 0) >= a OR coalesce(market_vol, 0) >= m) AND coalesce(avg_pairwise_corr, 0) < ch AND coalesce(dispersion, 0) >= dh THEN 'IDIOSYNCRATIC_HIGH_VOL'
 WHEN coalesce(forecast_vol, 0) <= a AND coalesce(avg_pairwise_corr, 0) <= cl AND coalesce(pca1_share, 0) <= pl THEN 'ASSET_SPECIFIC' ELSE 'QUIET_CORRELATED' END AS regime FROM th)"""
LABELS = f"{CANDLES}, {RETURNS}, {EWMA}, {MARKET}, {PAIRS}, {AVG_CORR}, {PCA_ALL}, {SPINE}"


@query("regime_labels", f"WITH {LABELS}, {REGIMES} SELECT open_time, regime FROM rg")
def regime_labels(spark, d):
    return labels.regimes(_frame(spark, d)[0]).select("open_time", "regime")


SHOCKS = f"""sc AS (SELECT *, lag(sd) OVER (PARTITION BY symbol ORDER BY open_time) AS scale FROM (SELECT *, {sql_std('log_return', 24, 6, 'symbol')} AS sd FROM rt)),
br AS (SELECT open_time, avg(CASE WHEN abs(log_return) / nullif(scale, 0) > 2 THEN 1.0 ELSE 0.0 END) AS breadth FROM sc GROUP BY open_time),
s1 AS (SELECT fr.*, breadth, abs(basket_return) / nullif(lag(forecast_vol) OVER (ORDER BY open_time), 0) AS score, {sql_std('basket_return', 6, 3)} AS rv FROM fr JOIN br USING (open_time)),
s2 AS (SELECT *, CASE WHEN count(rv) {win(30)} >= 6 THEN quantile_cont(rv, 0.5) {win(30)} END AS med, CASE WHEN count(dispersion) OVER (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 10 THEN
 quantile_cont(dispersion, 0.75) OVER (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS lim FROM s1),
sh AS (SELECT *, rv / nullif(lag(med) OVER (ORDER BY open_time), 0) AS jump FROM s2),
st AS (SELECT *, CASE WHEN coalesce(score, 0) >= 3 AND coalesce(breadth, 0) >= 0.6 AND coalesce(avg_pairwise_corr, 0) >= 0.5 THEN 'SYSTEMIC_VOL_SHOCK'
 WHEN coalesce(score, 0) >= 3 AND coalesce(breadth, 0) < 0.6 AND coalesce(dispersion, 0) >= coalesce(lim, 'infinity'::DOUBLE) THEN 'IDIOSYNCRATIC_VOL_SHOCK'
 WHEN coalesce(jump, 1) >= 2 THEN 'VOL_REGIME_BUILDUP' WHEN coalesce(score, 0) >= 2 THEN 'MODERATE_SHOCK' ELSE 'NORMAL' END AS shock_type FROM sh)"""


@query("shock_labels", f"WITH {LABELS}, {SHOCKS} SELECT open_time, shock_type, round(score, 6) AS shock_score, round(jump, 6) AS rv_jump_ratio, round(breadth, 6) AS shock_breadth FROM st")
def shock_labels(spark, d):
    frame, returns = _frame(spark, d)
    return labels.shocks(frame, returns).select("open_time", "shock_type", r("shock_score", 6), r("rv_jump_ratio", 6), r("shock_breadth", 6))


@query("shock_frequency", f"WITH {LABELS}, {SHOCKS} SELECT shock_type, count(*) AS \"count\", round(count(*) / sum(count(*)) OVER (), 8) AS share FROM st GROUP BY shock_type")
def shock_frequency(spark, d):
    frame, returns = _frame(spark, d)
    return evaluation.shares(labels.shocks(frame, returns), "shock_type").select("shock_type", "count", r("share"))


@query("forward_fill_join", f"WITH {LABELS}, {REGIMES} SELECT c.symbol, c.open_time, last_value(CASE WHEN hour(c.open_time) % 6 = 0 THEN regime END IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.open_time) AS regime FROM c LEFT JOIN rg USING (open_time)")
def forward_fill_join(spark, d):
    six = labels.regimes(_frame(spark, d)[0]).where(F.hour("open_time") % 6 == 0).select("open_time", "regime")
    joined = hourly(spark, d).join(six, "open_time", "left")
    return joined.select("symbol", "open_time", R.forward_fill(F.col("regime"), R.expanding("symbol")).alias("regime"))


#: The forecasts that SQL can follow: the EWMA forecast that labels use, the emitted EWMA, and the market's volatility.
FORECASTS = ("forecast", "ewma", "naive")
ALIGNED = f"""fx AS (SELECT fr.open_time, fr.basket_return AS "return", lag(forecast_vol) OVER (ORDER BY fr.open_time) AS forecast, lag(CASE WHEN ew.k >= 3 THEN round(sqrt(ew.v), 9) END) OVER (ORDER BY fr.open_time) AS ewma, lag(market_vol) OVER (ORDER BY fr.open_time) AS naive
 FROM fr LEFT JOIN ew USING (open_time) WHERE basket_return IS NOT NULL), al AS (SELECT * FROM fx WHERE forecast > 0 AND ewma > 0 AND naive > 0),
ls AS (SELECT open_time, "return" AS ret, forecast, """ + ", ".join(
    f"""pow("return" * "return" - {m} * {m}, 2) AS {m}_se, abs("return" * "return" - {m} * {m}) AS {m}_ae, "return" * "return" / ({m} * {m}) + ln({m} * {m}) AS {m}_q""" for m in ("forecast", "ewma", "naive")
) + " FROM al)"


def _pairs(spark, d, frame=None):
    frame = _frame(spark, d)[0] if frame is None else frame
    smooth = features.ewma(frame, "basket_return", "_v", W.short, ["interval"]).select(*features.AT, r(F.sqrt("_v"), 9, "ewma_vol"))
    return evaluation.aligned(frame.join(smooth, list(features.AT), "left"), {"forecast": "forecast_vol", "ewma": "ewma_vol", "naive": "market_vol"})


@query("walk_forward_losses", f"WITH {LABELS}, {ALIGNED} SELECT open_time, " + ", ".join(f"round({m}_se, 8) AS {m}_squared_error, round({m}_ae, 8) AS {m}_absolute_error, round({m}_q, 5) AS {m}_qlike" for m in FORECASTS) + " FROM ls")
def walk_forward_losses(spark, d):
    out = evaluation.losses(_pairs(spark, d), FORECASTS)
    return out.select("open_time", *(r(c, 5 if c.endswith("qlike") else 8) for c in out.columns[2:]))


@query("walk_forward_metrics", f"WITH {LABELS}, {ALIGNED}, u AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS i, '{m}' AS model, sqrt(avg(pow("return" * "return" - {m} * {m}, 2))) AS rmse, avg(abs("return" * "return" - {m} * {m})) AS mae, avg({m} * {m} - "return" * "return") AS bias, avg("return" * "return" / ({m} * {m}) + ln({m} * {m})) AS qlike, covar_samp({m}, abs("return")) / nullif(stddev_samp({m}) * stddev_samp(abs("return")), 0) AS corr, count(*) AS n FROM al"""
    for i, m in enumerate(FORECASTS)
) + ") SELECT model, round(rmse, 7) AS rmse, round(mae, 7) AS mae, round(bias, 7) AS bias, round(qlike, 6) AS qlike, round(corr, 6) AS corr, n, row_number() OVER (ORDER BY qlike, i) = 1 AS best FROM u")
def walk_forward_metrics(spark, d):
    out = evaluation.metrics(_pairs(spark, d), FORECASTS)
    return out.select("model", r("rmse", 7), r("mae", 7), r("bias", 7), r("qlike", 6), r("corr", 6), "n", "best")


@query("calibration_deciles", f"""WITH {LABELS}, {ALIGNED}, ed AS (SELECT list_sort(list_distinct(quantile_cont(forecast, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]))) AS e FROM al)
SELECT CAST(greatest(1, len(list_filter(e, lambda v: v < forecast))) AS INTEGER) AS bucket, round(avg(forecast), 8) AS forecast_vol, round(avg(abs("return")), 8) AS realized_abs_return, count(*) AS observations FROM al, ed GROUP BY 1""")
def calibration_deciles(spark, d):
    return evaluation.calibration(_pairs(spark, d), "forecast").select("bucket", r("forecast_vol"), r("realized_abs_return"), "observations")


@query("vol_by_regime", f"""WITH {LABELS}, {REGIMES}, {ALIGNED} SELECT regime, round(stddev_samp("return"), 8) AS realized_vol, round(avg(abs("return")), 8) AS mean_abs_return, count(*) AS observations FROM al JOIN rg USING (open_time) GROUP BY regime""")
def vol_by_regime(spark, d):
    frame = _frame(spark, d)[0]
    out = evaluation.vol_by_regime(_pairs(spark, d, frame), labels.regimes(frame))
    return out.select("regime", r("realized_vol"), r("mean_abs_return"), "observations")


CENTRED = "dv AS (SELECT open_time, basket_return - avg(basket_return) OVER () AS d, basket_return AS x FROM b WHERE basket_return IS NOT NULL)"
_LAGS = 10
ACF = f"lg AS (SELECT d, {', '.join(f'lag(d, {k}) OVER (ORDER BY open_time) AS d{k}' for k in range(1, _LAGS + 1))} FROM dv), rho AS (" + " UNION ALL ".join(
    f"SELECT {k} AS lag, sum(d * d{k}) / nullif(sum(d * d), 0) AS acf, count(*) AS n FROM lg" for k in range(1, _LAGS + 1)) + ")"


def _basket(spark, d):
    return features.basket(_returns(spark, d))


@query("acf", f"WITH {CANDLES}, {RETURNS}, {CENTRED}, {ACF} SELECT 0 AS lag, 1.0::DOUBLE AS acf UNION ALL SELECT lag, round(acf, 7) FROM rho")
def acf(spark, d):
    return evaluation.acf(_basket(spark, d), "basket_return", _LAGS).select("lag", r("acf", 7))


@query("ljung_box_q", f"WITH {CANDLES}, {RETURNS}, {CENTRED}, {ACF} SELECT round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 4) AS statistic, max(n) AS n FROM rho")
def ljung_box_q(spark, d):
    return evaluation.ljung_box(_basket(spark, d), "basket_return", _LAGS).select(r("statistic", 4), "n")


@query("jarque_bera", f"""WITH {CANDLES}, {RETURNS}, {CENTRED}, m AS (SELECT count(*) AS n, avg(d * d) AS v2, avg(d * d * d) AS v3, avg(d * d * d * d) AS v4 FROM dv)
SELECT round(n / 6.0 * (pow(v3 / pow(v2, 1.5), 2) + pow(v4 / (v2 * v2) - 3, 2) / 4), 4) AS statistic, round(v3 / pow(v2, 1.5), 6) AS skewness, round(v4 / (v2 * v2), 6) AS kurtosis, n FROM m""")
def jarque_bera(spark, d):
    return evaluation.jarque_bera(_basket(spark, d), "basket_return").select(r("statistic", 4), r("skewness", 6), r("kurtosis", 6), "n")


HAC = """hd AS (SELECT open_time, forecast_q - naive_q AS x, forecast_q - naive_q - avg(forecast_q - naive_q) OVER () AS d FROM ls),
hl AS (SELECT x, d, """ + ", ".join(f"lag(d, {k}) OVER (ORDER BY open_time) AS d{k}" for k in range(1, 13)) + """ FROM hd),
hs AS (SELECT count(*) AS n, avg(x) AS m, greatest(1, least(12, CAST(floor(sqrt(count(*))) AS INTEGER))) AS l, sum(d * d) AS g0, """ + ", ".join(f"coalesce(sum(d * d{k}), 0) AS g{k}" for k in range(1, 13)) + """ FROM hl),
hv AS (SELECT n, m, g0 / n + """ + " + ".join(f"CASE WHEN l >= {k} THEN 2 * (1 - {k} / (l + 1.0)) * g{k} / n ELSE 0 END" for k in range(1, 13)) + " AS v FROM hs)"


@query("diebold_mariano", f"WITH {LABELS}, {ALIGNED}, {HAC} SELECT n, round(m, 5) AS mean, round(CASE WHEN v > 0 THEN m / sqrt(v / n) ELSE 0 END, 4) AS statistic FROM hv")
def diebold_mariano(spark, d):
    diff = evaluation.losses(_pairs(spark, d), FORECASTS).withColumn("x", F.col("forecast_qlike") - F.col("naive_qlike"))
    return evaluation.hac_mean(diff, "x").select("n", r("mean", 5), r("statistic", 4))


@query("mincer_zarnowitz", f"""WITH {LABELS}, {ALIGNED}, k AS (SELECT count(*) AS n, regr_sxx("return" * "return", forecast * forecast) AS sxx, regr_syy("return" * "return", forecast * forecast) AS syy, regr_sxy("return" * "return", forecast * forecast) AS sxy FROM al)
SELECT n, round(sxy / sxx, 5) AS slope, round((sxy / sxx - 1) / sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx), 4) AS statistic FROM k WHERE n >= 20""")
def mincer_zarnowitz(spark, d):
    return evaluation.mincer_zarnowitz(_pairs(spark, d), "forecast").select("n", r("slope", 5), r("statistic", 4))


@query("kupiec_lr", f"""WITH {LABELS}, {ALIGNED}, k AS (SELECT count(*) AS n, count(*) FILTER ("return" < {normal_ppf(0.05)!r} * forecast) AS x FROM al), p AS (SELECT *, least(greatest(x / n, 1e-12), 1 - 1e-12) AS p FROM k)
SELECT n, x, round(greatest(-2 * (x * ln(0.05) + (n - x) * ln(0.95) - x * ln(p) - (n - x) * ln(1 - p)), 0), 6) AS statistic FROM p""")
def kupiec_lr(spark, d):
    return evaluation.kupiec(_pairs(spark, d), "forecast").select("n", "x", r("statistic", 6))


@query("max_drawdown", f"WITH {CANDLES}, {RETURNS} SELECT round(min(basket_price / nullif(m, 0) - 1), 7) AS max_drawdown FROM (SELECT basket_price, max(basket_price) OVER (ORDER BY open_time) AS m FROM b)")
def max_drawdown(spark, d):
    return evaluation.max_drawdown(_basket(spark, d), "basket_price").select(r("max_drawdown", 7))


@query("pacf")
def pacf(spark, d):
    return evaluation.pacf(_basket(spark, d), "basket_return", _LAGS).select("lag", r("pacf", 6))


@query("arch_lm")
def arch_lm(spark, d):
    return evaluation.arch_lm(_basket(spark, d), "basket_return", _LAGS).select("n", r("statistic", 4), r("p_value", 6))


@query("series_hash")
def series_hash(spark, d):
    return evaluation.content_hash(_basket(spark, d), "basket_return").select("hash")


def _garch(spark, d):
    """The frame on GARCH forecasts, with garch_vol, their history, and ewma_vol; the fits; and the returns. Labels rest on the history, as SQL can't."""
    frame, returns = _frame(spark, d)
    fitted = settled(lab.garch_fits(frame, ["interval"], "basket_return"))  # a row per fit
    smooth = features.ewma(frame, "basket_return", "_v", W.short, ["interval"]).select(*features.AT, F.sqrt("_v").alias("ewma_vol"))
    history = settled(lab.garch_history(frame, fitted, ["interval"], "basket_return"))
    on_garch = labels.forecast_series(frame.drop("forecast_vol"), history=history)
    joined = on_garch.join(smooth, list(features.AT), "left").join(history.withColumnRenamed("volatility", "garch_vol"), list(features.AT), "left")
    return settled(joined), fitted, returns


GARCH = {"garch": "garch_vol", "ewma": "ewma_vol", "naive": "market_vol"}


@query("garch_history")
def garch_history(spark, d):
    return _garch(spark, d)[0].select("open_time", r("garch_vol", 5), "fitted")


@query("walk_forward_garch")
def walk_forward_garch(spark, d):
    out = evaluation.metrics(evaluation.aligned(_garch(spark, d)[0], GARCH))
    return out.select("model", r("rmse", 5), r("mae", 5), r("qlike", 4), "n", "best")


@query("diagnostic_tests")
def diagnostic_tests(spark, d):
    frame, fitted, returns = _garch(spark, d)
    last = fitted.where("volatility IS NOT NULL").orderBy(F.desc("refit")).select("alpha", "beta", "nu").first()  # the parameters of one fit
    params = {} if last is None else {"alpha[1]": last["alpha"], "beta[1]": last["beta"], "nu": last["nu"]}
    labelled = labels.regimes(labels.shocks(frame.drop("garch_vol", "fitted"), returns)).select("interval", "regime", "shock_type")
    return evaluation.diagnostics(frame.select(*features.AT, "basket_return", *GARCH.values()), params, labelled=labelled)


@query("kline_json_parse", f"WITH {CANDLES} SELECT {_ALL} FROM c")
def kline_json_parse(spark, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    k = F.struct(F.col("symbol").alias("s"), F.col("interval").alias("i"), ms("open_time").alias("t"), ms("close_time").alias("T"), *(F.col(c).cast("string").alias(n) for c, n in zip(C.PRICES, "ohlcv")), F.col("is_closed").alias("x"))
    wrapped = F.when(F.hour("open_time") % 2 == 0, F.to_json(F.struct(F.struct(k.alias("k")).alias("data")))).otherwise(F.to_json(F.struct(k.alias("k"))))
    return C.from_stream_json(hourly(spark, d).select(wrapped.alias("value"))).withColumn("symbol", F.lower("symbol"))


@query("kline_rest_parse", f"WITH {CANDLES} SELECT {_ALL} FROM c")
def kline_rest_parse(spark, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("string")
    row = F.to_json(F.array(ms("open_time"), *(F.col(c).cast("string") for c in C.PRICES), ms("close_time")))
    return C.from_rest_rows(hourly(spark, d).select("symbol", "interval", row.alias("value")), F.col("symbol"), F.col("interval")).withColumn("symbol", F.lower("symbol"))


@query("latest_closed_open", f"WITH {CANDLES} SELECT symbol, max(date_trunc('hour', close_time) - INTERVAL 1 HOUR) AS latest_closed FROM c GROUP BY symbol")
def latest_closed_open(spark, d):
    at = I.floor_time(F.col("close_time"), 3600) - F.expr("interval 1 hour")
    return hourly(spark, d).groupBy("symbol").agg(F.max(at).alias("latest_closed"))
