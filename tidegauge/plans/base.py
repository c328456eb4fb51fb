"""A registry of queries and their SQL twins, and what the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.features import Windows
from tidegauge.sources.candles import from_events, from_lineitem

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Windows of the sample queries, in bars of one hour.
W = Windows(short=24, medium=72, long=168, trend=24)
BENCHMARK = "click"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), "1h")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lineitem(table(spark, sf_dir, "lineitem"))


def r(x: Column | str, n: int = 8, name: str | None = None) -> Column:
    """Rounded, with zero unsigned, under the column's own name."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c, n) + 0.0).alias(name or x)


def rounded(df: DataFrame, keys: list[str], values: list[str], n: int = 8) -> DataFrame:
    return df.select(*keys, *(r(v, n) for v in values))


# Common table expressions of the SQL twins.
CANDLES = """
c AS (SELECT event_type AS symbol, '1h' AS interval, date_trunc('hour', ts) AS open_time,
             date_trunc('hour', ts) + INTERVAL 3599999 MILLISECOND AS close_time,
             arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
             arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, true AS is_closed
      FROM events GROUP BY event_type, date_trunc('hour', ts))"""
LINE = """
p AS (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS price FROM lineitem),
c AS (SELECT l_returnflag AS symbol, '1d' AS interval, l_shipdate AS open_time, l_shipdate + INTERVAL 86399999 MILLISECOND AS close_time,
             arg_min(price, (l_orderkey, l_linenumber, l_partkey, l_suppkey, price)) AS open, max(price) AS high, min(price) AS low,
             arg_max(price, (l_orderkey, l_linenumber, l_partkey, l_suppkey, price)) AS close,
             CAST(count(*) AS DOUBLE) AS volume, true AS is_closed
      FROM p GROUP BY l_returnflag, l_shipdate)"""
RETURNS = """
g AS (SELECT * FROM (SELECT DISTINCT open_time FROM c) CROSS JOIN (SELECT DISTINCT symbol FROM c)),
d AS (SELECT g.symbol, g.open_time, c.close, CASE WHEN c.close > 0 THEN ln(c.close) END AS lp FROM g LEFT JOIN c USING (symbol, open_time)),
rt AS (SELECT *, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY open_time) AS log_return FROM d),
b AS (SELECT open_time, avg(log_return) AS basket_return, avg(close) AS basket_price FROM rt GROUP BY open_time)"""


def win(n: int, *by: str, end: str = "CURRENT ROW") -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"OVER ({part}ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def sql_std(x: str, n: int, least: int, *by: str) -> str:
    return f"CASE WHEN count({x}) {win(n, *by)} >= {least} THEN stddev_samp({x}) {win(n, *by)} END"


MARKET = f"""
mv AS (SELECT *, {sql_std('basket_return', W.short, 6)} AS market_vol FROM b)"""
EWMA = f"""
sq AS (SELECT open_time, basket_return * basket_return AS x, row_number() OVER (ORDER BY open_time) AS k FROM b WHERE basket_return IS NOT NULL),
ew AS (SELECT a.open_time, a.k, {{list}} AS v FROM sq a)""".replace("{list}", "0")
EWMA = """
sq AS (SELECT open_time, basket_return * basket_return AS x, row_number() OVER (ORDER BY open_time) AS k FROM b WHERE basket_return IS NOT NULL),
ew AS (WITH RECURSIVE e(k, open_time, v) AS (
         SELECT k, open_time, x FROM sq WHERE k = 1
         UNION ALL SELECT sq.k, sq.open_time, 0.08 * sq.x + 0.92 * e.v FROM e JOIN sq ON sq.k = e.k + 1)
       SELECT * FROM e)"""
