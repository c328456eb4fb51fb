"""The candle frame: its schema, and the ways it comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.intervals import INTERVALS
from tidegauge.functions.rolling import finite

CANDLE_SCHEMA = (
    "symbol string, interval string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, "
    "low double, close double, volume double, is_closed boolean"
)
PRICES = ("open", "high", "low", "close", "volume")
KEY = ("symbol", "interval", "open_time")


def normalise(df: DataFrame) -> DataFrame:
    """Upper-case symbols, timestamps without zone, numbers as finite doubles or NULL; rows in (symbol, time) order."""
    num = lambda c: finite(F.col(c).try_cast("double")).alias(c)
    return df.select(
        F.upper("symbol").alias("symbol"), F.col("interval").cast("string").alias("interval"),
        F.col("open_time").cast("timestamp_ntz").alias("open_time"), F.col("close_time").cast("timestamp_ntz").alias("close_time"),
        *map(num, PRICES), F.col("is_closed").cast("boolean").alias("is_closed"),
    ).orderBy("symbol", "open_time")


def closed_only(df: DataFrame) -> DataFrame:
    return df.where("is_closed")


def reject_unclosed(df: DataFrame) -> DataFrame:
    """The rows, or an error when they are read if one isn't closed."""
    checked = F.when(F.col("is_closed"), True).otherwise(F.raise_error(F.lit("an unclosed candle can't enter research data")))
    return df.where(checked)


def of_interval(df: DataFrame, interval: str) -> DataFrame:
    return df.where(F.col("interval") == interval)


def closed_range(df: DataFrame, interval: str, start, end, symbols: list[str]) -> DataFrame:
    return df.where(
        F.col("is_closed") & (F.col("interval") == interval) & F.col("open_time").between(start, end) & F.col("symbol").isin([s.upper() for s in symbols])
    )


def latest_range(df: DataFrame, hours: int | None, time: str = "open_time") -> DataFrame:
    """The rows of the last `hours` bars of one hour, counted back from the latest row."""
    if hours is None:
        return df
    top = df.agg((F.max(time) - F.expr(f"interval {hours - 1} hours")).alias("_from"))
    return df.join(F.broadcast(top), F.col(time) >= F.col("_from")).drop("_from")  # one row is broadcast


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([c for c in names if c in df.columns])


def millis(x: Column) -> Column:
    """Milliseconds since the epoch as a timestamp without zone."""
    return (F.timestamp_millis(x.cast("long"))).cast("timestamp_ntz")


def _number(x: Column) -> Column:
    return finite(x.try_cast("double"))


def from_stream_json(df: DataFrame, payload: str = "value") -> DataFrame:
    """Candles from stream messages, with or without the data envelope."""
    parsed = F.from_json(F.col(payload).cast("string"), "data struct<k:map<string,string>>, k map<string,string>")  # t and T differ
    bar = df.select(F.coalesce(parsed["data"]["k"], parsed["k"]).alias("k")).where("k is not null")
    f = lambda n: F.try_element_at("k", F.lit(n))
    return bar.select(
        F.upper(f("s")).alias("symbol"), f("i").alias("interval"), millis(f("t")).alias("open_time"), millis(f("T")).alias("close_time"),
        *(_number(f(n)).alias(c) for n, c in zip("ohlcv", PRICES)), f("x").cast("boolean").alias("is_closed"),
    )


def from_rest_rows(df: DataFrame, symbol: Column, interval: Column, row: str = "value") -> DataFrame:
    """Closed candles from JSON arrays [open ms, o, h, l, c, v, close ms, ...]."""
    a = F.from_json(F.col(row), "array<string>")
    cell = lambda i: F.get(F.col("_a"), F.lit(i))
    return df.select(a.alias("_a"), symbol.alias("_s"), interval.alias("_i")).select(
        F.upper("_s").alias("symbol"), F.col("_i").alias("interval"), millis(cell(0)).alias("open_time"), millis(cell(6)).alias("close_time"),
        *(_number(cell(i)).alias(c) for i, c in enumerate(PRICES, 1)), F.lit(True).alias("is_closed"),
    )


def resample(ticks: DataFrame, symbol: str, time: str, price: str, seconds: int, order: Column, name: str) -> DataFrame:
    """Candles from ticks: first and last price by `order`, extremes, and the number of ticks as volume."""
    bar = F.window(time, f"{seconds} seconds")
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), bar["start"].alias("open_time"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"),
        )
        .select(
            "symbol", F.lit(name).alias("interval"), "open_time", (F.col("open_time") + F.expr(f"interval {seconds * 1000 - 1} milliseconds")).alias("close_time"),
            *PRICES, F.lit(True).alias("is_closed"),
        )
    )


def from_events(events: DataFrame, interval: str = "1h") -> DataFrame:
    """Candles of the events table: a symbol per event type, prices from value."""
    return resample(events, "event_type", "ts", "value", INTERVALS[interval], F.struct("ts", "event_id"), interval)


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily candles of the lineitem table: a symbol per return flag, unit prices by ship date."""
    priced = lineitem.withColumn("price", F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    return resample(priced, "l_returnflag", "l_shipdate", "price", INTERVALS["1d"], order, "1d")
