"""Checks of candle frames: issues, accumulation and simulation data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.intervals import ceil_time, floor_time, interval_seconds
from tidegauge.functions.scalars import bad_ohlc, log_price
from tidegauge.sources.candles import KEY, closed_only, normalise

ISSUE = ("severity", "check", "message", "symbol", "count")


def broken() -> Column:
    """Whether a candle's prices contradict each other."""
    return bad_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"))


def _by_symbol():
    return Window.partitionBy("symbol").orderBy("open_time")


def gaps(df: DataFrame, seconds: int) -> DataFrame:
    """Rows that come more than a bar after the symbol's row before."""
    before = F.lag("open_time").over(_by_symbol())
    return df.withColumn("previous_open_time", before).where(F.col("open_time") - F.col("previous_open_time") > F.expr(f"interval {seconds} seconds"))


def duplicates(df: DataFrame) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where("_n > 1").drop("_n")


def missing_bars(df: DataFrame, start: Column, end: Column, seconds: int) -> DataFrame:
    """(symbol, open_time) of the bars between start and end that a symbol lacks."""
    grid = df.select("symbol").distinct().withColumn("open_time", F.explode(F.sequence(start, end, F.expr(f"interval {seconds} seconds"))))
    return grid.join(df.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")


def return_outliers(df: DataFrame, z: float = 8.0) -> DataFrame:
    """Rows whose log return is more than z standard deviations from the symbol's mean."""
    r = log_price(F.col("close")) - F.lag(log_price(F.col("close"))).over(_by_symbol())
    everything = Window.partitionBy("symbol")
    scored = df.withColumn("r", r).withColumn("m", F.avg("r").over(everything)).withColumn("s", F.stddev_samp("r").over(everything))
    return scored.where((F.col("s") > 0) & (F.abs(F.col("r") - F.col("m")) / F.nullif("s", F.lit(0.0)) > z)).drop("m", "s")


def validate(candles: DataFrame, interval: str, symbols: list[str] | None = None, z: float = 8.0) -> DataFrame:
    """Issue rows (severity, check, message, symbol, count); none if the candles are fine."""
    data = normalise(candles)
    spark = candles.sparkSession
    closed = closed_only(data)

    def issue(df: DataFrame, severity: str, check: str, message: str, by_symbol: bool = False) -> DataFrame:
        counted = (df.groupBy("symbol") if by_symbol else df.groupBy()).agg(F.count("*").alias("count")).where("count > 0")
        symbol = F.col("symbol") if by_symbol else F.lit(None).cast("string")
        return counted.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.lit(message).alias("message"), symbol.alias("symbol"), "count")

    any_row = data.agg(F.count("*").alias("n")).where("n = 0")
    out = any_row.select(F.lit("error").alias("severity"), F.lit("empty").alias("check"), F.lit("there are no candles").alias("message"), F.lit(None).cast("string").alias("symbol"), F.lit(0).cast("long").alias("count"))
    parts = [
        issue(data.where(F.col("interval") != interval), "error", "interval", f"rows of another interval than {interval}"),
        issue(data.where(~F.col("is_closed")), "error", "unclosed", "bars that are still open"),
        issue(duplicates(closed), "error", "duplicates", "several rows for one bar"),
        issue(closed.where(broken()), "error", "ohlc", "prices that contradict each other"),
        issue(closed.where("volume < 0"), "error", "volume", "volume below zero"),
        issue(gaps(closed, interval_seconds(interval)), "warning", "missing", "bars left out", True),
        issue(return_outliers(closed, z), "warning", "outlier", "returns far from the mean", True),
    ]
    if symbols:
        wanted = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string")
        absent = wanted.join(closed.select("symbol").distinct(), "symbol", "left_anti").crossJoin(data.agg(F.count("*").alias("_n")).where("_n > 0").drop("_n"))
        parts.append(issue(absent, "error", "coverage", "a symbol without bars", True))
    for p in parts:
        out = out.unionByName(p)
    return out


def issue_counts(issues: DataFrame, by: str) -> DataFrame:
    """Counts by check or by symbol; an issue counts at least once, one without symbol is for ALL."""
    key = F.coalesce(F.col(by), F.lit("ALL"))
    return issues.groupBy(key.alias(by)).agg(F.sum(F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))).cast("long").alias("count"))


def accumulation(candles: DataFrame, interval: str) -> DataFrame:
    """One row per symbol: what is there, and what seems to be missing."""
    seconds = interval_seconds(interval)
    step = F.expr(f"interval {seconds} seconds")
    rows = candles.withColumn("_gap", (F.col("open_time") - F.lag("open_time").over(_by_symbol()) > step).cast("int")).withColumn(
        "_dup", (F.count("*").over(Window.partitionBy(*KEY)) > 1).cast("int")
    )
    epoch = lambda c: F.unix_micros(c.cast("timestamp"))
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("open_time").alias("first_open_time"), F.max("open_time").alias("latest_open_time"),
        F.count_if("is_closed").alias("closed_rows"), F.count_if(~F.col("is_closed")).alias("unclosed_rows"),
        F.coalesce(F.sum("_gap"), F.lit(0)).cast("long").alias("missing_gap_count"), F.sum("_dup").cast("long").alias("duplicate_rows"),
        F.count_if(broken()).alias("ohlc_issue_rows"), F.count_distinct("open_time").alias("_times"),
    )
    span = F.floor((epoch(F.col("latest_open_time")) - epoch(F.col("first_open_time"))) / (seconds * 1_000_000)) + 1
    expected = F.when(F.col("_times") >= 2, span.cast("long"))
    return out.withColumn("expected_rows", expected).withColumn("estimated_missing_candles", F.when(F.col("expected_rows").isNotNull(), F.greatest(F.col("expected_rows") - F.col("_times"), F.lit(0)))).drop("_times")


def coverage_hours(candles: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return candles.agg(((micros(F.max("open_time")) - micros(F.min("open_time"))) / 3_600_000_000).alias("coverage_hours"), F.count("*").alias("total_rows"))


def simulation_quality(candles: DataFrame, interval: str, start: str, end: str, t_bars: int, horizon: int, dt_bars: int, symbols: list[str]) -> DataFrame:
    """One row per symbol: rows, expected grid, missing rate, coverage, gaps and origins within [start, end]."""
    seconds = interval_seconds(interval)
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    low, high = ceil_time(F.col("_start"), seconds), floor_time(F.col("_end"), seconds)
    data = closed_only(candles).where((F.col("interval") == interval) & F.col("open_time").between(lit(start), lit(end)))
    spark = candles.sparkSession
    wanted = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string").withColumn("_start", lit(start)).withColumn("_end", lit(end))
    bounds = wanted.withColumn("_low", low).withColumn("_high", high)
    step = F.expr(f"interval {seconds} seconds")
    grid = bounds.where("_low <= _high").select("symbol", F.explode(F.sequence("_low", "_high", step)).alias("open_time"))
    expected = grid.groupBy("symbol").agg(F.count("*").alias("expected_rows"))
    missing = grid.join(data.select("symbol", "open_time").distinct(), ["symbol", "open_time"], "left_anti").groupBy("symbol").agg(F.count("*").alias("missing_candle_count"))
    have = data.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("open_time").alias("first_open_time"), F.max("open_time").alias("latest_open_time"))
    gap = gaps(data, seconds).groupBy("symbol").agg(F.count("*").alias("gap_count"))
    out = wanted.select("symbol").join(have, "symbol", "left").join(expected, "symbol", "left").join(missing, "symbol", "left").join(gap, "symbol", "left")
    out = out.fillna(0, ["rows", "expected_rows", "missing_candle_count", "gap_count"])
    rate = F.coalesce(F.col("missing_candle_count") / F.nullif("expected_rows", F.lit(0)), F.lit(0.0))
    n = F.greatest(F.col("rows") - 1, F.lit(0))
    origins = F.when(n > t_bars + horizon, F.floor((n - horizon - 1 - (t_bars - 1)) / dt_bars) + 1).otherwise(0)
    return out.withColumn("missing_rate", rate).withColumn("coverage_pct", F.bround(100 * (1 - F.col("missing_rate")), 4)).withColumn("origin_count", origins.cast("long"))
