"""Read-models of an analysis: bounded tables and series for display, and views of a range of time."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import rolling as R
from tidegauge.functions.intervals import parse_time_range
from tidegauge.operators import evaluation, quality
from tidegauge.sources.candles import latest_range

# How many rows the tables and series of a snapshot hold at most.
SERIES, CANDLES, BOARD, TIMELINE, LOGS, HEAT = 160, 80, 200, 400, 100, 80


def newest(df: DataFrame, n: int, by: tuple[str, ...] = (), time: str = "open_time") -> DataFrame:
    """The last n rows, of each group if `by` is given; rows of one time are ordered by their other columns."""
    rest = [c for c, kind in df.dtypes if c != time and "map<" not in kind and "variant" not in kind]
    order = [F.desc(time), *(F.asc(c) for c in rest)]
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def series_tails(frame: DataFrame, names: list[str], n: int = SERIES, by: tuple[str, ...] = ("interval",)) -> DataFrame:
    """by, name, time, value: the last n values of each column, NULL and NaN aside. Columns that the frame lacks give no rows."""
    there = [c for c in names if c in frame.columns]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in there)))
    long = frame.select(*by, F.col("open_time").alias("time"), each.alias("x")).select(*by, "x.name", "time", "x.value")
    return newest(long.where("value is not null and not isnan(value)"), n, (*by, "name"), "time")


def derived(frame: DataFrame) -> DataFrame:
    """Adds the log price of the basket and the return over the forecast made a bar before."""
    w = R.ordered("interval")
    price = F.when(F.col("basket_price") > 0, F.ln("basket_price"))
    return frame.withColumn("log_price", price).withColumn("standardized_residual", R.ratio(F.col("basket_return"), F.lag("forecast_vol").over(w)))


def label_codes(df: DataFrame, label: str, n: int = SERIES, by: tuple[str, ...] = ("interval",)) -> DataFrame:
    """by, time, label, value: the last n labels of each group, numbered from 1 in their order among those."""
    last = newest(df.where(F.col(label).isNotNull()), n, by)
    code = F.dense_rank().over(Window.partitionBy(*by).orderBy(label))
    return last.select(*by, F.col("open_time").alias("time"), F.col(label).alias("label"), code.alias("value"))


def board_view(board: DataFrame, top_n: int | None = None, **equal: str | None) -> DataFrame:
    """The rows of a leaderboard whose columns have the values given (family, target, symbol; None or empty: any), down to a rank."""
    for name, value in equal.items():
        if value:
            board = board.where(F.col(name) == value)
    return board.where(F.col("rank") <= top_n) if top_n and top_n > 0 else board


def quality_status(issues: DataFrame) -> DataFrame:
    """One row: status (issues if there are errors, else warnings or ok), is_valid, issue_count."""
    errors = F.count_if(F.col("severity") == "error")
    status = F.when(errors > 0, "issues").when(F.count("*") > 0, "warnings").otherwise("ok")
    return issues.agg(status.alias("status"), (errors == 0).alias("is_valid"), F.count("*").alias("issue_count"))


def method_steps(frame: DataFrame, forecast: str = "EWMA of squared returns, for the next bar") -> DataFrame:
    """interval, step, stage, rule, open_time, value, label, detail: what the last bar's results rest on.

    frame: basket_return, market_vol, avg_pairwise_corr, pca1_share, forecast_vol, shock_score, regime. value is a stage's main number,
    label its label, detail its other numbers as JSON; forecast tells what forecast_vol is. No stage sees anything later than open_time.
    """
    none = F.lit(None).cast("string")

    def step(i: int, stage: str, rule: str, value: Column | None = None, label: Column = none, detail: Column = none) -> Column:
        number = F.lit(None).cast("double") if value is None else value.cast("double")
        return F.struct(F.lit(i).alias("step"), F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), number.alias("value"), label.alias("label"), detail.alias("detail"))

    steps = F.array(
        step(1, "returns", "log of a close over the close before", F.col("basket_return")),
        step(2, "features", "windows that end with this bar", F.col("market_vol"), none, F.to_json(F.struct("avg_pairwise_corr", "pca1_share"))),
        step(3, "forecast", forecast, F.col("forecast_vol")),
        step(4, "shock", "size of the return over the forecast of the bar before", F.col("shock_score")),
        step(5, "regime", "limits are quantiles of all bars up to this one", None, F.col("regime")),
        step(6, "validation", "squared return against the forecast of the bar before", None, F.lit("updated")),
    )
    return newest(frame, 1, ("interval",)).select("interval", "open_time", F.inline(steps))


@dataclass(frozen=True)
class RangeView:
    """A range's rows, its walk-forward pairs, losses and metrics."""

    rows: DataFrame
    pairs: DataFrame
    losses: DataFrame
    metrics: DataFrame


def on_range(frame: DataFrame, text: str, forecasts: dict[str, str] | None = None) -> RangeView:
    """The walk-forward results of the last bars alone: a forecast from before the range isn't used in it."""
    rows = latest_range(frame, parse_time_range(text).hours)
    pairs = evaluation.aligned(rows, forecasts)
    models = tuple(forecasts or {m: m for m in evaluation.MODELS})
    return RangeView(rows, pairs, evaluation.losses(pairs, models), evaluation.metrics(pairs, models))


def range_status(frame: DataFrame, ranges: dict[str, str]) -> DataFrame:
    """view, range, start, end, expected_points, actual_points: a row for each named range, all in one pass over the frame."""
    parsed = {view: parse_time_range(t) for view, t in ranges.items()}
    top = frame.agg(F.max("open_time").alias("_top"))
    seen = frame.select("open_time").join(F.broadcast(top))  # one row is broadcast
    inside = {v: F.lit(True) if p.hours is None else F.col("open_time") >= F.col("_top") - F.expr(f"interval {p.hours - 1} hours") for v, p in parsed.items()}
    aggs = [a for i, v in enumerate(parsed) for a in (F.min(F.when(inside[v], F.col("open_time"))).alias(f"s{i}"), F.count_if(inside[v]).alias(f"n{i}"))]
    one = seen.agg(F.max("open_time").alias("end"), *aggs)
    rows = F.array(*(
        F.struct(F.lit(v).alias("view"), F.lit(p.name).alias("range"), F.col(f"s{i}").alias("start"), F.col("end"), F.lit(p.expected_points).cast("int").alias("expected_points"), F.col(f"n{i}").alias("actual_points"))
        for i, (v, p) in enumerate(parsed.items())
    ))
    return one.select(F.inline(rows))


def _plain(x: Column, t: T.DataType) -> Column:
    """NaN and infinite numbers as NULL, at any depth; JSON has none."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return R.finite(x)
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: _plain(e, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(x, lambda _, v: _plain(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_plain(x[f.name], f.dataType).alias(f.name) for f in t.fields)))
    return x


def json_rows(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with NULL for numbers that aren't finite, NULL fields kept, times in ISO form (UTC if without zone)."""
    fields = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    times = "yyyy-MM-dd'T'HH:mm:ss"
    options = {"ignoreNullFields": "false", "timestampFormat": f"{times}XXX", "timestampNTZFormat": f"{times}'+00:00'"}
    return df.select(F.to_json(F.struct(*fields), options).alias("value"))


@dataclass(frozen=True)
class Snapshot:
    """Tables by name, each of a bounded number of rows."""

    tables: dict[str, DataFrame]

    def as_json(self) -> str:
        """All tables as one JSON object of lists of rows; what is collected is as bounded as the tables."""
        return json.dumps({name: [json.loads(r["value"]) for r in json_rows(df).collect()] for name, df in self.tables.items()}, ensure_ascii=False)


#: Series of a snapshot, besides the loss series of each model.
SHOWN = (
    "basket_return", "market_vol", "ewma_vol", "range_vol", "vol_percentile", "vol_z_score", "vol_of_vol", "avg_pairwise_corr", "avg_btc_beta",
    "pca1_share", "dispersion", "trend_slope", "trend_tstat", "trend_strength", "trend_autocorr", "up_down_ratio", "log_price", "forecast_vol",
    "standardized_residual", "shock_score", "shock_breadth", "rv_jump_ratio",
)


def snapshot(candles: DataFrame, frame: DataFrame, interval: str, losses: DataFrame | None = None, board: DataFrame | None = None, lines: DataFrame | None = None, tests: DataFrame | None = None, logs: DataFrame | None = None) -> Snapshot:
    """What a display needs. candles: closed bars; frame: a row per bar with features, basket_price, forecast_vol and, where they are known, shocks and regime.

    Tables of what isn't given are left out. The number of symbols and candidates bounds market_rows, data_accumulation and the heat map.
    """
    shown = derived(frame)
    issues = quality.validate(candles, interval)
    tables = {
        "latest": newest(frame, 1), "series": series_tails(shown, list(SHOWN)), "market_rows": newest(candles, 1, ("symbol",)),
        "recent_candles": newest(candles, CANDLES), "data_accumulation": quality.accumulation(candles, interval), "data_quality": quality_status(issues),
        "issues_by_check": quality.issue_counts(issues, "check"), "issues_by_symbol": quality.issue_counts(issues, "symbol"),
    }
    if "regime" in frame.columns:
        tables["regime_state"] = label_codes(frame, "regime")
    if losses is not None:
        tables["validation_losses"] = newest(losses, SERIES)
    if board is not None:
        tables["leaderboard"] = board_view(board, BOARD)
    if lines is not None:
        tables["timelines"] = newest(lines, TIMELINE, time="origin_time")
        last = lines.select("realization_time").distinct().orderBy(F.desc("realization_time")).limit(HEAT)
        tables["rank_heatmap"] = lines.join(F.broadcast(last), "realization_time").groupBy("candidate", "realization_time").agg(F.min("rank").alias("rank"))  # HEAT rows are broadcast
    if tests is not None:
        tables["diagnostics"] = tests
    if logs is not None:
        tables["logs"] = newest(logs, LOGS, time="at")
    return Snapshot(tables)
