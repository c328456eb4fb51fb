"""Live candles with Structured Streaming: routing, storage, late corrections, resampling and running state."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions.intervals import interval_seconds
from tidegauge.sources import store
from tidegauge.sources.candles import from_stream_json


def messages(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Candles from a folder of files with one stream message per line."""
    return from_stream_json(spark.readStream.schema("value string").option("maxFilesPerTrigger", per_batch).text(path))


def latest_forming(batch: DataFrame) -> DataFrame:
    """Per symbol the newest open candle; for display only."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"), F.desc("close_time"))
    return batch.where(~F.col("is_closed")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def store_closed(
    candles: DataFrame, root: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Upserts closed candles, however late or often they come; then calls after(stored candles, batch id), once a batch.

    Sequence numbers go on from the greatest stored one, so corrections win with a new checkpoint too. A batch that is run again after a
    failure writes the same rows once more.
    """
    base = store.next_seq(candles.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            if not batch.where("is_closed").isEmpty():
                store.upsert(spark, root, batch, base + batch_id)
                if after is not None:
                    after(store.read_candles(spark, root), batch_id)
        finally:
            batch.unpersist()

    return candles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def wanted(stored: DataFrame, symbols: list[str], interval: str, start: datetime, end: datetime) -> dict[datetime, list[str]]:
    """Symbols by the time their history is to be fetched from: the bar after the last stored one, not before start. Those that reach end are left out."""
    names = [s.upper() for s in symbols]
    step = F.expr(f"interval {interval_seconds(interval)} seconds")
    known = stored.where((F.col("interval") == interval) & F.col("symbol").isin(names)).groupBy("symbol").agg((F.max("open_time") + step).alias("next"))
    after = {r["symbol"]: r["next"] for r in known.collect()}  # a row per symbol asked for
    out: dict[datetime, list[str]] = {}
    for s in names:
        at = max(after.get(s, start), start)
        if at <= end:
            out.setdefault(at, []).append(s)
    return out


def backfill(spark: SparkSession, root: str, symbols: list[str], interval: str, start: datetime, end: datetime, fetch: Callable[[list[str], datetime, datetime], DataFrame]) -> str:
    """Stores the bars up to end that the store lacks, then tells the mode to go live with: LIVE, or DEGRADED if fetching failed or nothing is stored.

    fetch(symbols, start, end) returns candles; times are without zone, in UTC. A stream started afterwards takes over: bars that come twice are one.
    """
    mode = "LIVE"
    try:
        for at, names in wanted(store.read_candles(spark, root), symbols, interval, start, end).items():
            store.upsert(spark, root, fetch(names, at, end), store.next_seq(spark, root))
    except Exception as e:  # the network may be away; what is stored can still be used
        logging.getLogger(__name__).warning("history wasn't fetched: %s", e)
        mode = "DEGRADED"
    if store.read_candles(spark, root, symbols, interval).isEmpty():
        mode = "DEGRADED"
    return mode


def tail(candles: DataFrame, interval: str, bars: int) -> DataFrame:
    """The last bars of the stored candles: what an incremental recompute needs, the longest window and its warm-up."""
    newest = candles.agg(F.max("open_time").alias("_newest"))
    since = F.col("_newest") - F.expr(f"interval {interval_seconds(interval) * bars} seconds")
    return candles.join(F.broadcast(newest), F.col("open_time") > since).drop("_newest")  # one row is broadcast


def resample_stream(ticks: DataFrame, interval: str, lateness: str = "1 hour", time: str = "ts", symbol: str = "symbol", price: str = "price", order: str = "id") -> DataFrame:
    """Candles from a stream of ticks; a bar is emitted when no tick within the lateness can change it."""
    seconds = interval_seconds(interval)
    at = F.struct(time, order)
    bar = F.window(time, f"{seconds} seconds")
    out = ticks.withWatermark(time, lateness).groupBy(bar, F.col(symbol).alias("symbol")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out.select("symbol", F.lit(interval).alias("interval"), F.col("window.start").alias("open_time"), (F.col("window.end") - F.expr("interval 1 millisecond")).alias("close_time"), "open", "high", "low", "close", "volume", F.lit(True).alias("is_closed"))


def over_windows(ticks: DataFrame, lateness: str, width: str | None = None, slide: str | None = None, gap: str | None = None, time: str = "ts", symbol: str = "symbol", price: str = "price", order: str = "id") -> DataFrame:
    """symbol, start, end, open, high, low, close and ticks of tumbling (width), sliding (width, slide) or session (gap) windows, of a stream or a batch.

    A stream gives a window when no tick within the lateness can change it; what comes later is dropped and counted (Status.late).
    """
    if (gap is None) == (width is None):
        raise ValueError("give width, for tumbling or sliding windows, or gap, for sessions")
    window = F.session_window(time, gap) if gap else F.window(time, width, slide or width)
    at = F.struct(time, order)
    out = ticks.withWatermark(time, lateness).groupBy(window.alias("w"), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("ticks")
    )
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "ticks")


def distinct_within(candles: DataFrame, lateness: str) -> DataFrame:
    """The first of each candle within the lateness; the time column must be a timestamp with zone."""
    return candles.withWatermark("open_time", lateness).dropDuplicatesWithinWatermark(["symbol", "interval", "open_time"])


class _Volatility(StatefulProcessor):
    """Running EWMA volatility of one symbol, whose last bars may still be corrected.

    State: base, what the bars before the horizon have come to, and recent, the bars since, which later rows may add to or replace. The
    horizon is `lateness` seconds before the symbol's newest bar.
    """

    def __init__(self, span: int, lateness: int, silence: int, refit_every: int):
        self.alpha, self.lateness, self.silence, self.refit_every = 2 / (span + 1), timedelta(seconds=lateness), silence, refit_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "v double, n long, at timestamp")
        self.recent = handle.getListState("recent", "at timestamp, r double")
        self.timer = handle.getValueState("timer", "due long")

    def _next(self, v: float | None, n: int, r: float | None) -> tuple[float | None, int]:
        if r is None or pd.isna(r):
            return v, n
        return (r * r if v is None else self.alpha * r * r + (1 - self.alpha) * v), n + 1

    def _wake(self, timers) -> None:
        if self.silence:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            due = timers.getCurrentProcessingTimeInMs() + 1000 * self.silence
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        v, n, horizon = self.base.get() if self.base.exists() else (None, 0, None)
        bars = {pd.Timestamp(at): r for at, r in self.recent.get()} if self.recent.exists() else {}
        known, came, out = set(bars), set(), []
        for f in rows:
            for at, r in f[["open_time", "log_return"]].itertuples(index=False):
                at = pd.Timestamp(at)
                if horizon is not None and at <= pd.Timestamp(horizon):
                    out.append((key[0], at, None, None, False, "late"))
                elif at not in bars or bars[at] != r:
                    bars[at] = None if pd.isna(r) else float(r)
                    came.add(at)
        first, order = min(came, default=None), sorted(bars)
        limit = order[-1] - self.lateness if order else None
        w, m = v, n
        for at in order:
            w, m = self._next(w, m, bars[at])
            if first is not None and at >= first and w is not None and bars[at] is not None:
                out.append((key[0], at, w**0.5, m, bool(self.refit_every) and m % self.refit_every == 0, "revised" if at in known else "new"))
        for at in order:
            if at <= limit:
                v, n = self._next(v, n, bars.pop(at))
                horizon = at
        if horizon is not None:
            self.base.update((v, n, pd.Timestamp(horizon).to_pydatetime()))
        if bars:
            self.recent.put([(at.to_pydatetime(), bars[at]) for at in sorted(bars)])
        else:
            self.recent.clear()
        self._wake(timerValues)
        yield _volatility_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.base, self.recent, self.timer):
            state.clear()
        yield _volatility_frame([(key[0], None, None, None, False, "silent")])

    def close(self) -> None:
        pass


VOLATILITY = "symbol string, open_time timestamp, volatility double, bars long, refit_due boolean, kind string"


def _volatility_frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["symbol", "open_time", "volatility", "bars", "refit_due", "kind"])
    return f.astype({"open_time": "datetime64[ns]", "volatility": "float64", "bars": "Int64"})


#: The state store that keyed state with timers needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def running_ewma(returns: DataFrame, span: int, refit_every: int = 0, lateness: int = 0, silence: int = 0) -> DataFrame:
    """symbol, open_time, volatility, bars so far, refit_due and kind for closed bars, from state that lasts across batches and restarts.

    returns: a stream of symbol, open_time and log_return. A bar that comes late or again within `lateness` seconds of its symbol's newest one is put
    in its place: it and the bars after it are emitted anew, kind "new" or "revised". Older ones are "late" and change nothing. A symbol that is
    silent for `silence` seconds (0: never) is forgotten, which a row of kind "silent" tells; a query with such timers runs until it is stopped. The session needs the setting ROCKS.
    """
    return returns.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Volatility(span, lateness, silence, refit_every), outputStructType=VOLATILITY, outputMode="Append", timeMode="ProcessingTime" if silence else "None"
    )


class Status(StreamingQueryListener):
    """The mode of each query: LIVE while it makes progress (DEGRADED if its history is), PAUSED when stopped, ERROR after a failure."""

    def __init__(self, mode: str = "LIVE") -> None:
        self.running = mode
        self.mode: dict[str, str] = {}
        self.rows: dict[str, int] = {}
        self.late: dict[str, int] = {}  # rows that came after their windows had been given out

    def onQueryStarted(self, event) -> None:
        self.mode[str(event.id)] = "BOOTSTRAP"

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.mode[key] = self.running
        self.rows[key] = self.rows.get(key, 0) + (event.progress.numInputRows or 0)
        self.late[key] = self.late.get(key, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.mode[str(event.id)] = "ERROR" if event.exception else "PAUSED"
