"""Long series in blocks of bars: no window, recursion or quantile needs a whole series in one task.

`numbered` gives every row its place in its series: rows are counted by stretches of time, which many tasks do, and the
counts, one per stretch, are summed up. From there on a series is cut into blocks of rows:

- `halo` repeats, before each block, the rows that its windows reach back to, so that window functions and sliding
  structures run per block;
- `recurrence` composes y -> a*y + b over each block, runs through the blocks' compositions, and applies what came before;
- `running_last` does the same for the last value so far;
- `sliding` keeps a sorted structure of the window for ranks and quantiles, in time that hardly grows with the window;
- `expanding_quantiles` reads, for each block, only the part of its past that can hold the quantile: values are cut into
  ranges, rows are counted by (block, range), and the ranges that the wanted ranks fall into are joined to the block;
- `lag_correlation` takes correlations from compensated running sums.

Times must be unique within a series. Groups of the recursions and quantiles are blocks; what runs per series are the
blocks' summaries, a row for BLOCK bars.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.functions.intervals import INTERVALS
from tidegauge.functions.rolling import TIME
from tidegauge.sources.scratch import settled

#: Rows of a block, and blocks and value ranges of a series for expanding quantiles.
BLOCK, PARTS = 4096, 64
#: Columns that the functions here add and take away again.
PLACE, PART, OWN = "_place", "_part", "_own"


def epoch_seconds(x: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.datediff(F.to_date(x), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)


def _stretch(time: str, size: int, seconds: Column | None, has_interval: bool) -> Column:
    """The stretch of time a row is in: `size` bars of its interval long, so it holds no more rows than that."""
    if seconds is None and not has_interval:
        seconds = F.lit(3600)
    elif seconds is None:
        seconds = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in INTERVALS.items() for x in kv)), F.col("interval")), F.lit(3600))
    return F.floor(epoch_seconds(F.col(time)) / (seconds * size)).cast("long")


def numbered(df: DataFrame, by: Sequence[str], size: int = BLOCK, time: str = TIME, seconds: Column | None = None, length: str | None = None) -> DataFrame:
    """Adds the place of each row in its series, from 0; with `length` also the number of the series' rows.

    The bars' length comes from the column interval, or from `seconds`; without either it is an hour. Places that are
    there already are kept.
    """
    if PLACE in df.columns and not length:
        return df
    cut = df.withColumn(PART, _stretch(time, size, seconds, "interval" in df.columns))
    w = Window.partitionBy(*by).orderBy(PART)
    counts = cut.groupBy(*by, PART).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = [F.sum("_n").over(Window.partitionBy(*by)).alias(length)] if length else []
    offsets = counts.select(*by, PART, before.alias("_before"), *total)
    own = F.row_number().over(Window.partitionBy(*by, PART).orderBy(time)) - 1
    placed = cut.withColumn(PLACE, own).join(offsets, [*by, PART])
    return placed.withColumn(PLACE, (F.col(PLACE) + F.col("_before")).cast("long")).select(*df.columns, PLACE, *([length] if length else []))


def halo(df: DataFrame, by: Sequence[str], reach: int, size: int = BLOCK, time: str = TIME, seconds: Column | None = None) -> DataFrame:
    """Rows by block (column PART), each block with the `reach` rows before it, for which OWN is false.

    Window functions partitioned by the series and PART and ordered by time see what they would see in the whole series,
    if they look no more than `reach` rows back; `owned` drops the repeated rows. Blocks are at least four times as long
    as the reach, so few rows are repeated.
    """
    size = max(size, 4 * reach)
    placed = numbered(df, by, size, time, seconds)
    block = F.floor(F.col(PLACE) / size).cast("long")
    blocks = F.sequence(block, F.floor((F.col(PLACE) + reach) / size).cast("long"))
    return placed.withColumn(PART, F.explode(blocks)).withColumn(OWN, F.col(PART) == block)


def owned(df: DataFrame, *more: str) -> DataFrame:
    return df.where(OWN).drop(PART, OWN, *more)


def windowed(df: DataFrame, by: Sequence[str], reach: int, make: Callable[[tuple[str, ...], DataFrame], DataFrame], size: int = BLOCK) -> DataFrame:
    """make(keys, rows), which adds window columns partitioned by the keys, run block by block."""
    return owned(make((*by, PART), halo(df, by, reach, size)), *([] if PLACE in df.columns else [PLACE]))


def _per_block(df: DataFrame, rows: DataFrame, by: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], outputs: Sequence[str]) -> DataFrame:
    """Columns of df and the outputs, doubles, that run(rows of one block in order) gives for the block's own rows."""
    schema = StructType(list(df.schema.fields))
    for name in outputs:
        schema.add(name, "double")
    names = schema.names
    found = rows.groupBy(*by, PART).applyInPandas(lambda f: run(f.sort_values(PLACE))[names], schema)
    return found.select(*df.columns, *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in outputs))


# --- recursions --------------------------------------------------------------------------------------------------


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the maps y -> a*y + b up to each one, by doubling."""
    a, b, k = a.copy(), b.copy(), 1
    while k < len(a):
        b[k:] = b[k:] + a[k:] * b[:-k]  # right sides are whole arrays of the step before
        a[k:] = a[k:] * a[:-k]
        k *= 2
    return a, b


def recurrence(df: DataFrame, by: Sequence[str], a: str, b: str, start: str, out: str, count: str | None = None, size: int = BLOCK, time: str = TIME, seconds: Column | None = None) -> DataFrame:
    """Adds out: y = a*y + b along each series, y = start at the first row that has b; rows without b leave y as it is.

    y is NULL before that row. With `count`, also the number of rows with b so far. The blocks' compositions are run
    through per series; the values themselves are computed block by block.
    """
    series, kept = list(by), df.columns
    cut = numbered(df, by, size, time, seconds).withColumn(PART, F.floor(F.col(PLACE) / size).cast("long"))
    rows = cut.withColumns({n: F.col(c).cast("double") for c, n in ((a, "_a"), (b, "_b"), (start, "_s"))})

    def maps(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = f["_b"].notna().to_numpy()
        return there, np.where(there, f["_a"].to_numpy(), 1.0), np.where(there, f["_b"].to_numpy(), 0.0)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(PLACE)
        there, x, y = maps(f)
        one = f[[*series, PART]].iloc[:1]
        p, q = compose(x, y)
        alone = math.nan
        if there.any():
            first = int(np.argmax(there))
            x[first], y[first] = 0.0, f["_s"].iloc[first]
            alone = compose(x[first:], y[first:])[1][-1]
        return one.assign(_p=p[-1], _q=q[-1], _alone=alone, _seen=int(there.sum()))

    keys = StructType([rows.schema[c] for c in [*series, PART]])
    wide = StructType([*keys.fields]).add("_p", "double").add("_q", "double").add("_alone", "double").add("_seen", "long")
    summaries = rows.select(*series, PART, PLACE, "_a", "_b", "_s").groupBy(*series, PART).applyInPandas(whole, wide)

    def through(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(PART)
        y, n, carried, seen = math.nan, 0, [], []
        for p, q, alone, k in f[["_p", "_q", "_alone", "_seen"]].itertuples(index=False):
            carried.append(y)
            seen.append(n)
            if k:
                y = alone if math.isnan(y) else p * y + q
            n += int(k)
        return f[[*series, PART]].assign(_y=carried, _k=seen)

    carried = summaries.groupBy(*series).applyInPandas(through, StructType([*keys.fields]).add("_y", "double").add("_k", "long"))

    def apply(key: tuple, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(PLACE)
        there, x, y = maps(f)
        y0, k0 = (c["_y"].iloc[0], int(c["_k"].iloc[0])) if len(c) else (math.nan, 0)
        if math.isnan(y0) and there.any():
            first = int(np.argmax(there))
            x[first], y[first] = 0.0, f["_s"].iloc[first]
            y0 = 0.0
            p, q = compose(x, y)
            value = p * y0 + q
            value[:first] = math.nan
        else:
            p, q = compose(x, y)
            value = p * y0 + q
        return f[kept].assign(_out=value, _count=k0 + np.cumsum(there))

    both = StructType(list(df.schema.fields)).add("_out", "double").add("_count", "long")
    found = rows.groupBy(*series, PART).cogroup(carried.groupBy(*series, PART)).applyInPandas(apply, both)
    more = [F.col("_count").alias(count)] if count else []
    return found.select(*df.columns, F.when(~F.isnan("_out"), F.col("_out")).alias(out), *more)


def ewma_variance(df: DataFrame, by: Sequence[str], value: str, span: int, out: str, count: str, size: int = BLOCK, time: str = TIME) -> DataFrame:
    """The recursion of the EWMA variance: alpha 2 / (span + 1), seeded with the first square; gaps are skipped."""
    alpha = 2 / (span + 1)
    x = F.col(value)
    with_maps = df.withColumns({"_m": F.lit(1 - alpha), "_f": alpha * x * x, "_x": x * x})
    return recurrence(with_maps, by, "_m", "_f", "_x", out, count, size, time).drop("_m", "_f", "_x")


def running_last(df: DataFrame, by: Sequence[str], values: dict[str, Column], size: int = BLOCK, time: str = TIME) -> DataFrame:
    """Adds, name: value, the last value so far that isn't NULL, the row's own included."""
    names = list(values)
    cut = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)}).withColumn(PART, _stretch(time, size, None, "interval" in df.columns))
    past = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*by, PART).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(*by, PART).agg(*(F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(time))).alias(f"_l{i}") for i in range(len(names))))
    ends = ends.select(*by, PART, *(F.last(f"_l{i}", ignorenulls=True).over(past).alias(f"_l{i}") for i in range(len(names))))
    own = cut.withColumns({f"_v{i}": F.last(f"_v{i}", ignorenulls=True).over(here) for i in range(len(names))})
    kept = [c for c in df.columns if c not in names]
    return own.join(ends, [*by, PART]).select(*kept, *(F.coalesce(f"_v{i}", f"_l{i}").alias(n) for i, n in enumerate(names)))


# --- order statistics --------------------------------------------------------------------------------------------


class SortedBuckets:
    """A sorted multiset in buckets of bounded length: inserting, removing, counting and selecting by rank."""

    def __init__(self, load: int = 512):
        self.load = load
        self.buckets: list[list[float]] = []
        self.most: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.buckets:
            self.buckets.append([x])
            self.most.append(x)
            return
        k = min(bisect_left(self.most, x), len(self.buckets) - 1)
        bucket = self.buckets[k]
        insort(bucket, x)
        self.most[k] = bucket[-1]
        if len(bucket) > 2 * self.load:
            self.buckets[k : k + 1] = [bucket[: self.load], bucket[self.load :]]
            self.most[k : k + 1] = [bucket[self.load - 1], bucket[-1]]

    def remove(self, x: float) -> None:
        k = bisect_left(self.most, x)
        bucket = self.buckets[k]
        del bucket[bisect_left(bucket, x)]
        self.size -= 1
        if bucket:
            self.most[k] = bucket[-1]
        else:
            del self.buckets[k], self.most[k]

    def at_most(self, x: float) -> int:
        k = bisect_right(self.most, x)
        return sum(map(len, self.buckets[:k])) + (bisect_right(self.buckets[k], x) if k < len(self.buckets) else 0)

    def select(self, rank: int) -> float:
        for bucket in self.buckets:
            if rank < len(bucket):
                return bucket[rank]
            rank -= len(bucket)
        raise IndexError(rank)

    def quantile(self, q: float) -> float:
        """Linear between neighbours."""
        at = q * (self.size - 1)
        low = int(at)
        x = self.select(low)
        return x if at == low else x + (self.select(low + 1) - x) * (at - low)


def sliding(df: DataFrame, by: Sequence[str], value: str, n: int, least: int, shares: str | None = None, quantiles: dict[str, float] | None = None, size: int = BLOCK) -> DataFrame:
    """Over the last n rows, from `least` values on: `shares`, the share of values that are at most the window's last one,
    and for each of `quantiles` (name: q) the linear quantile."""
    wanted, kept = quantiles or {}, df.columns
    names = [*([shares] if shares else []), *wanted]
    rows = halo(df, by, n - 1, size)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        xs, own = f[value].to_numpy(dtype=float), f[OWN].to_numpy(dtype=bool)
        held = SortedBuckets()
        last = math.nan
        found: list[tuple] = []
        for i, x in enumerate(xs.tolist()):
            if i >= n and not math.isnan(gone := xs[i - n]):
                held.remove(gone)
            if not math.isnan(x):
                held.add(x)
                last = x
            if own[i]:
                if held.size >= least:
                    row = [held.at_most(last) / held.size] if shares else []
                    found.append((*row, *(held.quantile(q) for q in wanted.values())))
                else:
                    found.append((math.nan,) * len(names))
        got = pd.DataFrame(found, columns=names, dtype=float)
        return f.loc[own, kept].reset_index(drop=True).join(got)

    return _per_block(df, rows, by, run, names)


def past_quantiles(past: np.ndarray, below: int, counted: int, xs: np.ndarray, q: float) -> np.ndarray:
    """The linear q-quantile of `counted` earlier values and the first, second, .. of xs, after each of them.

    Of the earlier values only a sorted part `past` is given, with `below` of them under it; the wanted ranks fall into it.
    The values are sorted once with all of xs; then xs are taken out again, last first, while a pointer walks along the
    chain of those that are left, a step or two at a time.
    """
    m = len(xs)
    values = np.concatenate([past, xs])
    order = np.argsort(values, kind="stable")
    spot = np.empty(len(values), np.int64)
    spot[order] = np.arange(len(values))
    ranked, mine = values[order].tolist(), spot[len(past) :].tolist()
    after, before = list(range(1, len(values) + 1)), list(range(-1, len(values) - 1))
    out = np.empty(m)
    total = counted + m
    rank = int(q * (total - 1))
    at = rank - below
    for j in range(m - 1, -1, -1):
        exact = q * (total - 1)
        goal = int(exact)
        while rank < goal:
            at, rank = after[at], rank + 1
        while rank > goal:
            at, rank = before[at], rank - 1
        x = ranked[at]
        out[j] = x if exact == goal else x + (ranked[after[at]] - x) * (exact - goal)
        gone = mine[j]
        if gone == at:  # the one after it takes its rank, or the pointer steps back
            if after[at] < len(ranked):
                at = after[at]
            else:
                at, rank = before[at], rank - 1
        elif gone < at:
            rank -= 1
        a, b = after[gone], before[gone]
        if b >= 0:
            after[b] = a
        if a < len(ranked):
            before[a] = b
        total -= 1
    return out


def expanding_quantiles(df: DataFrame, by: Sequence[str], limits: dict[str, tuple[str, float]], least: int, until: int = 0, parts: int = PARTS, size: int = BLOCK) -> DataFrame:
    """Adds linear quantiles, name: (column, q), of all values up to the row, or with until=-1 before it; exact.

    The rows are written first, as they are read several times. Unless all series are as short as one block, a series is cut into at most `parts` blocks of `size` rows or more, and each column's values at about `parts` cut
    points; a cut point is a range of its own, of which only the number counts, so repeated values don't fill a range.
    The ranks that a block can ask for fall into few ranges: only their values, from earlier blocks, go to its task.
    """
    series, columns = list(by), list(dict.fromkeys(c for c, _ in limits.values()))
    placed = settled(numbered(df, by, size, length="_rows"))
    if (placed.agg(F.max("_rows")).first()[0] or 0) <= size:
        return _in_one_block(placed, df.columns, series, limits, least, until)
    long = F.floor(F.col(PLACE) / F.greatest(F.lit(size), F.ceil(F.col("_rows") / parts))).cast("long")
    rows = placed.withColumn(PART, long).select(*series, PART, PLACE, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v"))
    rows = rows.select(*series, PART, PLACE, "v.column", "v.x").where("x IS NOT NULL")
    keys = [*series, "column"]
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", shares, 20 * parts)).alias("cuts"))
    under = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    ranged = rows.join(cuts, keys).select(*keys, PART, PLACE, "x", (2 * under + F.array_contains("cuts", F.col("x")).cast("int")).alias("range"))

    # how many values earlier blocks hold in each range, at every block
    counts = ranged.groupBy(*keys, PART, "range").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    blocks = counts.groupBy(*keys, PART).agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("past", F.coalesce(F.sum("m").over(w), F.lit(0)))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("limit"), F.lit(c).alias("column"), F.lit(q).alias("q")) for n, (c, q) in limits.items()))).alias("l")
    asked = blocks.select("*", wanted).where(F.col("l.column") == F.col("column")).select(*keys, PART, "m", "past", "l.limit", "l.q")
    first = F.greatest(F.floor(F.col("q") * F.col("past")) - F.col("m") - 1, F.lit(0))
    last = F.least(F.ceil(F.col("q") * (F.col("past") + F.col("m"))) + 1, F.col("past") - 1)
    asked = asked.select(*keys, PART, "m", "past", "limit", "q", first.alias("first"), last.alias("last"))
    # (block, range): at most parts * 2 * parts rows of a column
    earlier = asked.select(*keys, PART, "limit", "first", "last").alias("a").join(counts.withColumnsRenamed({PART: "_from"}).alias("c"), keys).where(F.col(PART) > F.col("_from"))
    held = earlier.groupBy(*keys, PART, "limit", "first", "last", "range").agg(F.sum("n").alias("n"), F.min("x").alias("x"))
    upto = F.sum("n").over(Window.partitionBy(*keys, PART, "limit").orderBy("range"))
    held = held.withColumn("upto", upto).where((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("n") <= F.col("last")))
    held = held.select(*keys, PART, "limit", "range", "n", "x", (F.col("upto") - F.col("n")).alias("below"))
    single = held.where("range % 2 = 1").select(*keys, PART, "limit", "x", "n", "below")
    some = held.where("range % 2 = 0").select(*keys, PART, "limit", "range", "below")
    many = some.join(ranged.select(*keys, F.col(PART).alias("_from"), "range", "x"), [*keys, "range"]).where(F.col("_from") < F.col(PART))
    many = many.select(*keys, PART, "limit", "x", F.lit(1).cast("long").alias("n"), "below")
    band = single.unionByName(many).join(asked.select(*keys, PART, "limit", "q", "past"), [*keys, PART, "limit"], "right")
    mine = ranged.select(*keys, PART, PLACE, "x").join(asked.select(*keys, PART, "limit"), [*keys, PART])

    def run(key: tuple, f: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(PLACE)
        given = past.dropna(subset=["x"])
        values = np.sort(np.repeat(given["x"].to_numpy(dtype=float), given["n"].to_numpy(dtype=np.int64)))
        below = int(given["below"].min()) if len(given) else 0
        q, counted = float(past["q"].iloc[0]), int(past["past"].iloc[0])
        seen = counted + 1 + np.arange(len(f))
        found = past_quantiles(values, below, counted, f["x"].to_numpy(dtype=float), q)
        return f[[*series, "limit", PLACE]].assign(_q=np.where(seen >= least, found, np.nan))

    schema = StructType([rows.schema[c] for c in series]).add("limit", "string").add(PLACE, "long").add("_q", "double")
    group = [*keys, PART, "limit"]
    found = mine.groupBy(*group).cogroup(band.groupBy(*group)).applyInPandas(run, schema)
    # a row without a value has the quantile of the row before
    wide = found.groupBy(*series, PLACE).agg(*(F.max(F.when(F.col("limit") == n, F.struct(F.col("_q"))))["_q"].alias(n) for n in limits))
    names = list(limits)
    there = placed.drop("_rows").join(wide, [*series, PLACE], "left")
    for n in names:
        there = there.withColumn(n, F.when(F.col(limits[n][0]).isNotNull(), F.struct(F.when(~F.isnan(n), F.col(n)).alias("q"))))
    if until:
        there = windowed_lag(there, series, names, -until)
    there = running_last(there, series, {n: F.col(n) for n in names}, size)
    return there.select(*df.columns, *(F.col(f"{n}.q").alias(n) for n in names))


def _in_one_block(placed: DataFrame, kept: Sequence[str], series: list[str], limits: dict[str, tuple[str, float]], least: int, until: int) -> DataFrame:
    """expanding_quantiles of series that are one block each."""
    kept = list(kept)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(PLACE)
        out = f[kept]
        for name, (c, q) in limits.items():
            x = f[c].to_numpy(dtype=float)
            there = ~np.isnan(x)
            found = np.full(len(x), np.nan)
            if there.any():
                some = past_quantiles(np.empty(0), 0, 0, x[there], q)
                some[: least - 1] = np.nan
                found = np.concatenate([[np.nan], some])[np.cumsum(there)]
            out = out.assign(**{name: pd.Series(found, f.index).shift(-until) if until else found})
        return out

    schema = StructType([placed.schema[c] for c in kept])
    for name in limits:
        schema.add(name, "double")
    found = placed.groupBy(*series).applyInPandas(run, schema)
    return found.select(*kept, *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in limits))


def windowed_lag(df: DataFrame, by: Sequence[str], names: Sequence[str], k: int) -> DataFrame:
    """The named columns as they were k rows before."""
    def make(keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(TIME)
        return rows.withColumns({n: F.lag(n, k).over(w) for n in names})

    return windowed(df, by, k, make)


# --- correlation with the value before ---------------------------------------------------------------------------


def running_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first 0, 1, .. values, and what rounding took from them."""
    s = np.concatenate([[0.0], np.cumsum(x)])
    step = s[1:] - s[:-1]
    lost = (s[:-1] - (s[1:] - step)) + (x - step)
    return s, np.concatenate([[0.0], np.cumsum(lost)])


def lagged(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """At each row the correlation of the window's values with the ones before them, missing values left out; 0 where a side is constant.

    Sums are of differences from a value of the series itself, which the correlation doesn't see.
    """
    there = ~np.isnan(x)
    v = x[there]
    upto = np.concatenate([[0], np.cumsum(there)])
    rows = np.arange(len(x))
    lo, hi = upto[np.maximum(rows - n + 1, 0)], upto[rows + 1]
    out = np.full(len(x), np.nan)
    enough = hi - lo >= max(least, 1)
    if not enough.any():
        return out
    v = v - np.median(v)
    one, two, cross = (running_sums(a) for a in (v, v * v, v[:-1] * v[1:]))
    same = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])  # changes before each value
    between = lambda sums, a, b: (sums[0][b] - sums[0][a]) + (sums[1][b] - sums[1][a])
    a, b = lo[enough], hi[enough]
    k = b - a - 1
    pairs = k > 0
    a, b, k = np.where(pairs, a, 0), np.where(pairs, b, 1), np.where(pairs, k, 1)
    left, right = between(one, a, b - 1), between(one, np.minimum(a + 1, len(v)), b)
    left2, right2 = between(two, a, b - 1) - left * left / k, between(two, np.minimum(a + 1, len(v)), b) - right * right / k
    both = between(cross, a, b - 1) - left * right / k
    moves = (same[np.maximum(b - 2, 0)] > same[np.minimum(a, len(same) - 1)]) & (same[np.maximum(b - 1, 0)] > same[np.minimum(a + 1, len(same) - 1)])
    spread = np.sqrt(np.maximum(left2, 0)) * np.sqrt(np.maximum(right2, 0))
    good = pairs & moves & (spread > 0)
    out[enough] = np.where(good, np.clip(both / np.where(good, spread, 1.0), -1, 1), 0.0)
    return out


def lag_correlation(df: DataFrame, by: Sequence[str], value: str, n: int, least: int, out: str, size: int = BLOCK) -> DataFrame:
    """Adds the rolling lag-1 correlation over the last n rows."""
    rows, kept = halo(df, by, n - 1, size), df.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = f[OWN].to_numpy(dtype=bool)
        found = lagged(f[value].to_numpy(dtype=float), n, least)[own]
        return f.loc[own, kept].assign(**{out: found})

    return _per_block(df, rows, by, run, [out])
