"""Windows over bars with a least number of observations. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TIME = "open_time"


def least(kind: str, n: int) -> int:
    """Least observations of a window of n bars, by kind of statistic."""
    return {"basic": min(max(3, n // 4), n), "trend": min(max(4, n // 3), n), "pair": min(max(5, n // 4), n), "rank": min(max(10, n // 4), n), "vol": min(10, n)}[kind]


def trailing(n: int, *by: str, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time).rowsBetween(-(n - 1), 0)


def expanding(*by: str, time: str = TIME, until: int = 0) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, until)


def ordered(*by: str, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time)


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def rolled(agg: Column, seen: Column, w: WindowSpec, at_least: int) -> Column:
    """The aggregate over the window if it saw at least so many values."""
    return F.when(F.count(seen).over(w) >= at_least, agg.over(w))


def std(x: Column, w: WindowSpec, at_least: int) -> Column:
    return rolled(F.stddev_samp(x), x, w, at_least)


def mean(x: Column, w: WindowSpec, at_least: int) -> Column:
    return rolled(F.avg(x), x, w, at_least)


def correlation(x: Column, y: Column, w: WindowSpec, at_least: int) -> Column:
    """Over complete pairs; NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return F.when(F.count(a).over(w) >= at_least, ratio(F.covar_samp(a, b).over(w), spread))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w)
