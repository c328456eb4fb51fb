"""A data source for paged candle history: spark.read.format("klines")."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from tidegauge.functions.intervals import interval_seconds

PAGE = 1000
Fetch = Callable[[str], str]


def pages(fetch: Fetch, url: str, symbol: str, interval: str, start: int, end: int, limit: int = PAGE) -> Iterator[list]:
    """Rows of [start, end] in milliseconds, page by page, until a page is short or doesn't move on."""
    limit = min(limit, PAGE)
    while start <= end:
        rows = json.loads(fetch(f"{url}?symbol={symbol}&interval={interval}&startTime={start}&endTime={end}&limit={limit}"))
        yield from (r for r in rows if start <= int(r[0]) <= end)
        if len(rows) < limit or int(rows[-1][0]) + 1 <= start:
            return
        start = int(rows[-1][0]) + 1


def _http(url: str) -> str:
    with urlopen(url, timeout=20) as answer:
        return answer.read().decode()


class _Slice(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class _Reader(DataSourceReader):
    """Slices of each symbol's range; filters on symbol and open_ms cut both before anything is fetched."""

    def __init__(self, options: dict):
        self.o = options
        self.symbols = [s.strip().upper() for s in options["symbols"].split(",")]
        ranges = json.loads(options.get("ranges", "{}"))  # symbol: [start, end] of its own
        whole = (int(options.get("start", 0)), int(options.get("end", 0)))
        self.ranges = {s: tuple(map(int, ranges.get(s, whole))) for s in self.symbols}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "symbol" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in names]
            elif column == "open_ms" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = f.value if isinstance(f, EqualTo | GreaterThanOrEqual) else f.value + 1 if isinstance(f, GreaterThan) else None
                high = f.value if isinstance(f, EqualTo | LessThanOrEqual) else f.value - 1 if isinstance(f, LessThan) else None
                self.ranges = {s: (a if low is None else max(a, low), b if high is None else min(b, high)) for s, (a, b) in self.ranges.items()}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        size = interval_seconds(self.o["interval"]) * 1000 * int(self.o.get("bars", 10 * PAGE))
        slices = []
        for s in self.symbols:
            start, end = self.ranges[s]
            slices += [_Slice(s, a, min(a + size - 1, end)) for a in range(start, end + 1, size)]
        return slices or [_Slice("", 1, 0)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        for r in pages(_http, self.o["url"], part.symbol, self.o["interval"], part.start, part.end, int(self.o.get("limit", PAGE))):
            yield part.symbol, self.o["interval"], int(r[0]), json.dumps(r)


class Klines(DataSource):
    """symbol, interval, open_ms and value (a page's row as JSON); options url, symbols, interval, start, end, ranges, limit, bars.

    Each symbol's range is cut into slices of `bars` bars, one task each; ranges (JSON, symbol: [start, end]) gives symbols ranges of their own.
    Filters on symbol and open_ms are pushed down (spark.sql.python.filterPushdown.enabled must be true): only pages that they need are fetched. Parse with
    candles.from_rest_rows.
    """

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, interval string, open_ms long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
