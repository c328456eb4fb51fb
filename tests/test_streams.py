"""Streams against batches: keyed state with corrections and restarts, windows, a feed that breaks off, snapshots, and the store's manifest."""

from __future__ import annotations

import json
import random
import socket
import threading
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.sources import rest, store
from tidegauge.streaming import feed, live

AT = datetime(2024, 1, 1)
RETURNS = "symbol string, open_time timestamp, log_return double"


def files(spark, folder, batches, schema):
    """A folder with one file per batch, in order."""
    for i, rows in enumerate(batches):
        path = folder / f"{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(path))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))


# --- R7 ----------------------------------------------------------------------------------------------------------


def ewma(values, span):
    return np.sqrt((pd.Series(values) ** 2).ewm(alpha=2 / (span + 1), adjust=False, ignore_na=True).mean().to_numpy())


def test_running_volatility_equals_the_batch_after_corrections_and_a_restart(spark, tmp_path):
    spark.conf.set(*live.ROCKS)
    r = random.Random(4)
    bars = {(s, i): r.gauss(0, 1) for s in "AB" for i in range(24)}
    hour = lambda i: AT + timedelta(hours=i)
    rows = lambda keys, f=lambda x: x: [(s, hour(i), f(bars[s, i])) for s, i in keys]
    first = rows([("A", i) for i in (0, 2, 1, 3, 4)] + [("B", i) for i in range(8)])
    second = rows([("A", i) for i in (6, 7, 8)])  # the fifth hour of A is missing
    third = rows([("A", 5), ("B", 8)]) + [("A", hour(7), 9.0)]  # it comes late, and the seventh is corrected
    fourth = rows([("A", i) for i in range(9, 24)]) + [("B", hour(0), 5.0)]  # far too late for B
    source = tmp_path / "in"
    source.mkdir()
    got: list = []

    def run():
        out = live.running_ewma(read(spark, source, RETURNS), 5, refit_every=10, lateness=4 * 3600)
        out.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)

    files(spark, source, [first, second], RETURNS)
    run()
    for i, batch in enumerate((third, fourth), 2):
        spark.createDataFrame(batch, RETURNS).coalesce(1).write.json(str(source / f"{i:03d}"))
    run()  # a new query goes on from the state
    bars["A", 7] = 9.0
    last = {(x["symbol"], x["open_time"]): (x["volatility"], x["bars"]) for x in got if x["kind"] in ("new", "revised")}
    for s, n in (("A", 24), ("B", 9)):
        want = ewma([bars[s, i] for i in range(n)], 5)
        assert [last[s, hour(i)][0] for i in range(n)] == pytest.approx(want, rel=1e-12)
        assert [last[s, hour(i)][1] for i in range(n)] == list(range(1, n + 1))
    kinds = [(x["symbol"], x["open_time"], x["kind"]) for x in got]
    assert ("B", hour(0), "late") in kinds and ("A", hour(5), "new") in kinds and ("A", hour(8), "revised") in kinds
    assert sum(k == "late" for *_, k in kinds) == 1
    assert {x["bars"] for x in got if x["refit_due"]} == {10, 20}


# --- R9 ----------------------------------------------------------------------------------------------------------

TICKS = "id long, symbol string, ts timestamp, price double"


@pytest.mark.parametrize("kind", [{"width": "10 minutes"}, {"width": "20 minutes", "slide": "5 minutes"}, {"gap": "7 minutes"}])
def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path, kind):
    r = random.Random(2)
    ticks = sorted((AT + timedelta(seconds=r.randint(0, 20_000)), r.choice("AB")) for _ in range(400))
    rows = [(i, s, at, r.random()) for i, (at, s) in enumerate(ticks)]
    batches = [rows[i : i + 100] for i in range(0, 400, 100)]
    for a, b in zip(batches, batches[1:]):
        a[-3:], b[:3] = b[:3], a[-3:]  # some come out of order
    late = (999, "A", AT + timedelta(seconds=1), 99.0)
    closing = (1000, "A", AT + timedelta(days=2), 1.0)
    files(spark, tmp_path / "in", [*batches, [closing], [late], [(1001, "A", AT + timedelta(days=4), 1.0)]], TICKS)
    out = live.over_windows(read(spark, tmp_path / "in", TICKS), "30 minutes", **kind)
    status = live.Status()
    spark.streams.addListener(status)
    got: list = []
    try:
        q = out.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        key = str(q.id)
        for _ in range(50):
            if status.mode.get(key) == "PAUSED":
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(status)
    want = live.over_windows(spark.createDataFrame([*rows, closing], TICKS), "30 minutes", **kind).collect()
    inside = lambda xs: sorted(tuple(x) for x in xs if x["start"] < AT + timedelta(days=1))
    assert inside(got) == inside(want) and len(inside(want)) > 5
    assert status.late[key] >= 1 and status.rows[key] == 403 and status.mode[key] == "PAUSED"
    with pytest.raises(ValueError, match="width"):
        live.over_windows(out, "1 hour")


# --- S4 ----------------------------------------------------------------------------------------------------------


class Server:
    """Numbered lines on a local port; connections break after so many lines, in the middle of the next."""

    def __init__(self, lines, breaks):
        self.lines, self.breaks, self.since = lines, list(breaks), []
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        while True:
            try:
                s, _ = self.socket.accept()
            except OSError:
                return
            threading.Thread(target=self._answer, args=(s,), daemon=True).start()

    def _answer(self, s):
        with s, s.makefile("rw", encoding="utf-8", newline="\n") as f:
            word, *rest = f.readline().split()
            if word == "LAST":
                f.write(f"{len(self.lines)}\n")
                return
            start = int(rest[0])
            self.since.append(start)
            left = self.breaks.pop(0) if self.breaks else len(self.lines)
            for i, line in enumerate(self.lines[start:]):
                if i == left:
                    f.write(line[:5])
                    return
                f.write(line + "\n")


def message(i):
    ms = int(AT.timestamp() * 1000) + 3_600_000 * i
    return json.dumps({"k": {"s": "abc", "i": "1h", "t": ms, "T": ms + 3_599_999, "o": "1", "h": "2", "l": "0.5", "c": str(1 + i / 100), "v": "3", "x": True}})


def test_no_line_is_lost_when_the_connection_breaks_twice(spark, tmp_path):
    from tidegauge.sources.candles import from_stream_json

    server = Server([message(i) for i in range(60)], [13, 9])
    out = from_stream_json(feed.feed(spark, "127.0.0.1", server.port, first_wait=0.01, lines=40))
    got: list = []
    for _ in range(2):
        out.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination(120)
        if len(server.lines) == 60:
            server.lines += [message(i) for i in range(60, 75)]
    server.socket.close()
    assert sorted(x["close"] for x in got) == pytest.approx([1 + i / 100 for i in range(75)])
    assert {13, 22} <= {s for s in server.since} or len(server.since) >= 4


def test_waits_double():
    with socket.create_server(("127.0.0.1", 0)) as free:
        port = free.getsockname()[1]
    f = feed.Feed("127.0.0.1", port, first_wait=0.001, longest_wait=0.005, tries=6)
    with pytest.raises(OSError):
        list(f.lines(0, 2))
    assert f.waits == [0.001, 0.002, 0.004, 0.005, 0.005]


# --- S13 ---------------------------------------------------------------------------------------------------------


def test_each_batch_becomes_the_snapshot_and_a_failed_one_leaves_the_last(spark, tmp_path):
    schema = "name string, value long"
    source, path = tmp_path / "in", str(tmp_path / "out")
    files(spark, source, [[("a", 1), ("b", 2)], [("a", 3)]], schema)
    assert feed.read_snapshot(path) is None
    broken = F.when(F.col("value") < 0, F.raise_error(F.lit("no"))).otherwise(F.col("value"))
    rows = read(spark, source, schema).select("name", broken.cast("string").alias("value"))

    def run():
        q = feed.push(rows, path, str(tmp_path / "c"), trigger={"availableNow": True})
        q.awaitTermination(120)

    run()
    now = feed.read_snapshot(path)
    assert now["version"] == 1 and now["rows"] == [{"name": "a", "value": "3"}]
    spark.createDataFrame([("a", 4), ("c", -1)], schema).coalesce(1).write.json(str(source / "002"))
    with pytest.raises(Exception, match="no"):
        run()
    assert feed.read_snapshot(path) == now
    left = {p.name for p in (tmp_path / "out").iterdir()}
    assert set(now["files"]) <= left and "CURRENT" in left


# --- S7 ----------------------------------------------------------------------------------------------------------

CANDLES = "symbol string, interval string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double, is_closed boolean"


def candles(spark, symbol, days, close, closed=True):
    rows = [(symbol, "1d", AT + timedelta(days=i), AT + timedelta(days=i + 1) - timedelta(seconds=1), 1.0, 9.0, 0.5, close, 1.0, closed) for i in days]
    return spark.createDataFrame(rows, CANDLES)


def test_only_touched_months_are_written_again(spark, tmp_path):
    root = str(tmp_path / "store")
    m = store.Manifest(spark, root)
    assert m.version() == 0 and store.read_candles(spark, root).count() == 0 and store.next_seq(spark, root) == 0
    assert store.upsert(spark, root, candles(spark, "ABC/D", range(90), 1.0).unionByName(candles(spark, "X Y", range(40), 5.0)), 0) == 1
    before = m.live()
    assert len(before) == 3 + 2  # months of two symbols
    assert store.upsert(spark, root, candles(spark, "ABC/D", [40], 2.0), 1) == 2
    after = m.live()
    assert {p for p in after if after[p] != before[p]} == {"symbol=ABC/D/interval=1d/month=2024-02"}
    got = {r["open_time"]: r["close"] for r in store.read_candles(spark, root, ["abc/d"], "1d").collect()}
    assert len(got) == 90 and got[AT + timedelta(days=40)] == 2.0 and sum(v == 1.0 for v in got.values()) == 89
    assert store.read_candles(spark, root).count() == 130 and store.next_seq(spark, root) == 2
    assert store.upsert(spark, root, candles(spark, "Q", [0], 1.0, closed=False), 2) == 2


def test_a_reader_keeps_its_version_and_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.upsert(spark, root, candles(spark, "A", range(10), 1.0), 0)
    reader = store.read_candles(spark, root)
    m = store.Manifest(spark, root)
    commit, interfered = store.Manifest.commit, []

    def second(self, version, files):
        if not interfered:  # another writer comes between reading and committing
            interfered.append(version)
            store.upsert(spark, root, candles(spark, "A", [3], 7.0), 1)
        commit(self, version, files)

    monkeypatch.setattr(store.Manifest, "commit", second)
    assert store.upsert(spark, root, candles(spark, "A", [5], 8.0), 2) == 3
    got = {r["open_time"].day: r["close"] for r in store.read_candles(spark, root).collect()}
    assert (got[4], got[6], got[1], len(got)) == (7.0, 8.0, 1.0, 10)
    assert {r["close"] for r in reader.collect()} == {1.0}  # read after two commits
    with pytest.raises(store.Conflict):
        commit(m, 2, {})
    assert m.vacuum() > 0 and store.read_candles(spark, root).count() == 10


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.upsert(spark, root, candles(spark, "A", range(5), 1.0), 0)

    def crash(self, version, files):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patched:
        patched.setattr(store.Manifest, "commit", crash)
        with pytest.raises(RuntimeError):
            store.upsert(spark, root, candles(spark, "A", [2], 9.0), 1)
    assert {r["close"] for r in store.read_candles(spark, root).collect()} == {1.0}
    assert store.upsert(spark, root, candles(spark, "A", [2], 9.0), 1) == 2
    assert sorted(r["close"] for r in store.read_candles(spark, root).collect()) == [1.0, 1.0, 1.0, 1.0, 9.0]


# --- S1 ----------------------------------------------------------------------------------------------------------


class Pages:
    """A server of pages, by threads of this process: workers reach it over HTTP."""

    def __init__(self):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from urllib.parse import parse_qs, urlparse

        asked = self.asked = []

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                asked.append((q["symbol"], int(q["startTime"]), int(q["endTime"])))
                hour = 3_600_000
                first = -(-int(q["startTime"]) // hour) * hour
                rows = [[t, "1", "2", "0.5", "1.5", "3", t + hour - 1] for t in range(first, int(q["endTime"]) + 1, hour)][: int(q["limit"])]
                body = json.dumps(rows).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"


def test_filters_reach_the_pages(spark):
    pages = Pages()
    spark.dataSource.register(rest.Klines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    hour = 3_600_000
    ranges = json.dumps({"B": [0, 9 * hour]})
    df = spark.read.format("klines").options(url=pages.url, symbols="a,b,c", interval="1h", start=0, end=99 * hour, bars=50, limit=20, ranges=ranges).load()
    assert df.groupBy("symbol").count().sort("symbol").collect() == [("A", 100), ("B", 10), ("C", 100)]
    pages.asked.clear()
    got = df.where((F.col("symbol") == "C") & (F.col("open_ms") >= 70 * hour) & (F.col("open_ms") < 80 * hour))
    assert got.count() == 10
    assert {s for s, *_ in pages.asked} == {"C"} and all(a >= 70 * hour and b < 80 * hour for _, a, b in pages.asked) and len(pages.asked) == 1
    pages.asked.clear()
    assert df.where(F.col("symbol").isin("A", "B") & (F.col("open_ms") == 5 * hour)).count() == 2 and len(pages.asked) == 2
    pages.server.shutdown()
