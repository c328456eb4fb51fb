"""Live feeds and snapshots as data sources: lines from a socket that reconnects, and versions that readers switch to at once."""

from __future__ import annotations

import json
import re
import socket
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: Seconds before the first and between the last tries to connect; the wait doubles from one to the other.
FIRST_WAIT, LONGEST_WAIT = 1.0, 60.0


class Feed:
    """A connection to a server of numbered lines, which understands `LAST` (how many lines there are) and `SINCE n` (send them from line n on).

    Whenever the connection breaks, it is made again after a wait that doubles, and goes on at the line that is due.
    """

    def __init__(self, host: str, port: int, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT, tries: int = 20, timeout: float = 20.0):
        self.at, self.wait, self.longest, self.tries, self.timeout = (host, port), first_wait, longest_wait, tries, timeout
        self.waits: list[float] = []

    def _asked(self, question: str) -> Iterator[str]:
        with socket.create_connection(self.at, timeout=self.timeout) as s:
            s.sendall(f"{question}\n".encode())
            with s.makefile("r", encoding="utf-8", newline="\n") as lines:
                for line in lines:
                    if not line.endswith("\n"):
                        break  # the connection broke within it
                    yield line[:-1]
        raise ConnectionError("the feed has closed the connection")

    def lines(self, start: int, end: int) -> Iterator[str]:
        """The lines start to end - 1, over as many connections as it takes."""
        wait, failures = self.wait, 0
        while start < end:
            try:
                for line in self._asked(f"SINCE {start}"):
                    yield line
                    start, wait, failures = start + 1, self.wait, 0
                    if start >= end:
                        return
            except OSError:
                failures += 1
                if failures >= self.tries:
                    raise
                self.waits.append(wait)
                time.sleep(wait)
                wait = min(2 * wait, self.longest)

    def last(self) -> int:
        wait, failures = self.wait, 0
        while True:
            try:
                return int(next(self._asked("LAST")))
            except (OSError, StopIteration):
                failures += 1
                if failures >= self.tries:
                    raise
                self.waits.append(wait)
                time.sleep(wait)
                wait = min(2 * wait, self.longest)


class _FeedReader(DataSourceStreamReader):
    """Offsets are numbers of lines; a batch is cut into slices of at most `lines` lines, which executors read themselves, so it can be read again."""

    def __init__(self, options: dict):
        self.o = options
        self.size = int(options.get("lines", 10_000))

    def _feed(self) -> Feed:
        o = self.o
        return Feed(o["host"], int(o["port"]), float(o.get("first_wait", FIRST_WAIT)), float(o.get("longest_wait", LONGEST_WAIT)), int(o.get("tries", 20)))

    def initialOffset(self) -> dict:
        return {"line": int(self.o.get("from", 0))}

    def latestOffset(self) -> dict:
        return {"line": self._feed().last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.size, end["line"]))) for a in range(start["line"], end["line"], self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value
        for i, line in enumerate(self._feed().lines(start, end), start):
            yield i, line


class LineFeed(DataSource):
    """line (its number) and value of a feed; options host, port, from, lines (of a slice), first_wait, longest_wait, tries."""

    @classmethod
    def name(cls) -> str:
        return "line_feed"

    def schema(self) -> str:
        return "line long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(dict(self.options))


def feed(spark: SparkSession, host: str, port: int, **options: object) -> DataFrame:
    """A stream of a feed's lines; parse messages with candles.from_stream_json."""
    spark.dataSource.register(LineFeed)
    return spark.readStream.format("line_feed").options(host=host, port=port, **options).load()


# --- snapshots ---------------------------------------------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    rows: int


class _SnapshotWriter(DataSourceStreamWriter):
    def __init__(self, path: str, keep: int):
        self.path, self.keep = path, keep

    def write(self, iterator: Iterator[Row]) -> Part:
        store, folder = _store(self.path)
        store.create_dir(folder)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        store, folder = _store(self.path)
        before = read_snapshot(self.path)
        if before and before["version"] >= batchId:
            return  # a batch that is committed again
        version = {"version": batchId, "files": [m.file for m in messages if m and m.rows], "previous": ([before["files"]] + before["previous"])[: self.keep] if before else []}
        waiting = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(waiting) as out:
            out.write(json.dumps(version).encode())
        store.move(waiting, f"{folder}/CURRENT")
        if before and len(before["previous"]) >= self.keep:
            for f in before["previous"][-1]:
                store.delete_file(f"{folder}/{f}")
        self._forget([m for m in messages if m and not m.rows])

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._forget([m for m in messages if m])

    def _forget(self, parts: list[Part]) -> None:
        store, folder = _store(self.path)
        for m in parts:
            store.delete_file(f"{folder}/{m.file}")


class SnapshotSink(DataSource):
    """Each batch replaces the snapshot: options path and keep (earlier versions whose files stay for readers that have begun)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return "name string, value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _SnapshotWriter(self.options["path"], int(self.options.get("keep", 2)))


def push(rows: DataFrame, path: str, checkpoint: str, keep: int = 2, trigger: dict | None = None):
    """Starts the query that makes each batch of a stream the current snapshot."""
    rows.sparkSession.dataSource.register(SnapshotSink)
    return rows.writeStream.format("snapshot").option("path", path).option("keep", keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def read_snapshot(path: str) -> dict | None:
    """The current version: its number, files and rows; None before the first."""
    from pyarrow import fs

    store, folder = _store(path)
    if store.get_file_info(f"{folder}/CURRENT").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{folder}/CURRENT") as f:
        version = json.loads(f.read())
    rows = []
    for name in version["files"]:
        with store.open_input_file(f"{folder}/{name}") as f:
            rows += [json.loads(x) for x in f.read().decode().splitlines()]
    return version | {"rows": rows}
