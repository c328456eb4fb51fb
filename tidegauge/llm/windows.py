"""Brings equal windows of all documents together, so that an index over a bounded shard can find them.

A window is `width` consecutive symbols (bytes or words). Its anchor is the least hashed run of `gram` symbols in it,
the last of them if tied; equal windows have equal anchors at the same place. Consecutive windows with one anchor make a
span. Anchors are counted, pre-aggregated by each task, and the spans of those that occur once go. The texts of the
others are shipped, keyed by anchor; a task takes whole anchors until a batch is full, holds each distinct text once, and
indexes those: a shard. Equal texts of a shard are compared byte by byte, all other windows are found by the index.

An anchor with more than HOT spans, say of a passage that a third of all documents hold, is never one task's. Its spans are aggregated by
a 64-bit hash of their content, before the shuffle, and joined back, a skewed join that adaptive execution splits; copies are told by that hash.
The first span of each content is shipped as above. If there are more than HOT contents, as where a passage has
different surroundings everywhere, no index is built: their windows are counted by a 128-bit hash of each, likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import marked_texts, texts, written

#: Symbols that are hashed in one go; longer texts overlap by a window.
CHUNK = 1 << 19
#: Spans of one anchor beyond which they are aggregated, and contents beyond which windows are counted one by one.
HOT = 2048
#: Spans that are sent in one go.
ROWS = 1 << 15
#: A span has fewer windows than this; its first window and their number are one number in the shuffle.
MOST = 1 << 12
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(CHUNK + 4096, base)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype="u8")
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(symbols: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, number of windows) of one text, given a random u8 value per symbol."""
    parts = []
    for at in range(0, max(1, len(symbols) - width + 1), CHUNK - width + 1):
        x = symbols[at : at + CHUNK]
        n = len(x) - width + 1
        if n < 1:
            break
        up, down = _powers(len(x) + 1)
        total = np.concatenate([np.zeros(1, "u8"), np.cumsum(x * up[:-1], dtype="u8")])
        grams = mix((total[gram:] - total[:-gram]) * down[: len(x) - gram + 1])
        # 44 bits of hash, then the place from behind: the least is the last of the least hashes
        low = (grams & ~np.uint64((1 << 20) - 1)) | (np.uint64((1 << 20) - 1) - np.arange(len(grams), dtype="u8"))
        size, w = 1, width - gram + 1
        while 2 * size <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.append(first, n))
        end = first + count + width - 1
        content = mix((total[end] - total[first]) * down[first])
        parts.append(((low[first] >> np.uint64(20)).view("i8"), content.view("i8"), first + at, count))
    if not parts:
        return tuple(np.zeros(0, "i8") for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


SPAN = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
WINDOW = pa.schema([("window", pa.binary()), ("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int64())])
MARK = pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def marked(
    docs: DataFrame,
    width: int,
    gram: int,
    symbols: Callable[[], Callable[[str], np.ndarray]],
    content: Callable[[], Callable[[str], Callable[[int, int], bytes]]],
    index: Callable[[list[tuple[int, int, int, bytes]]], Iterator[tuple[int, int, int]]],
    batch_bytes: int,
    once: bool,
) -> DataFrame:
    """doc_id, text and marks (array of struct(start, n)): the windows that also occur elsewhere or, with `once`, earlier.

    symbols() makes a function from a text to a value per symbol; content() one from a text to a function that cuts
    out symbols; index() takes (number, 0, number of windows, content) of different contents, in order, and gives (number, first window,
    number of windows) of what it finds. With `once`, windows at the same place of rows that repeat a doc_id and its text are one.
    """
    docs = marked_texts(texts(docs))
    row, me = ["doc_id", "v"], F.struct("doc_id", "v", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = symbols()
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held), return_counts=True)], ["anchor", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if doc is not None:
                    held.append(spans(values(text.as_py()), width, gram)[0])
                    size += len(held[-1])
                if size >= 8 * ROWS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = symbols()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], ["anchor", "h", "doc_id", "v", "place"])

        for b in batches:
            for doc, text, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if doc is None:
                    continue
                key, h, start, n = spans(values(text.as_py()), width, gram)
                if len(key):
                    held.append((key, h, np.full(len(key), doc), np.full(len(key), v), start * MOST + n))
                    size += len(key)
                if size >= ROWS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    # what is joined back is written first: then both sides of a join are shuffled for it alone, and adaptive execution can split hot keys
    several = docs.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    several = written(several.select("anchor", (F.col("n") > HOT).alias("hot")))
    repeats = written(docs.mapInArrow(find, "anchor long, h long, doc_id long, v long, place long").join(several, "anchor"))
    hot = repeats.where("hot")

    def with_spans(chosen: DataFrame) -> DataFrame:
        """The texts of which spans are chosen. The joins are outer, as the last one, so that one shuffle of the texts serves all."""
        lists = chosen.groupBy(*row).agg(F.collect_set(F.struct("anchor", "place")).alias("spans"))
        return docs.join(lists, row, "left").select(*row, "text", F.explode_outer(F.array("spans")).alias("spans")).where("spans is not null")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = content()
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, v, text, chosen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                cut = cutter(text.as_py())
                for s in chosen:
                    start, n = divmod(s["place"], MOST)
                    rows.append((s["anchor"], doc, v, start, n, cut(start, start + n + width - 1)))
                    size += len(rows[-1][5])
                    if size > 1 << 22 or len(rows) > 1 << 16:
                        yield _batch(rows, SPAN)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, SPAN)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cutter, rows = content(), []
        for b in batches:
            for doc, v, text, chosen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                cut = cutter(text.as_py())
                for s in chosen:
                    start, n = divmod(s["place"], MOST)
                    rows += [(xxhash.xxh3_128_digest(cut(i, i + width)), doc, v, i) for i in range(start, start + n)]
                    if len(rows) >= ROWS:
                        yield _batch(rows, WINDOW)
                        rows = []
        if rows:
            yield _batch(rows, WINDOW)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int, int, int]]] = {}
        size, last = 0, None

        def out() -> pa.RecordBatch:
            marks: list[tuple[int, int, int, int]] = []
            shard = sorted((min(places), text) for text, places in held.items())
            for text, places in held.items():
                if once and len(places) > 1:
                    first = min(places)
                    marks += [p for p in places if p != first]
                elif len(places) > 1:
                    marks += places
            if len(shard) > 1:
                for i, at, n in index([(i, 0, p[3], text) for i, (p, text) in enumerate(shard)]):
                    doc, v, start, _ = shard[i][0]
                    marks.append((doc, v, start + at, n))
            return _batch(marks, MARK)

        for b in batches:
            for key, doc, v, start, n, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                if key != last and size > batch_bytes:
                    yield out()
                    held, size = {}, 0
                if text not in held:
                    held[text] = []
                    size += len(text)
                held[text].append((doc, v, start, n))
                size += 32
                last = key
        yield out()

    def looked(chosen: DataFrame) -> DataFrame:
        shipped = with_spans(chosen).mapInArrow(ship, "anchor long, doc_id long, v long, start long, n int, bytes binary")
        return shipped.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(look, "doc_id long, v long, start long, n int")

    if hot.isEmpty():
        marks = looked(repeats)
    else:  # the same, and hot anchors: spans are copies, or the first of a content; firsts are looked up whole, or window by window
        contents = hot.groupBy("anchor", "h").agg(F.min(me).alias("first"), F.count("*").alias("copies"))
        kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"))
        told = repeats.join(written(contents.join(kinds, "anchor")), ["anchor", "h"], "left")
        first = (me == F.col("first")) & (F.col("kinds") > 1)
        how = F.when(~F.col("hot"), 1).when(first, F.when(F.col("kinds") <= HOT, 1).otherwise(2)).otherwise(0)
        copy = F.col("hot") & (me != F.col("first") if once else F.col("copies") > 1)
        told = written(told.select("anchor", *row, "place", how.alias("look"), copy.alias("copy")))  # one join for all branches
        copied = told.where("copy").select(*row, F.floor(F.col("place") / MOST).alias("start"), (F.col("place") % MOST).cast("int").alias("n"))
        whole = told.where("look = 1")
        windows = with_spans(told.where("look = 2")).mapInArrow(single, "window binary, doc_id long, v long, start long")
        at = F.struct("doc_id", "v", "start")
        many = written(windows.groupBy("window").agg(F.count("*").alias("many"), F.min(at).alias("first")).where("many > 1"))
        again = windows.join(many, "window").where(at != F.col("first") if once else F.lit(True)).select(*row, "start", F.lit(1).alias("n"))
        marks = looked(whole).union(copied).union(again)
    lists = marks.groupBy(*row).agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    return docs.join(lists, row, "left").select("doc_id", "text", "marks")


def covered(n: int, width: int, marks: list | None) -> np.ndarray:
    """Which of n symbols a marked window covers."""
    change = np.zeros(n + 1, "i8")
    for m in marks or ():
        change[m["start"]] += 1
        change[min(n, m["start"] + m["n"] + width - 1)] -= 1
    return np.cumsum(change[:-1]) > 0
