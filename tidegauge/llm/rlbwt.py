"""Repeated byte strings, found with a run-length compressed Burrows-Wheeler transform.

The corpus is dealt into shards (see windows.py), in which every window of WIDTH bytes meets its equals. Equal spans of a shard are one,
compared byte by byte; those of hot anchors are told by hash. Of a shard's different spans, each closed by a symbol of its own, a task
sorts the suffixes (prefix doubling, refining only what is still tied), takes the transform, and keeps its runs: the suffix positions
at run starts and run ends, and how far each of these agrees with its neighbour. Building needs memory for the whole shard, which is
bounded; what is kept, and streamed from, is the runs. Streaming through the text then gives every position's matching statistic: at a sampled
position the sample, elsewhere one less than at the position before, since inside a run neighbours move together. A
window whose statistic reaches WIDTH occurs elsewhere, and its bytes are marked. Copies cost one run each, so repetitive shards stay small.

Defined results: a null text counts as empty; texts shorter than a window lose nothing; strings are those of the
UTF-8 bytes and may cut characters, kept text is bytes; rows that repeat a doc_id count as further copies; rows without doc_id keep all bytes; an
empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.windows import covered, marked, mix

WIDTH, GRAM = 200, 64
#: Bytes of text that are indexed at once.
SHARD = 1 << 20


def suffix_ranks(symbols: np.ndarray, cap: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each suffix by its first `length` symbols) for growing lengths up to cap; equal ranks mean equal."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(2, "i8")])
    key = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2 : n + 2]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, "i8")
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    length, levels = 3, [(3, rank.astype("i4"))]
    active = order[~fresh | np.append(~fresh[1:], False)]
    while length < cap:
        step = min(length, cap - length)
        if len(active):
            ahead = active + step
            second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + second
            o = np.argsort(key, kind="stable")
            active, key = active[o], key[o]
            old = rank[active]
            group = np.concatenate([[True], old[1:] != old[:-1]])
            slot = old + np.arange(len(active)) - np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[active] = np.maximum.accumulate(np.where(fresh, slot, 0))
            active = active[~fresh | np.append(~fresh[1:], False)]
        length += step
        levels.append((length, rank.astype("i4")))
    return levels


def agreement(levels: list[tuple[int, np.ndarray]], symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share, up to the longest level."""
    n, out = len(symbols), np.zeros(len(a), "i8")
    cap = levels[-1][0]
    for length, rank in reversed(levels):
        inside = (np.maximum(a, b) + out < n) & (out < cap)
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += np.where(inside & (rank[x] == rank[y]), length, 0)
    for _ in range(2):
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += (np.maximum(a, b) + out < n) & (symbols[x] == symbols[y])
    return np.minimum(out, cap)


class RunLengthIndex:
    """The runs of the transform: what is sampled at their ends."""

    def __init__(self, symbols: np.ndarray, cap: int):
        levels = suffix_ranks(symbols, cap)
        suffixes = np.argsort(levels[-1][1], kind="stable")
        before = symbols[suffixes - 1]  # the transform
        head = np.concatenate([[True], before[1:] != before[:-1]])
        tail = np.append(head[1:], True)
        self.n = len(symbols)
        self.runs = int(head.sum())
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
        self.start_at, self.end_at = suffixes[starts], suffixes[ends]
        up, down = starts > 0, ends < self.n - 1
        self.start_agrees, self.end_agrees = np.zeros(len(starts), "i8"), np.zeros(len(ends), "i8")
        self.start_agrees[up] = agreement(levels, symbols, suffixes[starts[up] - 1], suffixes[starts[up]])
        self.end_agrees[down] = agreement(levels, symbols, suffixes[ends[down]], suffixes[ends[down] + 1])

    def statistics(self) -> np.ndarray:
        """For each position the longest match elsewhere, streamed from the samples."""
        best = np.zeros(self.n, "i8")
        for at, agrees in ((self.start_at, self.start_agrees), (self.end_at, self.end_agrees)):
            place, value = np.zeros(self.n, "i8"), np.zeros(self.n, "i8")
            place[at] = at
            value[at] = agrees
            last = np.maximum.accumulate(place)
            best = np.maximum(best, value[last] - (np.arange(self.n) - last))
        return best


def repeated(rows: list[tuple[int, int, int, bytes]], width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, number) of the windows that occur at another place of the rows."""
    lengths = np.array([len(r[3]) for r in rows])
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(ends[-1] + 1, "i8")
    text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", "u1")
    symbols[:] = text
    symbols += 1
    symbols[ends] = 257 + np.arange(len(rows))
    # sorted up to the longest row, suffixes are in full order, for each row ends in a symbol of its own
    matched = RunLengthIndex(symbols, int(lengths.max()) + 1).statistics() >= width
    change = np.diff(matched.astype("i1"), prepend=0, append=0)
    for first, stop in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        r = int(np.searchsorted(ends, first))  # a run of matches never leaves its row: its closing symbol is unique
        at = first - int(ends[r]) + int(lengths[r])
        yield rows[r][0], rows[r][1] + at, stop - first


def _symbols():
    table = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD1342543DE82EF95))
    return lambda text: table[np.frombuffer(text.encode(), "u1")]


def _content():
    def cutter(text: str):
        raw = text.encode()
        return lambda i, j: raw[i:j]

    return cutter


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and n_spans (runs of removed bytes)."""
    found = marked(docs, width, gram, _symbols, _content, lambda rows: repeated(rows, width), SHARD, once=False)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, marks in zip(b.column("text"), b.column("marks").to_pylist()):
                raw = np.frombuffer(text.as_py().encode(), "u1")
                gone = covered(len(raw), width, marks)
                out[0].append(len(raw))
                out[1].append(int(gone.sum()))
                out[2].append(int((np.diff(gone.astype("i1"), prepend=0) == 1).sum()))
                out[3].append(raw[~gone].tobytes())
            cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
