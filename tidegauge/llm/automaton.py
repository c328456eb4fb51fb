"""Repeated passages of words, found with suffix automata; the first occurrence stays.

The corpus is dealt into reference shards (see windows.py), in which every window meets its equals. A task builds the suffix automaton
of a shard's different spans in document order, and streams each span through it before it is added: where the matching
statistic reaches WIDTH words, the window has an earlier occurrence, and its words are removed. Equal spans of a shard are one, compared
byte by byte; those of hot anchors are told by hash. A shard's automaton is bounded by the shard, never by the corpus. All of them
together are as large as the corpus, which no broadcast bounds, and streaming every document through every shard is quadratic: so
documents don't meet all automata; their spans are dealt to the one that holds their anchor.

Defined results: a null text counts as empty; texts of fewer words than a window lose nothing; earlier means a smaller
doc_id, or the same document and an earlier start; rows that repeat a doc_id and its text count as that one document, and all
come out alike; different texts under one doc_id are documents of their own, in the order of a hash of them; rows without doc_id keep
all words; words of more than LONG bytes are compared by a digest of 256 bits; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.linededup import word_hashes
from tidegauge.llm.windows import covered, marked

WIDTH, GRAM = 20, 5
#: Bytes of text whose automaton is built at once.
SHARD = 400_000
#: Longer words are compared by their digest, so that no span is large.
LONG = 256


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: bytes) -> int:
        """A copy of q for what is at most one longer than p."""
        clone = self._new(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            cur, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = cur

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """After each word, the length of the longest match that ends there."""
        at = n = 0
        moves, link, length = self.next, self.link, self.length
        for c in words:
            while at and c not in moves[at]:
                at = link[at]
                n = length[at]
            to = moves[at].get(c)
            if to is None:
                n = 0
            else:
                at = to
                n += 1
            yield n


def runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    """(first, number) of each run of true flags."""
    start = None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i - start
            start = None


def earlier(rows: list[tuple[int, int, int, bytes]], width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(doc_id, start, number) of the windows that occur in an earlier row."""
    sam = Automaton()
    for doc, start, n, text in sorted(rows, key=lambda r: r[:2]):
        words = text.split(b" ")
        flags = [m >= width for m in sam.statistics(words)][width - 1 :]
        for at, count in runs(flags):
            yield doc, start + at, count
        if not all(flags):
            sam.add(words)


def _symbols():
    return lambda text: word_hashes(np.frombuffer(text.encode(), "u1"))[1]


def _content():
    def cutter(text: str):
        words = [w if len(w) <= LONG else hashlib.sha256(w).digest().hex().encode() for w in text.encode().split()]
        return lambda i, j: b" ".join(words[i:j])

    return cutter


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space), n_words and n_removed."""
    found = marked(docs, width, gram, _symbols, _content, lambda rows: earlier(rows, width), SHARD, once=True)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for text, marks in zip(b.column("text"), b.column("marks").to_pylist()):
                words = text.as_py().encode().split()
                gone = covered(len(words), width, marks) if marks else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept))
            cols = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])

    got = found.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept binary")
    return got.withColumn("kept", F.col("kept").cast("string"))
