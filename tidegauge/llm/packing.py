"""Packs token sequences into as few bins as it can: dominance reduction, then best fit.

Documents become pieces of at most `capacity` tokens. All that packing needs from the corpus is how many pieces have
each length: at most `capacity` numbers, whatever the corpus. On that histogram the driver

1. fixes bins that dominate every alternative (Martello and Toth's reduction: a piece that nothing fits beside, a pair
   that fills the bin, the largest partner where only one fits, a pair of partners that covers all other pairs), which
   shrinks the instance;
2. packs the remainder best-fit decreasing, many equal bins at a time.

The plan, bounded by the capacity alone, deals rank ranges of each length to bins; executors rank the pieces of a
length in hash buckets, so that a length which a third of the corpus shares is ranked by many tasks.

Defined results: a null or empty text is the end id alone (one piece of length 1); equal documents are packed like any
others, so are rows that repeat a doc_id or have none; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import MEMO, MEMO_CHARS, byte_chars
from tidegauge.llm.common import WHITE_SPACE, partitions, settle, texts

CAPACITY = 2048
WORD = re.compile(rf"[^{WHITE_SPACE}]+")
#: Characters at which str.split() parts words though they are no white space to the tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: A word whose normal form is its lower case: plain letters, then marks.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")


class WordCodec:
    """Encodes texts with a tokenizer that drops white space, word by word, with a bounded memo of words."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chars = dict(enumerate(byte_chars()))
        probe = "ÀÞß..."
        self.simple = SIMPLE.fullmatch if self._whole(probe) == self._simple("ÀÞß", "...") else None

    def _whole(self, word: str) -> bytes:
        return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            mapped = part.encode().decode("latin-1").translate(self.chars)
            ids = array("I", [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()
            if len(self.parts) >= MEMO:
                self.parts.clear()
            if len(part) <= MEMO_CHARS:
                self.parts[part] = ids
        return ids

    def _simple(self, letters: str, marks: str) -> bytes:
        return self._part(letters.lower()) + (self._part(marks) if marks else b"")

    def _word(self, word: str) -> bytes:
        ids = self._simple(*m.groups()) if self.simple and (m := self.simple(word)) else self._whole(word)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(word) <= MEMO_CHARS:
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.memo.get
        words = WORD.findall(text) if NOT_SPACE.search(text) else text.split()
        return b"".join([known(w) or self._word(w) for w in words])


_CODECS: dict[int, WordCodec] = {}


def word_codec(definition: str) -> WordCodec:
    if hash(definition) not in _CODECS:
        _CODECS.clear()
        _CODECS[hash(definition)] = WordCodec(definition)
    return _CODECS[hash(definition)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_path) as f:
        definition = f.read()
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, width = word_codec(definition), 4 * capacity
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = codec.encode(text.as_py()) + end
                for k, i in enumerate(range(0, len(ids), width)):
                    part = ids[i : i + width]
                    rows.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many pieces of each length are left, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({k: n for k, n in counts.items() if n > 0})
        self.order = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.order.remove(length)

    def give(self, length: int) -> None:
        """Put one piece back."""
        if not self.left[length]:
            self.order.insert(bisect_right(self.order, length), length)
        self.left[length] += 1

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest pieces longer than `above`."""
        out: list[int] = []
        for i in range(bisect_right(self.order, above), len(self.order)):
            out += [self.order[i]] * min(k - len(out), self.left[self.order[i]])
            if len(out) == k:
                break
        return out

    def fitting(self, room: int) -> int:
        """The longest piece that fits, 0 if none does."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else 0


def _dominating(stock: _Stock, length: int, capacity: int) -> tuple[int, ...] | None:
    """Partners with which `length`, already taken out once, surely may share a bin; None if nothing is proved."""
    room = capacity - length
    low = stock.smallest(3)
    if not low or low[0] > room:
        return ()
    best = stock.fitting(room)
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None
    stock.take(best, 1)
    second = stock.fitting(room - best)
    low = stock.smallest(2, above=second)
    stock.give(best)
    # at most two partners fit: (best, second) covers every pair unless two pieces longer than second fit together
    if second and (len(low) < 2 or sum(low) > room):
        return (best, second)
    pair = max((a + stock.fitting(min(a, room - a)) for a in stock.order if a <= room and stock.fitting(min(a, room - a))), default=0)
    return (best,) if pair <= best else None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(bins that dominate, as (lengths, how many)), and what is left to pack."""
    stock, fixed = _Stock(counts), []
    shrunk = True
    while shrunk:  # what is fixed leaves fewer alternatives, so lengths that weren't proved before may be now
        shrunk = False
        for length in sorted(stock.order, reverse=True):
            while stock.left[length]:
                stock.take(length, 1)
                partners = _dominating(stock, length, capacity)
                stock.give(length)
                if partners is None:
                    break
                need = Counter((length, *partners))
                many = min(stock.left[x] // k for x, k in need.items())
                for x, k in need.items():
                    stock.take(x, k * many)
                fixed.append(((length, *partners), many))
                shrunk = True
    return fixed, {x: stock.left[x] for x in stock.order}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over equal pieces and equal bins at once."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        bins[room].append((lengths, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                each = capacity // length
                full, over = divmod(n, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if over:
                    put(capacity - over * length, (length,) * over, 1)
                break
            room = rooms[i]
            lengths, have = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[i]
            each = min(room // length, n)
            many = min(have, n // each)
            put(room - each * length, lengths + (length,) * each, many)
            if have > many:
                put(room, lengths, have - many)
            n -= each * many
    return [x for group in bins.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins)."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def deal(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that are not longer than the capacity."""
    spark = parts.sparkSession
    parts = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int"))
    sizes = parts.groupBy("length", "_b").agg(F.count("*").alias("n"))
    base = sizes.withColumn(
        "_base",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("n")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots: dict[int, list[tuple[int, int, int]]] = {}
    dealt: Counter = Counter()
    first_bin = 0
    for lengths, many in plan(counts, capacity):
        at = 0
        for x in lengths:
            slots.setdefault(x, []).append((dealt[x], first_bin, at))
            dealt[x] += many
            at += x
        first_bin += many
    if dealt != Counter(counts):
        raise AssertionError("the plan doesn't hold every piece once")
    keys, bins, offsets = (np.array(c, "i8") for c in zip(*((x << 44 | r, s, o) for x in sorted(slots) for r, s, o in slots[x]))) if slots else (np.zeros(1, "i8"),) * 3

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b.column("length").to_numpy() << 44) + b.column("_rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(bins[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (
        parts.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1)
        .join(base, ["length", "_b"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r")).alias("_rank"))
    )
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenises (once; the pieces are checkpointed) and packs."""
    return deal(settle(pieces(docs, tokenizer_path, capacity, end_id)), capacity)
