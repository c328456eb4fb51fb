"""SimHash fingerprints, linked by bit-sliced comparison.

A fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 values of the text's word shingles.
Fingerprints within a radius of 3 bits agree on at least two of five bit blocks, so each distinct fingerprint goes to
ten tables, one per pair of blocks, keyed by their 25 or 26 bits. Keys that hold more than HOT fingerprints are cut
into tiles, and each pair of tiles is compared once more, so that no task holds a large key and no link is lost.

Within a task the fingerprints lie in vertical bit planes, 64 of them to a machine word; the planes, shifted
against themselves, give the differences of 64 pairs at once, which carry-save counters add up. Words in which every
pair exceeds the radius, or crosses a key's border, are abandoned. A task returns a spanning forest of its links, never
all pairs, and connected components join the forests.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
a table with no rows gives none; equal texts share their component; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import private, settle, texts
from tidegauge.llm.components import components, forest

WIDTH, RADIUS, SEED = 3, 3, 42
#: Bounds of the five blocks; any three differing bits leave two of them untouched.
BLOCKS = (0, 13, 26, 39, 52, 64)
#: Keys with more distinct fingerprints are compared in tiles of about this many.
HOT = 4096
#: Rows that are compared in one go, but for the rest of the last key.
CHUNK = 1 << 16


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The XXH64 values of the text's word shingles, in their order; of all words if they are fewer."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - k].tolist(), ends[k:].tolist())], "<u8")


def fingerprint(text: str, width: int = WIDTH) -> int:
    return majority(shingles(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the values."""
    counts = np.zeros(64, "i8")
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """A row of machine words per bit: bit j of word w of row b is bit b of fingerprint 64 w + j. One spare word.

    A fingerprint is a number of 64 bits, or a row of several."""
    n = len(fps)
    width = 8 * (fps.shape[1] if fps.ndim > 1 else 1)
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view("u1").reshape(n, width), axis=1, bitorder="little").T
    out = np.zeros((8 * width, (n // 64 + 2) * 8), "u1")
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def lanes(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, "u1")
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def within(p: np.ndarray, shift: int, allowed: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i (as bits of words) whose fingerprints i and i + shift differ in at most `radius` bits."""
    ws, bs = shift // 64, np.uint64(shift % 64)
    at = np.flatnonzero(allowed)
    at = at[at + ws < p.shape[1]]
    alive = allowed[at]
    depth = radius.bit_length()
    counters = [np.zeros(len(at), "<u8") for _ in range(depth)]
    for b in range(len(p)):
        other = p[b, at + ws] >> bs
        if bs:
            other |= p[b, np.minimum(at + ws + 1, p.shape[1] - 1)] << np.uint64(64 - int(bs))
        carry = p[b, at] ^ other
        for c in counters:
            held = c & carry
            c ^= carry
            carry = held
        alive &= ~carry
        if b % 8 == 7:
            keep = alive != 0
            if not keep.all():
                at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
            if not len(at):
                break
    # what the counters hold is at most the radius unless it is greater at the highest bit that differs
    greater, equal = np.zeros(len(at), "<u8"), ~np.zeros(len(at), "<u8")
    for i in reversed(range(depth)):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            greater |= equal & counters[i]
            equal &= ~counters[i]
    out = np.zeros(len(allowed), "<u8")
    out[at] = alive & ~greater
    return out


def linked(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (id, root), of the links between rows of equal key; rows are sorted by key."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    shift, pending = 1, 0
    p = None
    while True:
        if shift & (shift - 1) == 0:  # keep the rows of keys that are larger than the shift
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
            size = np.diff(np.append(edges, len(keys)))
            keep = np.repeat(size > shift, size)
            keys, fps, ids = keys[keep], fps[keep], ids[keep]
            p = planes(fps)
        if len(keys) <= shift:
            break
        same = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        hit = within(p, shift, lanes(same, p.shape[1]), radius)
        if hit.any():
            i = np.flatnonzero(np.unpackbits(hit.view("u1"), bitorder="little"))
            found.append((ids[i], ids[i + shift]))
            pending += len(i)
            if pending > 4 * CHUNK:
                found, pending = [forest(*map(np.concatenate, zip(*found)))], 0
        shift += 1
    return forest(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, "i8"),) * 2


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the ids of distinct fingerprints (fp, id) as all links within the radius do."""
    if radius > 3:
        raise ValueError("five blocks prove a radius of at most 3")
    keys = []
    for t, pair in enumerate(combinations(range(5), 2)):
        key = F.lit(t)
        for i in pair:
            width = BLOCKS[i + 1] - BLOCKS[i]
            key = key * (1 << width) + F.shiftrightunsigned("fp", BLOCKS[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        keys.append(key)
    rows = distinct.select("fp", "id", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = rows.join(hot, "key", "left").select(
        "key", "fp", "id",
        F.explode(
            F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.col("tiles") - 1),
                    lambda other: F.least(own, other) * 65536 + F.greatest(own, other),
                )
            )
        ).alias("tile"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, tile, fp, ident = rows
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])) if len(key) else key
            a, b = linked(group, fp.view("u8"), ident, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy() for c in ("key", "tile", "fp", "id")))
            n += b.num_rows
            if n >= CHUNK:
                rows = tuple(map(np.concatenate, zip(*held)))
                last = len(rows[0]) - int(((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])).sum())
                if last:
                    yield out(tuple(c[:last] for c in rows))
                held, n = [tuple(c[last:] for c in rows)], len(rows[0]) - last
        if n:
            yield out(tuple(map(np.concatenate, zip(*held))))

    return (
        tiled.repartition("key", "tile")
        .sortWithinPartitions("key", "tile")
        .select("key", "tile", "fp", "id")
        .mapInArrow(compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per document its fingerprint, as 16 hex digits, and its component's smallest doc_id."""
    fps = settle(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    distinct = settle(distinct)
    grouped = components(links(distinct, radius))
    class_of = distinct.join(grouped, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(class_of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_group(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The documents (all columns) that are the smallest of their component; rows whose doc_id is null stay."""
    (gone,) = private(docs, "gone")
    later = near_duplicates(docs, width, radius).where("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(later, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
