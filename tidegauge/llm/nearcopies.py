"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8; the smallest doc_id stays.

Documents with equal shingle sets are one class. A class has a SimHash of BITS bits, the majority of its shingles' hashes;
sets alike by 0.8 differ in about 15 % of the bits, unrelated ones in half. Each class goes to TABLES tables, keyed by KEY of its
bits, and what shares a key is compared by its bits, bit-sliced (see simhash.py); links within RADIUS make candidate
components. Keys with many classes, where near copies abound, are searched breadth first, so that what is linked isn't compared again.

The radius only proposes. The texts of a candidate component meet once, and links between them are those with an exact
similarity of `least` or more; their components are the result. A component of more than LOAD shingles is cut
into tiles, and each pair of tiles is searched, so no task holds it whole and no link is lost; its rows are then sent once per tile.

Which pairs are proposed is left to chance: recall is measured by tests/llm/test_nearcopies.py. No link is wrong.

Defined results: a null text counts as empty; texts without words are one class, alike to no other; texts of fewer words than a
shingle have one shingle of all words; rows whose doc_id is null stay; rows that repeat a doc_id go or stay together; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import private, settle, texts
from tidegauge.llm.components import components, forest
from tidegauge.llm.simhash import CHUNK, HOT, linked, majority, shingles
from tidegauge.llm.windows import mix

BITS, RADIUS = 128, 30
TABLES, KEY = 64, 16
#: Keys with more classes are searched breadth first; shingles of a component that a task holds.
MANY, LOAD = 512, 1 << 20
#: The bits of each table's key.
PICKED = np.stack([np.random.default_rng(2000 + t).permutation(BITS)[:KEY] for t in range(TABLES)])


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingles(text, width))


def name(s: np.ndarray) -> int:
    """The class of a shingle set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> tuple[int, int]:
    return majority(s), majority(mix(s))


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, cls, lo and hi (the sketch) and n (the number of shingles) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
            bits = np.array([sketch(s) for s in sets], "u8").reshape(-1, 2).view("i8")
            cols = [pa.array([name(s) for s in sets], pa.int64()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "cls", "lo", "hi", "n"])

    return texts(docs).mapInArrow(run, "doc_id long, cls long, lo long, hi long, n long")


def keyed(distinct: DataFrame) -> DataFrame:
    """key, cls, lo and hi: a row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                cls, lo, hi = (b.column(i).to_numpy()[at : at + 1024] for i in range(3))
                bits = np.unpackbits(np.stack([lo, hi], axis=1).view("u1"), axis=1, bitorder="little")
                key = np.packbits(bits[:, PICKED], axis=2, bitorder="little").view("<u2")[:, :, 0].astype("i4")
                key += np.arange(TABLES, dtype="i4") << KEY
                cols = [key.ravel(), *(np.repeat(c, TABLES) for c in (cls, lo, hi))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "cls", "lo", "hi"])

    return distinct.select("cls", "lo", "hi").mapInArrow(run, "key int, cls long, lo long, hi long")


def spread(ids: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Breadth first: near(i, others) says which of the others are linked with i; edges that connect what links connect."""
    left, a, b = np.arange(len(ids)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            if len(found):
                a += [ids[i]] * len(found)
                b += ids[found].tolist()
                queue += found.tolist()
                left = left[~hit]
    return a, b


def close(group: np.ndarray, bits: np.ndarray, cls: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the radius between rows of equal group; rows are sorted by group."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    few = np.repeat(size <= MANY, size)
    found = [linked(group[few], bits[few], cls[few], radius)]
    for at, n in zip(first[size > MANY].tolist(), size[size > MANY].tolist()):
        x = bits[at : at + n]
        edges = spread(cls[at : at + n], lambda i, others: np.bitwise_count(x[others] ^ x[i]).sum(axis=1) <= radius)
        found.append(tuple(np.array(e, "i8") for e in edges))
    return forest(*map(np.concatenate, zip(*found)))


def alike(sets: list[np.ndarray], ids: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Edges that connect what pairs with a similarity of at least `least` connect."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    flat = np.concatenate(sets)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(others), bool)
        at = np.flatnonzero((np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i])) & (size[i] > 0))
        for part in np.array_split(at, max(1, int(size[others[at]].sum()) >> 18)):
            if not len(part):
                continue
            who = others[part]
            n = size[who]
            begin = np.cumsum(n) - n
            x = flat[np.arange(n.sum()) + np.repeat(ends[who] - n - begin, n)]
            place = np.minimum(np.searchsorted(sets[i], x), size[i] - 1)
            both = np.add.reduceat((sets[i][place] == x).astype("i8"), begin)
            hit[part] = both >= least * (n + size[i] - both) - 1e-9
        return hit

    return spread(ids, near)


def _tiled(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """rows with `tile`: in groups that sizes (group, tiles) names, each row once per pair of tiles that holds its own."""
    own = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(own, t) * 65536 + F.greatest(own, t))
    tile: Column = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(pairs)
    return rows.join(sizes, group, "left").withColumn("tile", F.explode(tile)).drop("tiles")


def candidates(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of classes whose components hold the links that a table proposes."""
    rows = keyed(distinct)
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("tiles"))
    tiled = _tiled(rows, "key", hot)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, tile, cls, lo, hi = rows
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            a, b = close(group, np.stack([lo, hi], axis=1).view("u8"), cls, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy() for c in ("key", "tile", "cls", "lo", "hi")))
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
        tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")
        .select("key", "tile", "cls", "lo", "hi").mapInArrow(compare, "a long, b long")
    )


def verified(docs: DataFrame, members: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b) of classes whose components are those of the exact links. members: cls, id (a doc_id that has it), n and component."""
    sizes = (
        members.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > LOAD)
        .select("component", F.ceil(F.col("n") / LOAD).cast("int").alias("tiles"))
    )
    rows = _tiled(members, "component", sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None

        def out() -> pa.RecordBatch:
            a, b = alike(list(held.values()), np.array(list(held), "i8"), least) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for component, tile, cls, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if (component, tile) != last:
                    yield out()
                    held, last = {}, (component, tile)
                if cls not in held:
                    s = shingle_set(text.as_py(), width)
                    if name(s) == cls:  # not another text under the same doc_id
                        held[cls] = s
        yield out()

    return (
        texts(docs).join(rows, F.col("doc_id") == F.col("id")).select("component", "tile", "cls", "text")
        .repartition("component", "tile").sortWithinPartitions("component", "tile").mapInArrow(run, "a long, b long")
    )


def first_of_group(docs: DataFrame, width: int, least: float = 0.8) -> DataFrame:
    """The documents (all columns) that are the smallest of their component; rows whose doc_id is null stay."""
    of = settle(classes(docs, width))
    distinct = settle(of.groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n")).where("id is not null"))
    proposed = components(candidates(distinct))
    inside = proposed.union(proposed.select("component", "component").distinct()).toDF("cls", "component")
    members = settle(distinct.join(inside, "cls").select("cls", "id", "n", "component"))
    grouped = components(verified(docs, members, width, least))
    kept, any_id = private(docs, "kept", "id")
    first = (
        distinct.join(grouped.withColumnRenamed("id", "cls"), "cls", "left")
        .groupBy(F.coalesce("component", "cls")).agg(F.min("id").alias(kept)).select(kept).distinct()
    )
    gone = of.select(F.col("doc_id").alias(any_id)).where(f"{any_id} is not null").distinct().join(first, F.col(any_id) == F.col(kept), "left_anti")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(any_id), "left_anti")
