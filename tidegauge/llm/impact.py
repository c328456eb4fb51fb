"""Exact top-k by integer inner product, over an impact-ordered index, one score at a time.

Components become integers. Candidates are dealt once, queries are broadcast in blocks of at most QUERY_BYTES and streamed
through every task's shards; a shard's index has, for every dimension, posting segments: the vectors whose component
falls into one of LEVELS steps, with the segment's extreme values. A query takes segments in descending order of their quantised impact (query component times
the extreme that bounds it), adds them to accumulators, and counts what each vector has been seen in. What a vector may
still gain is bounded by the next segment's impact, or its dimension's largest where no segment was taken. The scan stops only
when all vectors but a few are proved to stay below the k-th best exact score so far; those few are rescored exactly. A task returns k
rows per query, whatever its number of shards, and a ranking over them is the result.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as candidates or
queries; a query meets only vectors of its own dimension; rows that repeat a vec_id are separate candidates, but never for queries
of that id, and one query, by the smallest of their vectors; ties go to the smaller vec_id; fewer candidates than k give all of them; extra columns are not carried.
Integers of any size are
multiplied exactly; only a result whose score doesn't fit a long is an error.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

SCALE, LEVELS = 256, 32
#: Candidates of a shard, and bytes of a block of queries.
CANDIDATES, QUERY_BYTES = 8192, 16 << 20
#: Shares of the postings after which a proof is tried.
TRIES = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9)


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
        .where(finite)
    )


def _query_blocks(asked: DataFrame, id_col: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The queries in lists of about QUERY_BYTES; the driver holds one at a time."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in asked.select(id_col, "vec").toLocalIterator():
        held.append((r[0], np.array(r[1], "f8")))
        size += held[-1][1].nbytes
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def streamed(
    candidates: DataFrame, asked: DataFrame, id_col: str, n: int, shard: int, keep: int, kind: str,
    search: Callable[[np.ndarray, list, list[tuple[int, np.ndarray]]], Iterable[tuple[int, int, object]]],
) -> DataFrame:
    """query, other and score (of type `kind`): the `keep` best of each task for each query, ties to the smaller other.

    search(ids, vectors, queries) gives (query, other, score) for one shard of vectors and queries of one dimension. The n candidates
    are shuffled once, to shards of about `shard`; what a task holds is a shard, a block of queries and their best.
    """
    schema = f"query long, other long, score {kind}"
    dealt = candidates.select(id_col, "vec").repartition(max(1, -(-n // shard)))
    parts = []
    for block in _query_blocks(asked, id_col):
        held = candidates.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], held: Broadcast = held) -> Iterator[pd.DataFrame]:
            queries: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
            for q in held.value:
                queries[len(q[1])].append(q)
            waiting: dict[int, tuple[list[int], list]] = defaultdict(lambda: ([], []))
            best: dict[int, list[tuple]] = defaultdict(list)

            def flush(dim: int) -> None:
                ids, vecs = waiting.pop(dim)
                for q, other, score in search(np.array(ids, "i8"), vecs, queries[dim]):
                    best[q].append((other, score))
                for q, found in best.items():
                    if len(found) > keep:
                        best[q] = sorted(found, key=lambda x: (-x[1], x[0]))[:keep]

            for f in frames:
                for i, v in zip(f[id_col].tolist(), f["vec"]):
                    if len(v) in queries:
                        ids, vecs = waiting[len(v)]
                        ids.append(i)
                        vecs.append(v)
                        if len(ids) >= 2 * shard:
                            flush(len(v))
            for dim in list(waiting):
                flush(dim)
            rows = [(q, other, score) for q, found in best.items() for other, score in found]
            yield pd.DataFrame(rows, columns=["query", "other", "score"])

        parts.append(written(dealt.mapInPandas(run, schema)))
        held.unpersist()
    if not parts:
        return candidates.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.union, parts)


class Index:
    """The posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        self.most = int(np.abs(x).max()) if x.dtype == object else max(int(x.max()), -int(x.min()))
        postings, dims, high, low, sizes = [], [], [], [], []
        for d in range(x.shape[1]):
            col = x[:, d]
            step = max(1, -(-int(col.max() - col.min() + 1) // LEVELS))
            level = ((col - col.min()) // step).astype("i8")
            order = np.argsort(level, kind="stable")
            cut = np.flatnonzero(np.diff(level[order])) + 1
            for seg in np.split(order, cut):
                postings.append(seg)
                dims.append(d)
                high.append(col[seg].max())
                low.append(col[seg].min())
                sizes.append(len(seg))
        self.postings, self.dims, self.sizes = postings, np.array(dims), np.array(sizes)
        self.high, self.low = np.array(high, x.dtype), np.array(low, x.dtype)

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score), best first, without the query's own id."""
        w, high, low = q[self.dims], self.high, self.low
        if self.wide(q):
            w, high, low = (a.astype(object) for a in (w, high, low))
        impact = np.where((w > 0).astype(bool), w * high, w * low)
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.sizes[order])
        if impact.dtype == object and int(np.abs(impact).max()) < 2**52:
            impact = impact.astype("i8")
        top = np.array([impact[self.dims == d].max() for d in range(len(q))], impact.dtype)
        own = self.ids == query_id
        exact = int(np.abs(impact).max()) * len(q) < 2**52  # sums of doubles then are sums of integers
        gained, seen = np.zeros(self.n, "f8" if exact else object), np.zeros(self.n, "i8")
        best: dict[int, int] = {}
        start, left = 0, np.flatnonzero(~own)
        for share in TRIES:
            end = int(np.searchsorted(done, share * done[-1])) + 1
            if end >= len(order):
                break
            part = order[start:end]
            if len(part):
                at = np.concatenate([self.postings[s] for s in part])
                if exact:
                    gained += np.bincount(at, np.repeat(impact[part], self.sizes[part]), self.n)
                else:
                    np.add.at(gained, at, np.repeat(impact[part], self.sizes[part]).astype(object))
                seen += np.bincount(at, minlength=self.n)
            start = end
            next_impact = impact[order[end]]
            open_dims = (top > next_impact).astype(bool)
            opened = np.zeros(len(q), bool)
            opened[self.dims[order[:end]]] = True
            open_dims |= opened
            closed, open_ = top[~open_dims].astype(object).sum() if not exact else top[~open_dims].sum(), int(open_dims.sum()) - seen
            bound = gained + closed + (open_ * next_impact if exact else open_.astype(object) * int(next_impact))
            rough = bound[left] if exact else np.array([float(max(-(10**300), min(10**300, b))) for b in bound[left]])  # says only whom to score first
            hopeful = left[np.argpartition(-rough, min(4 * k, len(left) - 1))[: 4 * k]] if len(left) > 4 * k else left
            for i, s in zip(hopeful.tolist(), self.exact(hopeful, q)):
                best[i] = s
            if len(best) >= k:
                floor = sorted(best.values())[-k]
                left = left[(bound[left] >= floor).astype(bool)]
            if len(left) <= max(64, self.n // 64):
                break
        scores = self.exact(left, q)
        ids = self.ids[left]
        first = np.lexsort((ids, [-s for s in scores]))[:k] if len(left) else []
        return [(int(ids[i]), int(scores[i])) for i in first]

    def wide(self, q: np.ndarray) -> bool:
        """Whether a product with the query may not fit a long."""
        return self.most * sum(abs(v) for v in q.tolist()) >= 2**62

    def exact(self, at: np.ndarray, q: np.ndarray) -> list[int]:
        if self.wide(q):
            return [sum(a * b for a, b in zip(row, q.tolist())) for row in self.x[at].tolist()]
        return (self.x[at] @ q).tolist()


def _integers(vecs: list, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as longs where they are small, else as Python's integers."""
    x = np.stack(vecs).astype("f8")
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max() < 2.0**52:
        return y.astype("i8")
    one = lambda v: int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale)
    return np.array([[one(v) for v in row] for row in x.tolist()], dtype=object)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best for each row that `queries` (on vec_id and vec) selects."""
    rows = usable(vectors)
    asked = written(rows.where(queries).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    most = 10**37

    def search(ids: np.ndarray, vecs: list, block: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, Decimal]]:
        index = Index(ids, _integers(vecs, scale))
        for query_id, vec in block:
            for i, s in index.search(query_id, _integers([vec], scale)[0], k):
                yield query_id, i, Decimal(max(-most, min(most, s)))  # beyond, it can't be cast below

    best = streamed(rows, asked, "vec_id", rows.count(), CANDIDATES, k, "decimal(38,0)", search)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "other")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("other").alias("vec_id"), F.col("score").cast("long").alias("score"))
