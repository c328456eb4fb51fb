"""Numbering rows in a global order without ever holding a group in one task.

Rows are dealt by ranges of the order, so rows with equal keys may lie in several partitions; each task numbers its own
rows in one pass, and the driver carries counts from partition to partition: it gets one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.llm.common import partitions, private, written


def ordered(df: DataFrame, keys: Sequence[str], then: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Adds run (dense rank of the keys, from 1), at (place within the run by `then`, from 0) and, for each of `sums`,
    <name>_sum, its running sum over the whole order, the row included. Keys must not be null; nulls in `then` come first.

    `then` should tell rows with equal keys apart, so that they can be dealt to several partitions.
    """
    spark = df.sparkSession
    pid, run, at = private(df, "pid", "run", "at")
    totals = private(df, *(f"{c}_total" for c in sums))
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        last, runs, place, so_far = None, 0, 0, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in keys:
                x = b.column(names.index(c))
                new[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = tuple(b.column(names.index(c))[0].as_py() for c in keys) != last
            last = tuple(b.column(names.index(c))[n - 1].as_py() for c in keys)
            i = np.arange(n)
            start = np.maximum.accumulate(np.where(new, i, -1 - n))
            places = np.where(start >= 0, i - start, i + place)
            ranks = runs + np.cumsum(new)
            place, runs = int(places[-1]) + 1, int(ranks[-1])
            more = []
            for k, c in enumerate(sums):
                x = np.cumsum(b.column(names.index(c)).to_numpy(zero_copy_only=False)) + so_far[k]
                so_far[k] = int(x[-1])
                more.append(pa.array(x, pa.int64()))
            cols = [*b.columns, pa.array(np.full(n, me, np.int32)), pa.array(ranks, pa.int64()), pa.array(places, pa.int64()), *more]
            yield pa.RecordBatch.from_arrays(cols, [*names, pid, run, at, *totals])

    schema = StructType(list(df.schema.fields)).add(pid, "integer").add(run, "long").add(at, "long")
    for t in totals:
        schema = schema.add(t, "long")
    dealt = df.repartitionByRange(partitions(spark), *keys, *then).sortWithinPartitions(*keys, *then)
    local = written(dealt.mapInArrow(number, schema))
    key = F.struct(*keys)
    stats = local.groupBy(pid).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max(run).alias("runs"),
        (F.max_by(at, F.struct(run, at)) + 1).alias("tail"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(sums)),
    )
    carried, last, runs, tail, so_far = [], None, 0, 0, [0] * len(sums)
    for r in sorted(stats.collect(), key=lambda r: r[pid]):
        goes_on = r["first"] == last
        before = runs - goes_on
        carried.append((r[pid], before, tail if goes_on else 0, *so_far))
        tail = r["tail"] + (tail if goes_on and r["runs"] == 1 else 0)
        runs, last = before + r["runs"], r["last"]
        so_far = [x + r[f"s{k}"] for k, x in enumerate(so_far)]
    p, r, a, *more = private(local, "p", "r", "a", *(f"s{k}" for k in range(len(sums))))
    by = ", ".join([f"{p} int", *(f"{c} long" for c in (r, a, *more))])
    moved = F.broadcast(spark.createDataFrame(carried, by))  # one row per partition
    return local.join(moved, F.col(pid) == F.col(p)).select(
        *names, (F.col(run) + F.col(r)).alias("run"), (F.col(at) + F.when(F.col(run) == 1, F.col(a)).otherwise(0)).alias("at"),
        *((F.col(t) + F.col(m)).alias(f"{c}_sum") for c, t, m in zip(sums, totals, more)),
    )
