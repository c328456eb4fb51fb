"""The trie of conversations' common beginnings, by prefix doubling.

1. Turns get dense names in the order of the SHA-256 of (role, text); from here on texts don't travel.
2. In logarithmic rounds the block of 2^j turns at every multiple of 2^j is named: the pairs of its halves' names, where a
   missing half is 0, are sorted and numbered. Names keep the lexicographic order, so the name of the block that holds a
   whole conversation is its rank, and conversations that begin alike have neighbouring ranks.
3. The beginning of d turns is the blocks that the binary digits of d name, largest first; their names together are its
   name. Only one conversation of each rank is taken apart. Grouped by depth and name, beginnings become nodes.
4. A node's conversations are a range of ranks, and its subtree a range of the nodes ordered by (first rank, depth): sums
   over subtrees are differences of running sums.

Numbering and running sums are passes over a global order (ordering.py), in which equal keys may lie in many partitions,
so neither a conversation of very many turns nor one that very many copy is a group in one task. The digest of a node's
ends is SHA-256, which reads its ids one after another: they are joined to texts of CHUNK ids by many tasks, and one task
per node hashes these as a stream, without holding them.

Defined results: rows without conv_id take no part; null role and text are empty; turns that share a number (or have
none) are ordered by the hash of their role and text; c - c%5 takes the remainder as SQL does (its sign is that of c); an
empty table gives no rows, not even a root; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import partitions, written
from tidegauge.llm.ordering import ordered

#: Ids of one chunk of a node's ends; beginnings that one row is expanded to at a time.
CHUNK, SPREAD = 1 << 14, 1 << 12


def named_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place of the turn, from 0), name (of its role and text) and n_bytes (of its text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    named = ordered(turns, ["digest"], ["conv_id", "turn"]).select("conv_id", "turn", F.col("run").alias("name"), "n_bytes")
    return written(ordered(named, ["conv_id"], ["turn", "name"]).select("conv_id", "at", "name", "n_bytes"))


def rebuilt(turns: DataFrame, step: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns, where the first h of each, h = crc32(conv_id) % heads, come from
    conversation conv_id - conv_id % step."""
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    c = F.col("conv_id")
    convs = own.select("conv_id", "n", (F.crc32(c.cast("string")) % heads).alias("h"), (c - c % step).alias("base"))
    base = own.select(c.alias("base"), F.col("n").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = convs.join(base, "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = written(convs)
    kept = turns.join(convs, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "name", "n_bytes", "len")
    heads_of = turns.where(F.col("at") < heads - 1).withColumnRenamed("conv_id", "base")
    taken = heads_of.join(convs.where("lent > 0"), "base").where("at < lent").select("conv_id", "at", "name", "n_bytes", "len")
    return convs.select("conv_id", "len"), written(kept.union(taken))


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Level j: conv_id, at, name and len of the blocks of 2^j turns; the last level has one block per conversation."""
    level = turns.select("conv_id", "at", "name", "len")
    levels = [level]
    while 1 << (len(levels) - 1) < longest:
        half = F.col("at") % 2
        pairs = level.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(0).cast("long")).alias("b"), F.max("len").alias("len")
        )
        level = ordered(pairs.withColumnRenamed("at", "place"), ["a", "b"], ["conv_id", "place"]).select("conv_id", F.col("place").alias("at"), F.col("run").alias("name"), "len")
        levels.append(level)
    return levels


def _each(first: Column, last: Column) -> tuple[Column, Column]:
    """Starts of stretches of SPREAD numbers from first to last, and the numbers of the stretch that starts at `s`."""
    return F.explode(F.sequence(first, last, F.lit(SPREAD).cast("long"))), F.explode(F.sequence(F.col("s"), F.least(F.col("s") + SPREAD - 1, F.col("last"))))


def beginnings(levels: list[DataFrame], turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """rank, depth, key (names of the depth's blocks), conv, n and n_bytes of every beginning but the empty one."""
    parts = []
    for j, level in enumerate(levels):
        size = 1 << j
        first = (F.col("at") + 1) * size
        blocks = level.where((F.col("at") % 2 == 0) & (first <= F.col("len"))).join(sequences.select(F.col("conv").alias("conv_id"), "rank"), "conv_id")
        starts, numbers = _each(F.col("first"), F.col("last"))
        blocks = blocks.select("rank", "name", first.alias("first"), F.least((F.col("at") + 2) * size - 1, F.col("len")).alias("last"))
        parts.append(blocks.select("rank", "name", "last", starts.alias("s")).select("rank", numbers.alias("depth"), F.lit(j).alias("level"), "name"))
    blocks = parts[0]
    for more in parts[1:]:
        blocks = blocks.union(more)
    ends = turns.join(sequences.withColumnRenamed("conv", "conv_id"), "conv_id").select("rank", (F.col("at") + 1).alias("depth"), "conv_id", "n", "n_bytes")
    none = [F.lit(None).cast("long").alias(c) for c in ("conv_id", "n", "n_bytes")]
    both = blocks.select("*", *none).unionByName(ends.select("rank", "depth", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("name"), "conv_id", "n", "n_bytes"))
    block = F.when(F.col("level").isNotNull(), F.struct("level", "name"))
    found = both.groupBy("rank", "depth").agg(F.sort_array(F.collect_list(block)).alias("blocks"), *(F.max(c).alias(c) for c in ("conv_id", "n", "n_bytes")))
    return written(found.select("rank", "depth", F.transform("blocks", lambda b: b["name"]).alias("key"), "conv_id", "n", "n_bytes"))


def ends_digests(ranked: DataFrame) -> DataFrame:
    """rank and ends_sha256 from conv_id and rank."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["rank", "first", "ids"])

        for b in batches:
            out: list[tuple] = []
            for rank, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (rank != held or len(ids) >= CHUNK):
                    out.append((held, ids[0], ",".join(map(str, ids))))
                    ids = []
                held = rank
                ids.append(conv)
            if out:
                yield rows(out)
        if ids:
            yield rows([(held, ids[0], ",".join(map(str, ids)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], ["rank", "ends_sha256"])

        for b in batches:
            out: list[tuple] = []
            for rank, ids in zip(b.column(0).to_pylist(), b.column(2)):
                if state is not None and rank == held:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((held, state.hexdigest()))
                    held, state = rank, hashlib.sha256()
                state.update(ids.as_py().encode())
            if out:
                yield rows(out)
        if state is not None:
            yield rows([(held, state.hexdigest())])

    n = partitions(ranked.sparkSession)
    chunks = ranked.select("rank", "conv_id").repartitionByRange(n, "rank", "conv_id").sortWithinPartitions("rank", "conv_id").mapInArrow(join, "rank long, first long, ids string")
    return written(chunks.repartition(n, "rank").sortWithinPartitions("rank", "first").mapInArrow(hashed, "rank long, ends_sha256 string"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, len) with turns (conv_id, at, name, n_bytes, len)."""
    longest = convs.agg(F.max("len")).first()[0] or 0
    levels = block_names(turns, longest)
    whole = levels[-1].select("conv_id", F.col("name").alias("rank"))
    ranked = written(convs.join(whole, "conv_id", "left").select("conv_id", "len", F.coalesce("rank", F.lit(0).cast("long")).alias("rank")))
    sequences = written(ranked.groupBy("rank").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.max("len").alias("len")))
    starts = beginnings(levels, turns, sequences.select("rank", "conv", "n"))

    group = [F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("n").alias("n_convs")]
    grouped = starts.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), *group, F.max("n_bytes").alias("n_bytes"))
    grouped = written(grouped)
    root = sequences.agg(F.min("conv").alias("conv_id"), *group).where("conv_id IS NOT NULL").select(F.lit(0).cast("long").alias("depth"), "conv_id", "lo", "hi", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    top = root.first()
    nodes = grouped.select("depth", "conv_id", "lo", "hi", "n_convs", "n_bytes").union(root)

    at = starts.select("rank", "depth", "key").join(grouped.select("depth", "key", "conv_id"), ["depth", "key"])
    above = written(at.select(F.col("rank").alias("lo"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")))
    parent = F.when(F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("long")).otherwise(F.col("parent_conv_id"))
    linked = written(nodes.join(above, ["lo", "depth"], "left").withColumn("parent_conv_id", parent))
    children = linked.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    linked = linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))

    weighed = linked.select("*", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    summed = written(ordered(weighed, ["lo"], ["depth"], sums=["saved", "leaf"]).drop("run", "at"))
    until = written(summed.groupBy(F.col("lo").alias("hi")).agg(F.max("saved_sum").alias("saved_to"), F.max("leaf_sum").alias("leaf_to")))
    ends = ends_digests(ranked).join(sequences.select("rank", F.col("len").alias("depth")), "rank").withColumnRenamed("rank", "lo")
    return summed.join(until, "hi").join(written(ends), ["lo", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_to") - F.col("leaf_sum") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_to") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(*rebuilt(named_turns(conversations)))
