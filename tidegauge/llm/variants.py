"""Groups spelling variants: each word's distance-one Levenshtein automaton is intersected with tries of all words.

Words and their counts come from JVM functions. The vocabulary is dealt by word ranges into shards of at most SHARD_WORDS
words and SHARD_CHARS characters (a longer word stands alone), however many partitions there are; each shard becomes a compact trie (edges are labelled by
whole strings), a row of a few megabytes. A few tries at a time, of a checked size, are broadcast; every word is walked
depth-first through every one of them. The automaton has two kinds of states: `i` characters matched without an edit, and
`i` matched after the one edit. A near word leaves the path of the word itself at one place, the end of their common
prefix, so there the edit (insert, delete or replace) is decided, and what follows has to match exactly. Subtrees whose
word lengths can't fit are left out, and a shard of another range ends at its root. Each word is emitted once per shard
that holds near words, with their number and the best of them; these rows are reduced by word.

Memory per task is one trie; what is broadcast at once is at most SHARDS_AT_ONCE tries. Words are distinct, so no key is
hot: repeated occurrences are counted before any shuffle.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string in the draw of `noisy_words`;
rows that repeat a doc_id are documents of their own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import partitions, written

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
SHARD_WORDS, SHARD_CHARS, SHARDS_AT_ONCE, SPLITS = 120_000, 4 << 20, 8, 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEADS = struct.Struct("<5q")


def lower_ascii(x: Column) -> Column:
    return F.translate(x, _UPPER, _UPPER.lower())


def noisy_words(docs: DataFrame, least: int = LEAST_LENGTH, one_in: int = 31, text_col: str = "text") -> DataFrame:
    """word, one row per occurrence: runs of letters, A-Z lowered; where crc32 of `<doc_id>:<run>` is divisible by
    one_in, the code point at that crc32 modulo the run's length is left out. Only words of `least` code points or more."""
    runs = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))
    # all of its characters are below U+0100, so lengths in UTF-16 are lengths in code points
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    run = run.select("d", lower_ascii(F.col("run")).alias("run"))
    hashed = run.select("run", F.crc32(F.concat_ws(":", "d", "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2))
    return hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- compact tries -----------------------------------------------------------------------------------------------


def build(words: list[str], counts: list[int]) -> bytes:
    """The trie of sorted distinct words. Nodes are numbered breadth-first, so the children of a node are neighbours.

    Per node: the label of the edge to it, its number of children, its word's count (0: none) and the least and the
    greatest length of the words below it.
    """
    labels, sizes, ends, least, most = [""], [], [], [], []
    level = [(0, len(words), 0)]
    while level:
        below = []
        for lo, hi, depth in level:
            here = lo if len(words[lo]) == depth else -1
            ends.append(counts[lo] if here >= 0 else 0)
            lengths = [len(w) for w in words[lo:hi]]
            least.append(min(lengths))
            most.append(max(lengths))
            at, kids = lo + (here >= 0), 0
            while at < hi:
                c = words[at][depth]
                to = bisect_left(words, words[at][:depth] + chr(ord(c) + 1), at, hi)
                a, b, k = words[at], words[to - 1], depth + 1
                stop = min(len(a), len(b))
                while k < stop and a[k] == b[k]:
                    k += 1
                labels.append(a[depth:k])
                below.append((at, to, k))
                at, kids = to, kids + 1
            sizes.append(kids)
        level = below
    text = "".join(labels)
    numbers = [np.array(x, "<i8") for x in (list(map(len, labels)), sizes, ends, least, most)]
    raw = text.encode("utf-8", "surrogatepass")
    return _HEADS.pack(len(labels), len(raw), *([0] * 3)) + b"".join(x.tobytes() for x in numbers) + raw


class Trie:
    """A built trie, unpacked for walking."""

    def __init__(self, packed: bytes):
        n, size, *_ = _HEADS.unpack_from(packed)
        numbers = np.frombuffer(packed, "<i8", 5 * n, _HEADS.size).reshape(5, n)
        text = packed[_HEADS.size + 40 * n :][:size].decode("utf-8", "surrogatepass")
        ends = np.cumsum(numbers[0])
        self.labels = [text[a:b] for a, b in zip((ends - numbers[0]).tolist(), ends.tolist())]
        sizes = numbers[1]
        first = 1 + np.cumsum(sizes) - sizes
        self.first = first.tolist()
        heads = "".join([s[:1] for s in self.labels[1:]])
        self.heads = [heads[a - 1 : a - 1 + k] for a, k in zip(self.first, sizes.tolist())]
        self.ends, self.least, self.most = (x.tolist() for x in numbers[2:])

    def _exact(self, node: int, word: str, at: int) -> int:
        """The count of the word that continues from the node by word[at:], 0 if none does."""
        labels, heads, first, size = self.labels, self.heads, self.first, len(word)
        while at < size:
            k = heads[node].find(word[at])
            if k < 0:
                return 0
            node = first[node] + k
            if not word.startswith(labels[node], at):
                return 0
            at += len(labels[node])
        return self.ends[node]

    def near(self, word: str) -> list[tuple[str, int]]:
        """The words at exactly one inserted, deleted or replaced code point from the word, with their counts."""
        labels, heads, first, least, most = self.labels, self.heads, self.first, self.least, self.most
        exact, starts = self._exact, word.startswith
        found: list[tuple[str, int]] = []
        size, node, at = len(word), 0, 0
        if least[0] > size + 1 or most[0] < size - 1:
            return found
        while True:
            if at == size - 1 and self.ends[node]:
                found.append((word[:at], self.ends[node]))
            head = word[at] if at < size else ""
            after = word[at + 1] if at + 1 < size else ""
            here = -1
            for k, c in enumerate(heads[node]):
                child = first[node] + k
                if c == head:
                    here = child
                    continue
                low, high = least[child], most[child]
                rest = labels[child][1:]
                if head and low <= size <= high and (starts(rest, at + 1) if rest else after in heads[child]) and (n := exact(child, word, at + 1 + len(rest))):
                    found.append((f"{word[:at]}{c}{word[at + 1 :]}", n))
                if low <= size + 1 <= high and (starts(rest, at) if rest else head in heads[child]) and (n := exact(child, word, at + len(rest))):
                    found.append((f"{word[:at]}{c}{word[at:]}", n))
                if c == after and low <= size - 1 <= high and starts(rest, at + 2) and (n := exact(child, word, at + 2 + len(rest))):
                    found.append((word[:at] + word[at + 1 :], n))
            if here < 0:
                return found
            label = labels[here]
            if starts(label, at):
                node, at = here, at + len(label)
                continue
            k, stop = 1, min(len(label), size - at)
            while k < stop and label[k] == word[at + k]:
                k += 1
            # the label leaves the word at k: the edit is there
            edge, c, rest, low, high = at + k, label[k], label[k + 1 :], least[here], most[here]
            if edge < size and low <= size <= high and starts(rest, edge + 1) and (n := exact(here, word, edge + 1 + len(rest))):
                found.append((f"{word[:edge]}{c}{word[edge + 1 :]}", n))
            if low <= size + 1 <= high and starts(rest, edge) and (n := exact(here, word, edge + len(rest))):
                found.append((f"{word[:edge]}{c}{word[edge:]}", n))
            if edge + 1 < size and c == word[edge + 1] and low <= size - 1 <= high and starts(rest, edge + 2) and (n := exact(here, word, edge + 2 + len(rest))):
                found.append((word[:edge] + word[edge + 1 :], n))
            return found


_TRIES: dict[str, Trie] = {}


def _trie(name: str, packed: Broadcast) -> Trie:
    """The worker's trie, kept until another is asked for; the name is that of one broadcast alone."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(packed.value)
    return _TRIES[name]


def tries(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """first (word) and trie, one row per shard, from word and n.

    Words are dealt by split words, a shard's worth of words apart as far as a sample of SPLITS words per shard tells (the driver gets their
    first letters); a range that holds more than a shard becomes several.
    """
    total = vocabulary.agg(F.count("*"), F.sum(F.length("word"))).first()
    shards = max(1, -(-total[0] // shard_words), -(-(total[1] or 0) // shard_chars))
    sample = vocabulary.orderBy(F.xxhash64("word")).limit(SPLITS * shards if shards > 1 else 0).select(F.substring("word", 1, 64)).collect()
    heads = sorted(r[0] for r in sample)
    splits = [heads[k * len(heads) // shards] for k in range(1, shards)] if heads else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = pa.array([bisect_right(splits, w) for w in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, b.column(0), b.column(1)], ["shard", "word", "n"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))
        firsts, packed, at = [], [], 0
        while at < len(rows):
            end, chars = at, 0
            while end < len(rows) and end - at < shard_words and (end == at or chars + len(rows[end][0]) <= shard_chars):
                chars += len(rows[end][0])
                end += 1
            words, counts = zip(*rows[at:end])
            firsts.append(words[0])
            packed.append(build(list(words), list(counts)))
            at = end
        return pa.table({"first": pa.array(firsts, pa.string()), "trie": pa.array(packed, pa.binary())})

    dealt = vocabulary.select("word", "n").mapInArrow(deal, "shard int, word string, n long")
    return written(dealt.groupBy("shard").applyInArrow(pack, "first string, trie binary"))


def nearest(vocabulary: DataFrame, shards: DataFrame, at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """word, n_near, best (of greatest count, the first in code-point order) and best_n, for words that have near words."""
    spark = vocabulary.sparkSession
    firsts = sorted(r.first for r in shards.select("first").collect())  # one short row per shard
    parts = []
    for g in range(0, len(firsts), at_once):
        group = firsts[g : g + at_once]
        # each shard is a broadcast of its own, so a worker holds the one that it walks
        held = [spark.sparkContext.broadcast(bytes(r.trie)) for r in shards.where(F.col("first").isin(group)).collect()]

        def walk(trie: Broadcast):
            name = uuid.uuid4().hex

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                near = _trie(name, trie).near
                for b in batches:
                    rows: list[tuple] = []
                    for w in b.column(0).to_pylist():
                        if found := near(w):
                            best, n = min(found, key=lambda x: (-x[1], x[0]))
                            rows.append((w, len(found), n, best))
                    if rows:
                        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["word", "n_near", "best_n", "best"])

            return run

        one = [vocabulary.select("word").mapInArrow(walk(trie), "word string, n_near long, best_n long, best string") for trie in held]
        whole = one[0]
        for more in one[1:]:
            whole = whole.union(more)
        parts.append(written(whole))
        for trie in held:
            trie.unpersist()
    if not parts:
        return vocabulary.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit("").alias("best")).limit(0)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    reduced = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b"))
    return reduced.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def rooted(forms: DataFrame, hops: int) -> DataFrame:
    """word and root from (word, form): forms are followed to the last one, twice as far in each round, `hops` at least."""
    at, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < hops:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("last"))
        at = at.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"))
        reach *= 2
        if reach >= 4:  # a plan reads its table `reach` times
            at = written(at)
    return at


def grouped(vocabulary: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n for a vocabulary of word and n."""
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    vocabulary = written(vocabulary.select("word", "n"))
    near = nearest(vocabulary.repartition(partitions(vocabulary.sparkSession), "word"), tries(vocabulary, shard_words))
    enough = F.col("best_n") >= times * F.col("n")
    out = written(
        vocabulary.join(near, "word", "left").select(
            "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best_n")).alias("form_n"),
        )
    )
    # each form is `times` as frequent as its word, so counts bound the way to a root
    most, fewest = out.where("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    hops = 0
    while most and fewest * times ** (hops + 1) <= most:
        hops += 1
    roots = rooted(out.where(F.col("form").isNotNull()), hops)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    return grouped(counted(noisy_words(docs)))
