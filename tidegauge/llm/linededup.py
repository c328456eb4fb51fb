"""Near-duplicate lines, by a deletion-neighbourhood join; the earliest stays.

A line is its sequence of words (runs of other than ASCII white space). It goes if an earlier line (smaller doc_id, or
earlier in the same document) is equal, or, for lines of at least LEAST words, within one word inserted, deleted or
replaced. The bound is one word whatever the length: lines at two or more edits stay, however long and alike they are. Blank lines stay.

Equal lines meet by a 128-bit hash, and of each distinct line only the first occurrence goes on. Two lines within the bound share
at least one half: lines whose halves (by hash and length) occur nowhere else are done. The others emit their neighbourhood:
themselves and all variants with one word deleted, as hashed keys, but only for deletions that the shared half leaves open.
Equal keys are joined, each row with the earliest of its key, never with all; the texts of such pairs are fetched and their edit
distance is verified.

A line, a half or a variant may be in a third of all rows. Each task therefore combines its rows before they are shuffled, in bounded
memos: a line that it has seen at an earlier place goes at once, of the lines that share a half it sends two, and a variant
that is within one word of an earlier line it holds goes at once. So a key gets a few rows from each task, not one from each document.

Defined results: a null text counts and comes out as empty; rows that repeat a doc_id and its text count as that one document, and
all come out alike; different texts under one doc_id are documents of their own, in the order of a hash of them; rows without
doc_id keep all lines; an empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import marked_texts, private, texts
from tidegauge.llm.windows import BASE, INVERSE, mix

#: Shorter lines only go if an earlier one is equal.
LEAST = 5
#: The kind of a code that stands for the whole line, and what is added to kinds that a task has decided; the place of a line that goes already.
WHOLE, DECIDED, GONE = 4, 8, -2
MEMO = 500_000
#: Keys that a task remembers to combine its rows; and into how many groups the pairs that want one document's lines are dealt.
KEPT, DEAL = 200_000, 16
#: Bytes of lines that are hashed, and rows that are sent, in one go.
SEGMENT, ROWS = 1 << 18, 1 << 15
#: ASCII white space, and a value for each byte.
BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
SYMBOL = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD1342543DE82EF95))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n + 1 powers; those for a segment are kept."""
    if int(base) not in _POWERS or len(_POWERS[int(base)]) <= n:
        p = np.full(max(n, 2 * SEGMENT) + 1, base)
        p[0] = 1
        p = np.cumprod(p, dtype="u8")
        if n > 2 * SEGMENT:
            return p
        _POWERS[int(base)] = p
    return _POWERS[int(base)][: n + 1]


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the hashes in a polynomial, and the powers that shift a part to its start."""
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * _powers(BASE, len(hashes))[:-1], dtype="u8")])
    return total, _powers(INVERSE, len(hashes))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and a hash of each."""
    edge = np.diff((~BLANK[data]).view("i1"), prepend=np.int8(0), append=np.int8(0))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total, down = _sums(SYMBOL[data])
    return begin, mix((total[stop] - total[begin]) * down[begin])


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc_id, v, number of the first line, lines) of about SEGMENT bytes; only a single line may be longer."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for b in batches:
        for doc, text, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw, at, line = text.as_py().encode(), 0, 0
            while doc is not None and at <= len(raw):
                stop = len(raw) if len(raw) - at <= SEGMENT else raw.find(b"\n", at + SEGMENT)
                part = raw[at : stop if stop >= 0 else len(raw)]
                held.append((doc, v, line, part))
                size += len(part)
                at += len(part) + 1
                line += part.count(b"\n") + 1
                if size >= SEGMENT:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def line_rows(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(key, hash, doc_id, v, code) for the lines that aren't blank: WHOLE with the line's key, and its halves' keys if it is long enough.

    A code is the line's number times 16, plus the kind: 0 and 1 are prefixes of n // 2 and (n - 1) // 2 words, 2 and 3
    suffixes, WHOLE the line. All lines of the parts are hashed at once: bytes to words, words to lines and halves.
    """
    joined = b"\n".join([p[3] for p in parts]) + b"\n"
    data = np.frombuffer(joined, "u1")
    breaks = np.flatnonzero(data == 10)
    many = np.fromiter((p[3].count(b"\n") + 1 for p in parts), "i8", len(parts))
    doc, v, before = (np.repeat(np.fromiter((p[i] for p in parts), "i8", len(parts)), many) for i in range(3))
    number = np.arange(len(breaks)) + before - np.repeat(np.cumsum(many) - many, many)

    begin, words = word_hashes(data)
    end = np.searchsorted(begin, breaks)  # words up to each line's end
    n = np.diff(end, prepend=0)
    full = np.flatnonzero(n)
    doc, v, number, end, n = doc[full], v[full], number[full], end[full], n[full]
    start = end - n
    total, down = _sums(words)
    whole = mix((total[end] - total[start]) * down[start] ^ n.astype("u8"))
    lines = [line.split() for line in joined.split(b"\n")]
    exact = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(line)) for line in lines if line), "u8", len(full))
    which = [np.arange(len(full))]
    codes, keys = [16 * number + WHOLE], [whole]
    for kind, (t, suffix) in enumerate(((n // 2, False), ((n - 1) // 2, False), (n // 2, True), ((n - 1) // 2, True))):
        long = np.flatnonzero((n >= LEAST) & ((kind % 2 == 0) | (n % 2 == 0)))  # for odd n both lengths are one
        t = t[long]
        if suffix:
            e = end[long]
            part = mix((total[e] - total[e - t]) * down[e - t] + (2 * t + 1).astype("u8"))
        else:
            s = start[long]
            part = mix((total[s + t] - total[s]) * down[s] + (2 * t).astype("u8"))
        which.append(long)
        codes.append(16 * number[long] + kind)
        keys.append(part)
    at = np.concatenate(which)
    return np.concatenate(keys).view("i8"), exact[at].view("i8"), doc[at], v[at], np.concatenate(codes)


class Combiner:
    """Decides what a task's own rows decide. Its memos are bounded: forgotten keys are only sent more often."""

    def __init__(self) -> None:
        self.lines: dict[tuple[int, int], tuple[int, int, int]] = {}  # key and hash: the earliest place
        self.halves: dict[int, tuple[int, bool]] = {}  # key: a hash, and whether another was sent as well

    def combine(self, key: np.ndarray, h: np.ndarray, doc: np.ndarray, v: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows of line_rows without halves of lines that go. Decided rows are marked, and keyed by their document."""
        lines, halves = self.lines, self.halves
        keep, decided, gone = [], [], set()
        for i, (k, x, d, w, c) in enumerate(zip(key.tolist(), h.tolist(), doc.tolist(), v.tolist(), code.tolist())):
            if c % 16 == WHOLE:
                me, first = (d, w, c), lines.get((k, x))
                if first is None or me < first:
                    if len(lines) >= KEPT:
                        lines.clear()
                    lines[k, x] = me
                else:
                    gone.add((d, w, c // 16))
                    if first == me:  # the row again
                        continue
                    decided.append(i)
            elif gone and (d, w, c // 16) in gone:
                continue
            else:
                other, shared = halves.get(k, (None, False))
                if shared:
                    decided.append(i)
                elif other is None or other != x:
                    if len(halves) >= KEPT:
                        halves.clear()
                    halves[k] = (x, other is not None)
            keep.append(i)
        if decided:
            at = np.array(decided)
            code[at] += DECIDED
            key[at] = mix(doc[at].view("u8")).view("i8")
            h[at] = 0
        return tuple(c[keep] for c in (key, h, doc, v, code))


def signed(k: int) -> int:
    """The number's lowest 64 bits."""
    return (k + (1 << 63)) % (1 << 64) - (1 << 63)


def open_places(n: int, kinds: set[int]) -> tuple[int, int]:
    """The places at which a line of n words may differ from one that shares these halves."""
    low = min((0 if k > 1 else (n - k % 2) // 2) for k in kinds)
    return low, max((n if k < 2 else n - (n - k % 2) // 2) for k in kinds)


def neighbourhood(words: list[bytes], low: int, high: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): the line itself at place -1, and each line with the word at a place from low to high - 1 deleted."""
    n = len(words)
    total, _ = _sums(np.fromiter(map(known.__getitem__, words), "u8", n))
    at = np.arange(low, high)
    cut = total[at] + (total[n] - total[at + 1]) * INVERSE
    keys = np.concatenate([mix(total[n : n + 1] ^ np.uint64(n)), mix(cut ^ np.uint64(n - 1))])
    return np.concatenate([[-1], at]), keys.view("i8")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is inserted, deleted or replaced between the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Variants:
    """The neighbourhoods of a task's lines: what must be sent, and which lines go by an earlier line of the same task."""

    def __init__(self) -> None:
        self.known = _Hashes()
        self.seen: dict[tuple[int, int] | int, tuple[tuple[int, int, int], list[bytes]]] = {}

    def rows(self, me: tuple[int, int, int], words: list[bytes], kinds: set[int]) -> tuple[list[int], list[int]]:
        """(places, keys) of the line me = (doc_id, v, number); the place GONE if it goes.

        Remembered are the whole line by (key, -1), and each variant by (key, place) and, whatever its place, by key. A variant of which an
        earlier one with the same place was sent needn't be sent if its line goes: it can't be the earliest.
        """
        place, key = neighbourhood(words, *open_places(len(words), kinds), self.known)
        place, key, seen = place.tolist(), key.tolist(), self.seen
        gone = False
        if (found := seen.get(key[0])) and found[0] < me and within_one(found[1], words):
            gone = True
        sent = [True] * len(key)
        for i in range(1, len(key)):
            same = seen.get((key[i], place[i]))
            if same and same[0] < me:
                sent[i] = False
                gone = gone or within_one(same[1], words)
            if not gone and (found := seen.get((key[i], -1))) and found[0] < me:
                gone = within_one(found[1], words)
        if len(seen) >= KEPT:
            seen.clear()
        mine = (me, words)
        for i, (p, k) in enumerate(zip(place, key)):
            if sent[i] or not gone:
                for name in ((k, p), k) if p >= 0 else ((k, p),):
                    if name not in seen or me < seen[name][0]:
                        seen[name] = mine
        if not gone:
            return place, key
        out = [i for i in range(len(key)) if sent[i]]
        return [GONE] + [place[i] for i in out], [signed(me[0] * 1000003 ^ me[2])] + [key[i] for i in out]


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, v and lines (array of line numbers) that have an earlier equal or near-equal. docs: doc_id, text and v.

    One plan without branches: lines that are known to go travel along, so nothing is computed or shuffled twice.
    """
    names = ["key", "h", "doc_id", "v", "code"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner()
        for parts in segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in combiner.combine(*line_rows(parts))], names)

    # equal lines but the first place of them; and halves that different lines share
    by_key = Window.partitionBy("key")
    first = F.dense_rank().over(Window.partitionBy("key", "h").orderBy("doc_id", "v", "code"))
    kind = F.col("code") % 16
    told = (
        docs.mapInArrow(find, "key long, h long, doc_id long, v long, code long")
        .repartition("key")
        .withColumn("_r", first).withColumn("_low", F.min("h").over(by_key)).withColumn("_high", F.max("h").over(by_key))
        .where(F.when(kind >= DECIDED, True).when(kind == WHOLE, F.col("_r") > 1).otherwise(F.col("_low") < F.col("_high")))
        .groupBy("doc_id", "v").agg(F.collect_list("code").alias("codes"))
    )

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variants = Variants()
        keys: list[int] = []
        docs_, vs, ats = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, docs_, vs, ats)], ["key", "doc_id", "v", "at"])

        for b in batches:
            for doc, text, v, codes in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("v").to_pylist(), b.column("codes").to_pylist()):
                if not codes:
                    continue
                gone = {c // 16 for c in codes if c % DECIDED == WHOLE}
                halves: dict[int, set[int]] = {}
                for c in codes:
                    if c // 16 not in gone:
                        halves.setdefault(c // 16, set()).add(c % DECIDED)
                lines = text.as_py().encode().split(b"\n") if halves else []
                for i in gone:
                    keys.append(signed(doc * 1000003 ^ i))
                    ats.append(i << 32)
                for i, kinds in halves.items():
                    place, key = variants.rows((doc, v, i), lines[i].split(), kinds)
                    keys += key
                    ats += [i << 32 | p - GONE for p in place]
                docs_ += [doc] * (len(keys) - len(docs_))
                vs += [v] * (len(keys) - len(vs))
                if len(keys) >= ROWS:
                    yield out()
                    keys, docs_, vs, ats = [], [], [], []
        if keys:
            yield out()

    line = F.shiftright("at", 32).alias("line")
    place = (F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)) + GONE).cast("int").alias("place")
    me = F.struct("doc_id", "v", "line").alias("me")
    pairs = (
        docs.join(told, ["doc_id", "v"], "left").select("doc_id", "text", "v", "codes")
        .mapInArrow(vary, "key long, doc_id long, v long, at long")
        .repartition("key")
        .select("key", "doc_id", "v", line, place).select("key", "place", me)
        .withColumn("whole", F.min(F.when(F.col("place") == -1, F.col("me"))).over(by_key))
        .withColumn("cut", F.min(F.when(F.col("place") >= 0, F.col("me"))).over(by_key))
        .withColumn("same", F.min("me").over(Window.partitionBy("key", "place")))
        .select(
            "me",
            F.explode(F.when(F.col("place") == GONE, F.array(F.lit(None))).when(F.col("place") == -1, F.array("cut")).otherwise(F.array("whole", "same"))).alias("other"),
            (F.col("place") == GONE).alias("gone"),
        )
        .where("gone or other < me").distinct()
    )

    # both lines' texts, then their distance; a line that many pairs want is dealt over several rows
    sides = pairs.select("me", "other", "gone", F.explode(F.when(F.col("gone"), F.array("me")).otherwise(F.array("me", "other"))).alias("x"))
    dealt = F.when(F.col("x") == F.col("me"), 0).otherwise(1 + F.pmod(F.xxhash64("me"), F.lit(DEAL))).alias("deal")
    wanted = sides.groupBy("x.doc_id", "x.v", dealt).agg(F.collect_list(F.struct("x.line", "me", "other", "gone")).alias("pairs"))
    lines = F.when(F.exists("pairs", lambda p: ~p["gone"]), F.split("text", "\n")).alias("all")
    said = (
        docs.join(wanted, ["doc_id", "v"], "left")  # outer, as the other joins: then one shuffle of the texts serves all of them
        .select("doc_id", "v", lines, F.explode_outer("pairs").alias("p")).where("p is not null")
        .select("p.me", "p.other", "p.gone", (F.struct("doc_id", "v", "p.line") == F.col("p.me")).alias("mine"),
                F.when(~F.col("p.gone"), F.get("all", F.col("p.line").cast("int"))).alias("words"))
    )

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and within_one(x.encode().split(), y.encode().split()) for x, y in zip(a, b)], dtype=bool)

    both = said.groupBy("me", "other", "gone").agg(F.max(F.when(F.col("mine"), F.col("words"))).alias("a"), F.max(F.when(~F.col("mine"), F.col("words"))).alias("b"))
    near = both.withColumn("near", close("a", "b")).where("gone or near").select("me.doc_id", "me.v", "me.line")
    return near.distinct().groupBy("doc_id", "v").agg(F.collect_list("line").alias("lines"))


def remove_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without dropped lines; n_lines and n_dropped are added. A null text becomes empty."""
    if clash := {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError(f"the input already has the columns {sorted(clash)}")
    lean = marked_texts(texts(docs, text_col=text_col))
    lines = F.split(text_col, "\n")
    doc, v, gone = private(docs, "doc", "v", "gone")
    dropped = dropped_lines(lean).toDF(doc, v, gone)

    @F.pandas_udf("string")
    def without(text: pd.Series, lost: pd.Series) -> pd.Series:
        def keep(t: str, x: np.ndarray | None) -> str:
            if x is None:
                return t
            out = set(x.tolist())
            return "\n".join([line for i, line in enumerate(t.split("\n")) if i not in out])

        return pd.Series([keep(t, x) for t, x in zip(text, lost)], dtype=object)

    if set(docs.columns) == {"doc_id", text_col}:  # the texts as they are shuffled already
        joined = lean.join(dropped, (F.col("doc_id") == F.col(doc)) & (lean["v"] == F.col(v)), "left").drop(lean["v"]).withColumnRenamed("text", text_col)
    else:
        whole = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
        joined = whole.join(dropped, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text_col) == F.col(v)), "left")
    kept = [without(F.col(text_col), F.col(gone)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
