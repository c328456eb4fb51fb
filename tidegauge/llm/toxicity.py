"""Toxicity scores: misspelled lexicon terms by automaton, weighed by the words around them.

Training. From a bounded sample of labelled rows (SAMPLE of them, the smallest by a hash of their id, with one text each) Spark counts in how many toxic and
clean texts each word of 3 to 40 letters, and each word beginning (written with *), occurs. Those in a share of at least LEAST_SHARE of
the toxic texts, and far commoner there than in clean ones, are the lexicon; nothing else limits it. Spark then counts the words around
its hits: those of at most 40 characters that tell toxic from clean texts with hits, a verb of saying, say, or a word of address, get a weight of their own.
The hits in the sample give each row a few features, on which the driver fits a logistic regression.

Scoring. The lexicon is a trie; Levenshtein automata of all its terms run over it at once: a state is a set of (trie node,
edits so far), and states and their successors are made as words ask for them and kept in a bounded table. A word
of a text is looked up in a memo, or run through the automaton once. A hit inside quotation marks is counted apart, and each hit's
context score is its weight times what the words around it weigh. Every whole text is scored; nothing but the text is an input.

Defined results: null and empty texts have the score of a text without hits; a null label is no label, and of several labels of a doc_id the
greatest counts; with labels of one kind only, or without any, all scores are 0; of rows that repeat a doc_id the text with the smallest hash is learned from; repeated rows score alike; an empty table gives no rows;
extra columns stay (in filter_toxic) or are not carried.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import settle, texts

#: At most so many labelled rows are learned from.
SAMPLE = 20_000
#: A term's document frequency in toxic texts, as a share of them, and the least log-ratio of its shares.
LEAST_SHARE, LEAST_RATIO = 0.01, 2.5
#: What must remain of the log-ratio less twice its standard error, so that words seen in a few toxic texts by chance are no terms.
LEAST_BOUND = 1.5
#: Words before and after a hit that make its context.
WINDOW = 8
MEMO, STATES = 600_000, 100_000

#: What must remain of a context word's log-ratio less three times its standard error: there are many such words, and chance favours some.
LEAST_LEAN = 0.3

# Marks that open or close a quotation.
QUOTES = "\"“”„«»‹›"
#: Characters that stand for letters.
LEET = str.maketrans("01345$@", "oieassa")
QUOTE = re.compile(f"[{QUOTES}]")
LETTERS = re.compile(r"[^\W\d_]+")
CORE = re.compile(r"[\w$@]+(?:['’][\w$@]+)*")


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


def edits(term: str) -> int:
    """How many edits a misspelling of the term may have; short terms and beginnings none."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The automata of all terms over their trie."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.beginning: list[str | None] = [None]  # a node may end a term and a beginning
        self.most = [0]
        for term in sorted(weights):
            at, k = 0, edits(term)
            self.most[0] = max(self.most[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.beginning.append(None)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], k)
            (self.beginning if term.endswith("*") else self.term)[at] = term
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.begun: list[float | None] = []  # the weight of the beginning that a state has reached without edits
        self.next: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state's number; a missing letter of the word moves down the trie for one edit more."""
        stack = list(reached)
        while stack:
            node = stack.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < reached.get(child, 99):
                    reached[child] = e
                    stack.append(child)
        key = frozenset(reached.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            exact = (self.beginning[node] for node, e in key if e == 0)
            self.begun.append(next((self.weights[t] for t in exact if t), None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # c is superfluous
            for letter, child in self.children[node].items():
                reach(child, e if letter == c else e + 1)
        return self._state(reached)

    def look(self, word: str) -> tuple[float, float] | None:
        """(weight if spelled right, weight if misspelled) of the best term the word matches, be it as a whole or by its beginning."""
        if len(self.states) > STATES:
            self._fresh()
        at, right = self.start, None
        for c in word:
            to = self.next.get((at, c))
            if to is None:
                to = self.next[at, c] = self._step(at, c)
            at = to
            if not self.states[at]:
                break
            if (begun := self.begun[at]) is not None:
                right = begun if right is None else max(right, begun)
        ends = [(e, self.weights[t]) for node, e in self.states[at] if (t := self.term[node]) and e <= edits(t)]
        exact = [w for e, w in ends if e == 0] + ([] if right is None else [right])
        if exact:
            return (max(exact), 0.0)
        return None if not ends else (0.0, -min((e, -w) for e, w in ends)[1])


class Memo(dict):
    """Token of a text -> hit or None."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        hit = None
        for core in CORE.findall(token.lower()):
            hit = hit or self.lexicon.look(core) or (self.lexicon.look(core.translate(LEET)) if not core.isalpha() else None)
        if len(self) >= MEMO:
            self.clear()
        if len(token) <= 64:
            self[token] = hit
        return hit


FEATURES = 7


def hits_in(words: list[str], memo: Memo) -> list[tuple[int, tuple[float, float]]]:
    return [(i, h) for i, h in enumerate(map(memo.__getitem__, words)) if h]


def around(words: list[str], at: int, hits: set[int]) -> set[str]:
    """The words near the hit that are no hits."""
    low = max(0, at - WINDOW)
    near = {w.strip(".,;:!?\"'“”„«»").lower() for i, w in enumerate(words[low : at + WINDOW + 1], low) if i not in hits}
    return {w for w in near if 0 < len(w) <= 40}


def features(text: str, memo: Memo, context: dict[str, float]) -> list[float]:
    """[any hit, plain, misspelled, in quotation, per 100 words, context for, context against], 0 for a text without hits."""
    words = text.split()
    hits = hits_in(words, memo)
    if not hits:
        return [0.0] * FEATURES
    marks = [m.start() for m in QUOTE.finditer(" ".join(words))]
    starts = list(accumulate((len(w) + 1 for w in words), initial=0)) if marks else []
    at = {i for i, _ in hits}
    plain = wrong = quoted = speaks_for = against = 0.0
    for i, (right, misspelled) in hits:
        inside = bool(marks) and (bisect_left(marks, starts[i]) % 2 == 1 or any(c in words[i] for c in QUOTES))
        lean = sum(context.get(w, 0.0) for w in around(words, i, at)) if context else 0.0
        score = (right + 0.5 * misspelled) * lean
        speaks_for += max(score, 0.0)
        against += max(-score, 0.0)
        quoted += (right + misspelled) if inside else 0.0
        plain += 0.0 if inside else right
        wrong += 0.0 if inside else misspelled
    return [1.0, *map(math.log1p, (plain, wrong, quoted, 100 * len(hits) / len(words), speaks_for, against))]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, toxic and text of at most `rows` labelled rows outside the held-out fifth, one for each doc_id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = texts(docs).join(F.broadcast(known), "doc_id")  # `rows` bounds what is broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text")))  # aggregated before the shuffle, however often a doc_id occurs
    return found.groupBy("doc_id", "toxic").agg(one.alias("one")).select("doc_id", "toxic", "one.text")


def lexicon(rows: DataFrame) -> dict[str, float]:
    """term -> log-ratio of its shares in toxic and clean texts."""

    def count(wanted: frozenset[str] | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[int, Counter] = defaultdict(Counter)
            for f in frames:
                for text, toxic in zip(f["text"], f["toxic"]):
                    words = {w for w in LETTERS.findall(text.lower()) if 3 <= len(w) <= 40}
                    terms = words.union(*map(beginnings, words)) if words else words
                    seen[toxic].update(terms if wanted is None else terms & wanted)
                    seen[toxic][""] += 1
            yield pd.DataFrame([(t, int(k), n) for k, c in seen.items() for t, n in c.items()], columns=["term", "toxic", "n"])

        return run

    schema = "term string, toxic int, n long"
    most = rows.where("toxic = 1").count()
    toxic = rows.where("toxic = 1").mapInPandas(count(None), schema).groupBy("term").agg(F.sum("n").alias("n"))
    frequent = {r["term"]: r["n"] for r in toxic.where(F.col("n") >= max(3, LEAST_SHARE * most)).collect()}  # at most 100 texts' words
    if not frequent:
        return {}
    frequent.pop("", None)
    wanted = frozenset(frequent)
    clean_rows = rows.where("toxic = 0").mapInPandas(count(wanted), schema).groupBy("term").agg(F.sum("n").alias("n"))
    clean = {r["term"]: r["n"] for r in clean_rows.collect()}  # at most the wanted terms
    if "" not in clean:
        return {}
    ratio = {t: math.log((n + 0.5) / (most + 1)) - math.log((clean.get(t, 0) + 0.5) / (clean[""] + 1)) for t, n in frequent.items()}
    error = {t: math.sqrt(1 / (n + 0.5) + 1 / (clean.get(t, 0) + 0.5)) for t, n in frequent.items()}
    kept: dict[str, float] = {}
    for t in sorted(ratio, key=lambda t: (-frequent[t], -len(t), t)):
        if ratio[t] < LEAST_RATIO or ratio[t] - 2 * error[t] < LEAST_BOUND:
            continue
        stem = t.rstrip("*")
        if any(stem.startswith(k[:-1]) for k in kept if k.endswith("*")):
            continue
        if t.endswith("*"):  # a beginning is worth more than its words only if it covers clearly more texts
            covered = max((frequent[w] for w in frequent if not w.endswith("*") and w.startswith(stem)), default=0)
            if frequent[t] < 1.3 * covered:
                continue
        kept[t] = ratio[t]
    return kept


def context_words(rows: DataFrame, terms: dict[str, float]) -> dict[str, float]:
    """word -> weight of the words that, near a hit, tell toxic texts from clean ones that have hits too."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, seen = Memo(Lexicon(terms)), defaultdict(Counter)
        for f in frames:
            for text, toxic in zip(f["text"], f["toxic"]):
                words = text.split()
                at = {i for i, _ in hits_in(words, memo)}
                if at:
                    seen[toxic].update({"", *(w for i in at for w in around(words, i, at))})
        yield pd.DataFrame([(t, int(k), n) for k, c in seen.items() for t, n in c.items()], columns=["term", "toxic", "n"])

    each = rows.select("text", "toxic").mapInPandas(count, "term string, toxic int, n long")
    n = {k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)) for k in (0, 1)}
    both = each.groupBy("term").agg(n[1].alias("bad"), n[0].alias("good"))
    got = {r["term"]: (r["bad"], r["good"]) for r in both.where("bad + good >= 5 or term = ''").collect()}  # words near hits in the sample
    bad, good = got.pop("", (0, 0))
    out = {}
    for word, (x, y) in got.items():
        left = lean(x, bad, y, good) or -lean(y, good, x, bad)
        if abs(left) >= LEAST_LEAN:
            out[word] = left
    return out


def lean(x: int, n: int, y: int, m: int, z: float = 3.0) -> float:
    """By how much, in logs and at z standard errors, x of n is surely a greater rate than y of m; 0 if it isn't.

    The errors are those of Wilson's intervals, which stay right where a word was never seen on one side.
    """
    if not x or not n or not m:
        return 0.0
    low, _ = wilson(x, n, z)
    _, high = wilson(y, m, z)
    more, less = math.log(x / n), math.log((y + 0.5) / (m + 1))
    return max(0.0, more - less - math.hypot(more - math.log(low), math.log(high) - less))


def wilson(x: int, n: int, z: float) -> tuple[float, float]:
    """Wilson's interval of the rate x of n."""
    middle, half = x + z * z / 2, z * math.sqrt(x * (n - x) / n + z * z / 4)
    return (middle - half) / (n + z * z), (middle + half) / (n + z * z)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with an intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    """The lexicon, the words around its hits, and the weights of the intercept and the features; no terms, no scores."""

    terms: dict[str, float]
    context: dict[str, float]
    weights: list[float]

    def logits(self, texts: Iterable[str], memo: Memo) -> list[float]:
        return [self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], features(t, memo, self.context))) for t in texts]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    known = settle(sample(docs, labels, rows))
    terms = lexicon(known)
    if not terms:
        return Model({}, {}, [])
    context = context_words(known, terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(Lexicon(terms))
        for f in frames:
            yield pd.DataFrame({"x": [features(t, memo, context) for t in f["text"]], "toxic": f["toxic"]})

    got = known.select("text", "toxic").mapInPandas(run, "x array<double>, toxic int").toPandas()  # `rows` bounds it
    return Model(terms, context, fit(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float)).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Lexicon(model.terms))
        for b in batches:
            z = model.logits((t.as_py() for t in b.column(1)), memo) if model.terms else []
            scores = [1 / (1 + math.exp(-max(-700, v))) for v in z] or [0.0] * b.num_rows
            cols = [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    model = train(docs, labels)
    if not model.terms:
        return docs

    @F.pandas_udf("boolean")
    def clean(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(Lexicon(model.terms))
        for part in text:
            yield pd.Series([z < 0 for z in model.logits((t or "" for t in part), memo)], dtype=bool)

    return docs.where(clean(F.coalesce(F.col("text"), F.lit(""))))
