"""Spelling variants against a plain search of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidegauge.llm import variants
from tidegauge.llm.queries import op11_spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def apart_by_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int], times: int = 10) -> dict[str, tuple]:
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(docs) -> dict[str, int]:
    found: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def rows(df) -> dict[str, tuple]:
    return {r.word: tuple(r) for r in df.select(*COLUMNS).collect()}


def test_walks_find_what_a_search_of_all_words_finds():
    r = random.Random(3)
    for _ in range(120):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 60))})
        counts = [r.randint(1, 9) for _ in words]
        trie = variants.Trie(variants.build(words, counts))
        for w in words + ["".join(r.choice("abéz") for _ in range(r.randint(0, 6))) for _ in range(15)]:
            assert sorted(trie.near(w)) == sorted((v, n) for v, n in zip(words, counts) if apart_by_one(w, v))


@pytest.mark.parametrize("shard_words", [7, 10_000])
def test_groups_are_the_same_in_any_number_of_shards(spark, shard_words):
    r = random.Random(11)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(4, 7))): int(10 ** r.uniform(0.4, 5)) for _ in range(150)}
    words |= {"chained": 90_000, "chaine": 9_000, "chain": 900, "chai": 90, "cha": 9, "x" * 9000: 50, "x" * 8999 + "y": 3}
    words |= {"équipage": 400, "equipage": 40, "équipages": 4}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = rows(variants.grouped(vocabulary, shard_words=shard_words))
    assert got == plain(words)
    assert got["cha"][1:3] == ("chai", "chained")


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = {"abcdefg": 1, "abcdefz": 50, "abcdefé": 50, "abcdef": 50}
    got = rows(variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got["abcdefg"] == ("abcdefg", "abcdef", "abcdef", 1, 3, 50)


def test_documents_of_every_kind(spark, make_docs):
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 10))) for _ in range(30)]
    prose = lambda n: " ".join(r.choice(stems) + r.choice(["", "", "s", "-", "1"]) for _ in range(n))
    texts = [None, "", "short words only", "ABCDEFGH abcdefgh Abcdefgh", "z" * 30_000, "z" * 30_000, "ÀÉÎÕÜÑß×÷ ÀÉÎÕÜÑß×÷ àéîõüñß"] + [prose(r.randint(1, 300)) for _ in range(60)]
    texts += [(7, "abcdefgh abcdefgh"), (7, "abcdefgh abcdefgh"), (None, "nobodysdoc nobodysdoc")]
    df = make_docs(texts)
    counts = plain_counts([(d.doc_id, d.text) for d in df.collect()])
    assert len(counts) > 40 and rows(variants.spelling_variants(df)) == plain(counts)


def test_no_words(make_docs):
    assert rows(variants.spelling_variants(make_docs([None, "", "a b"]))) == {}
    assert rows(variants.spelling_variants(make_docs(["a"]).limit(0))) == {}


def test_the_query_reads_whole_tables(spark, tmp_path, make_docs):
    df = make_docs(["Wondrous wondrous wondrous wondros", "wondros wondrous", None] + ["wondrous " * 30])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op11_spelling_variants(spark, str(tmp_path))) == plain(plain_counts([(d.doc_id, d.text) for d in df.collect()]))
