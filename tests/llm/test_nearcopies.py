from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from tidegauge.llm import nearcopies, simhash


def similarity(a, b):
    x, y = (set(simhash.shingles(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def planted(r, n):
    """(text, near copy) pairs of 60 to 400 words with similarities of 0.5 to 1."""
    vocabulary = [f"w{i}" for i in range(5000)]
    for _ in range(n):
        words = r.choices(vocabulary, k=r.randint(60, 400))
        copy = list(words)
        for at in r.sample(range(len(words)), r.randint(1, max(1, len(words) // 30))):
            copy[at] = "changed"
        yield " ".join(words), " ".join(copy)


def test_planted_near_copies_go(make_docs):
    """Recall by similarity; and what isn't alike stays."""
    pairs = list(planted(random.Random(3), 600))
    docs = make_docs([t for p in pairs for t in p])
    kept = {r[0] for r in corpus_pipeline.drop_near_copies(docs.sparkSession, docs, "").select("doc_id").collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    gone: dict[int, list[bool]] = {}
    for i, p in enumerate(pairs):
        s = similarity(*p)
        if s < 0.8:
            assert 2 * i + 1 in kept
        else:
            gone.setdefault(int(20 * s), []).append(2 * i + 1 not in kept)
    recall = {k / 20: (round(float(np.mean(v)), 3), len(v)) for k, v in sorted(gone.items())}
    print(recall)
    assert min(n for k, (_, n) in recall.items() if k < 0.95) > 20
    assert recall[0.8][0] >= 0.9 and recall[0.85][0] >= 0.97 and recall[0.9][0] >= 0.99, recall


@pytest.mark.parametrize("many, hot, load", [(512, 4096, 1 << 20), (2, 4, 600)])
def test_large_groups_and_tiles(make_docs, monkeypatch, many, hot, load):
    for k, v in (("MANY", many), ("HOT", hot), ("LOAD", load)):
        monkeypatch.setattr(nearcopies, k, v)
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(100)]
    texts = []
    for i in range(40):  # each has one word changed, at most 10 of about 101 shingles differ
        texts.append(" ".join(w if j != 2 * i else "x" for j, w in enumerate(base)))
    texts += [None, "", " \n", "one two", "One  two", texts[3], "other words than those"]
    docs = make_docs(texts)
    kept = sorted(r[0] for r in nearcopies.first_of_group(docs, 5).select("doc_id").collect())
    assert kept == [0, 40, 43, 46]


def test_exact_links():
    r = np.random.default_rng(5)
    sets = [np.unique(r.choice(60, r.integers(1, 60)).astype("u8")) for _ in range(80)]
    sets += [np.unique(np.append(s[1:], np.uint64(99))) for s in sets] + [np.zeros(0, "u8")]
    ids = np.arange(len(sets))
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    want = [(i, j) for i in ids for j in ids[:i] if jaccard(sets[i], sets[j]) >= 0.8]
    groups = lambda e: set(zip(*map(np.ndarray.tolist, nearcopies.forest(*np.array(e).T))))
    assert groups(want) == groups(list(zip(*nearcopies.alike(sets, ids, 0.8))))
