"""The trie of beginnings against one that is built turn by turn."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import prefixtrie
from tidegauge.llm.ordering import ordered
from tidegauge.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, rank int, key string, len double"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows) -> list[tuple]:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, order, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                below[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        n, size = len(members[node]), len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + (n - 1) * size
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def talk(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], SCHEMA).repartition(3)

    return make


def random_rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in [*range(-7, 30), 100, 101, 104, 1003]:
        if r.random() < 0.2:
            continue
        for turn in range(r.choice([1, 2, 3, 9, 12, 20])):
            rows.append((c, turn, "user" if turn % 2 == 0 else r.choice(["assistant", None]), r.choice(["ja", "nö", "", None, "yes"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(talk, seed):
    rows = random_rows(seed)
    assert found(prefixtrie.rebuilt_trie(talk(rows))) == plain(rows)


def test_odd_rows(talk):
    rows = [
        (10, None, "user", "first"), (10, 2, None, None), (10, 1, "user", "second"), (10, 1, "user", "second"), (10, 1, "user", "tied"),
        (None, 0, "user", "nobody's"), (11, 0, "user", "alone"), (12, 5, "user", "x" * 100_000), (13, 5, "user", "x" * 100_000), (14, -3, "", ""),
    ]
    rows += [(500, i, "user", f"t{i % 3}") for i in range(700)]  # one conversation holds most rows
    rows += [(c, i, "u", "same") for c in range(600, 640) for i in range(20)]  # and many are alike
    assert found(prefixtrie.rebuilt_trie(talk(rows))) == plain(rows)


def test_many_copies_need_more_than_one_chunk_of_ends(talk, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    monkeypatch.setattr(prefixtrie, "SPREAD", 4)
    rows = [(c, i, "u", f"{i}") for c in range(0, 80, 5) for i in range(14)] + [(c, 0, "u", "") for c in range(81, 140)]
    assert found(prefixtrie.rebuilt_trie(talk(rows))) == plain(rows)


def test_no_conversations(talk):
    assert found(prefixtrie.rebuilt_trie(talk([]))) == []
    assert found(prefixtrie.rebuilt_trie(talk([(None, 1, "u", "x")]))) == []


def test_only_turnless_ones(talk):
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert found(prefixtrie.rebuilt_trie(talk([(c, 0, "u", "x")]))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == plain([(c, 0, "u", "x")])


def test_query(spark, tmp_path, talk):
    rows = random_rows(9)
    talk(rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(op13_prefix_trie(spark, str(tmp_path))) == plain(rows)


def test_numbering_carries_over_partitions(spark):
    rows = [(7, i, 1) for i in range(50)] + [(k, 0, 2) for k in range(20)]
    df = spark.createDataFrame(rows, "run long, at long, s0 long")
    got = sorted((x[0], x[1], x[2], x[3], x[4], x[5]) for x in ordered(df.withColumnsRenamed({"run": "a", "at": "p"}), ["a"], ["p"], sums=["s0"]).select("a", "p", "s0", "run", "at", "s0_sum").collect())
    keys = sorted({k for k, _, _ in rows})
    want, total, at = [], 0, defaultdict(int)
    for a, p, s in sorted(rows):
        total += s
        want.append((a, p, s, keys.index(a) + 1, at[a], total))
        at[a] += 1
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert sorted(w[5] for w in want) == sorted(g[5] for g in got)
