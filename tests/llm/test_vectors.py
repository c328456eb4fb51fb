from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import crosspolytope, impact

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def table(spark, n=400, dim=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows is one vector
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    rows += [(n, None, 0, 0.0), (n + 1, [], 0, 0.0), (n + 2, [float("nan")] * dim, 0, 0.0), (n + 3, [None] * dim, 0, 0.0), (n + 4, [float("inf")] * dim, 0, 0.0)]
    return spark.createDataFrame(rows, SCHEMA), x.astype("f8")


def expected(scores, ids, own, k=5):
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != own][:k]


@pytest.mark.parametrize("blocks", [(8192, 1 << 20), (64, 400)])
def test_exact_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(impact, "CANDIDATES", blocks[0])
    monkeypatch.setattr(impact, "QUERY_BYTES", blocks[1])
    df, x = table(spark)
    ids, y = np.arange(len(x)), np.floor(256 * x).astype("i8")
    got = impact.top_k(df, F.col("vec_id") % 50 == 0).collect()
    for q in range(0, len(x), 50):
        mine = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == expected(y @ y[q], ids, q)


def test_the_scan_stops_early_and_right():
    r = np.random.default_rng(2)
    x = r.integers(-60, 60, (3000, 24))
    index = impact.Index(np.arange(3000), x)
    for q in range(0, 3000, 111):
        assert index.search(q, x[q], 7) == [(i, s) for i, s in expected(x @ x[q], np.arange(3000), q, 7)]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0.0), (7, [0.0, 1.0], 0, 0.0), (9, [1.0, 1.0, 1.0], 0, 0.0)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in impact.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 7, 0)]
    assert impact.top_k(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert crosspolytope.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("shard, block", [(16384, 1 << 20), (150, 400)])
def test_nearest_neighbours(spark, monkeypatch, shard, block):
    monkeypatch.setattr(impact, "QUERY_BYTES", block)
    df, x = table(spark, 600)
    zero = spark.createDataFrame([(5000, [0.0] * 16, 0, 0.0)], SCHEMA)
    other = spark.createDataFrame([(6000 + i, [float(i), 1.0], 0, 0.0) for i in range(40)], SCHEMA)  # another dimension
    got = crosspolytope.nearest(df.union(zero).union(other), F.col("vec_id") % 50 == 0, shard=shard).collect()
    norm = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, len(x), 50):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        scores = norm @ norm[q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        np.testing.assert_allclose([r["score"] for r in mine], scores[[r["vec_id"] for r in mine]], atol=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        exact = expected(np.round(scores, 12), np.arange(len(x)), q)
        hit += len({i for i, _ in exact} & {r["vec_id"] for r in mine})
        total += 5
    assert hit / total >= 0.9
    assert {(r["query_id"] < 6000) == (r["vec_id"] < 6000) for r in got} == {True}


@pytest.mark.parametrize("n, planted, least, share", [(2000, 0, 0.9, 0.2), (2000, 5, 0.98, 0.2)])
def test_recall_and_scores_against_brute_force(n, planted, least, share):
    """64 dimensions. Random vectors have no near neighbours (the fifth best cosine is about 0.35); planted ones about 0.8."""
    r = np.random.default_rng(6)
    x = crosspolytope.unit(r.normal(size=(n, 64)))
    asked = np.arange(0, n, 20)
    for q in asked if planted else ():
        x[q + 1 : q + 1 + planted] = crosspolytope.unit(x[q] + 0.09 * r.normal(size=(planted, 64)))
    scores = x[asked] @ x.T
    want = np.argpartition(-scores, 6, axis=1)[:, :6]
    got = list(crosspolytope.Shard(x, crosspolytope.TABLES).search(x[asked], crosspolytope.PROBES, 6))
    recall = np.mean([len(set(w.tolist()) & set(at.tolist())) / 6 for w, (at, _, _) in zip(want, got)])
    scored = np.mean([k for _, _, k in got]) / n
    print(recall, scored)
    assert recall >= least and scored <= share


def test_rows_that_repeat_a_query(spark):
    """A repeated query row is one query; its answer is whole, and never itself."""
    df, x = table(spark, 60)
    again = spark.createDataFrame([(0, x[0].tolist(), 0, 0.0), (0, x[0].tolist(), 0, 0.0)], SCHEMA)
    for search in (impact.top_k, crosspolytope.nearest):
        plain, twice = (sorted(map(tuple, search(d, F.col("vec_id") == 0).collect())) for d in (df, df.union(again)))
        assert plain == twice and [r[1] for r in plain] == [1, 2, 3, 4, 5] and len({r[2] for r in plain}) == 5


def test_all_of_few_candidates_and_all_ties(spark):
    few = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(8)], 0, 0.0) for i in range(4)], SCHEMA)
    assert sorted((r["query_id"], r["vec_id"]) for r in crosspolytope.nearest(few, F.col("vec_id") < 2).collect()) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3)]
    ties = spark.createDataFrame([(i, [2.0**i, 2.0**i, 0.0], 0, 0.0) for i in range(30)], SCHEMA)  # one direction, thirty classes
    assert [r["vec_id"] for r in crosspolytope.nearest(ties, F.col("vec_id") == 7).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_components_of_any_size(spark):
    wide = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [0.0, -3e300])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in crosspolytope.nearest(wide, F.col("vec_id") == 0).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.5**0.5, 3: -(0.5**0.5)}, abs=1e-15)


def test_bounds_of_large_integers_are_exact():
    r = np.random.default_rng(8)
    x = r.integers(-(2**29), 2**29, (500, 8))
    index = impact.Index(np.arange(500), x)
    for q in range(0, 500, 61):
        assert index.search(q, x[q], 5) == [(i, int(s)) for i, s in expected(x @ x[q], np.arange(500), q, 5)]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(10, 24))
    np.testing.assert_allclose(np.linalg.norm(crosspolytope.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))


def test_integers_of_any_size(spark):
    """Scores that fit a long are given, whatever stands beside them; products are exact."""
    huge = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1e8, 0.0]), (3, [0.0, 1e300]), (4, [-1e300, 0.0]), (5, [2.0**40 + 1, 0.25])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in huge], SCHEMA.replace("float", "double"))
    y = {i: [int(256 * int(v)) if abs(v) >= 2**52 else int(np.floor(256 * v)) for v in vec] for i, vec in huge}
    for q, without, k in ((0, (), 4), (5, (2, 3), 2)):
        found = sorted(((sum(a * b for a, b in zip(y[q], y[i])), i) for i in y if i not in (q, *without)), key=lambda x: (-x[0], x[1]))
        got = impact.top_k(df.where(~F.col("vec_id").isin(*without)), F.col("vec_id") == q, k=k).orderBy("rank").collect()
        assert [(r["score"], r["vec_id"]) for r in got] == found[:k]
    with pytest.raises(Exception, match="CAST_OVERFLOW|OVERFLOW"):
        impact.top_k(df, F.col("vec_id") == 3, k=1).collect()


def test_large_random_integers():
    r = np.random.default_rng(8)
    x = np.array([[int(v) << int(k) for v, k in zip(row, shift)] for row, shift in zip(r.integers(-99, 99, (400, 6)), r.integers(0, 90, (400, 6)))], dtype=object)
    index = impact.Index(np.arange(400), x)
    for q in range(0, 400, 37):
        scores = [sum(a * b for a, b in zip(row, x[q])) for row in x.tolist()]
        want = sorted(((i, s) for i, s in enumerate(scores) if i != q), key=lambda p: (-p[1], p[0]))[:5]
        assert index.search(q, x[q], 5) == want
