from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns
        ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        if name in ("line_dedup", "pii"):
            assert ids(after) == ids(before) and after.where("n_chars <> length(text)").count() == 0
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_stages_on_odd_rows(spark):
    """Nulls in all columns, repeated rows, an empty text, clashing names; and an empty table. Clean documents stay."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert {"doc_id", "toxic"} <= set(labels.columns)
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(9_000_001, words(1), "x", 1), (9_000_001, words(1), "x", 1), (9_000_002, None, None, None), (9_000_003, "", "y", 2), (None, words(4), None, 3), (9_000_005, words(5), "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
        got = sorted((r["doc_id"] or 0, r["text"] or "") for r in after.collect())
        want = [(i or 0, t or "") for i, t, _, _ in rows]
        if name == "simhash":  # both empty texts are one group
            want = [w for w in want if w[0] != 9_000_003]
        assert got == sorted(want), name
        assert stage(spark, docs.where("doc_id < 0"), DATA).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(packed) == 6 and len({r["sequence_id"] for r in packed}) == 1
