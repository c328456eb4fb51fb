"""The rows that the pipeline's stages hand to a Python worker at once."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import pytest

from tidegauge.llm.common import BATCH, small_batches

DATA, KEY = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"


def most(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return max(r[0] for r in spark.range(0, 3000, 1, 1).mapInArrow(run, "n long").collect())


@pytest.fixture
def setting(spark):
    before = spark.conf.get(KEY)
    yield
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "packing"])
def test_stages_bound_batches(spark, setting, name):
    spark.conf.set(KEY, "10000")
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert most(spark) == BATCH


@pytest.mark.parametrize(("given", "got"), [("0", BATCH), ("-1", BATCH), ("64", 64)])
def test_a_lower_bound_stays(spark, setting, given, got):
    spark.conf.set(KEY, given)
    small_batches(spark)
    assert most(spark) == got
