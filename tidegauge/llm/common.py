"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property, as a regex class body.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: Rows of a batch that a Python worker gets in the pipeline.
BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, a null text as the empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def marked_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and v, a hash of the text: rows that repeat a doc_id with another text differ in v."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("v"))


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them from clashing with a column of df."""
    taken = {c.lower() for c in df.columns}
    head = "_"
    while any((head + n).lower() in taken for n in names):
        head += "_"
    return [head + n for n in names]


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, as Spark has made it from spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidegauge-"))  # one process has one temporary folder
    return sc.getCheckpointDir()


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here are deleted at its end: its result is kept elsewhere."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names."""
    _shared_folder(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.checkpoint()


def shared_path(spark: SparkSession, ending: str) -> str:
    """A path in that folder that nothing uses yet."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}.{ending}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in that folder: smaller than a checkpoint, and Spark knows its size."""
    path = shared_path(df.sparkSession, "parquet")
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """At most BATCH rows go to a Python worker at once, from now on: texts are long, and both sides hold a batch several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:  # not positive: without limit
        spark.conf.set(key, str(BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
