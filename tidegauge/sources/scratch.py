"""Tables that an analysis writes for itself: read many times, computed once, deleted when the program ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; with a local master one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidegauge-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _tidy() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to a table that is deleted at the program's end: what is built on it doesn't compute them again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/settled-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_tidy)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
