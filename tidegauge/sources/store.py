"""Parquet storage of candles, derived frames and runs."""

from __future__ import annotations

import json
import logging
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tidegauge.sources.candles import CANDLE_SCHEMA, KEY, closed_only


def keep_last(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row per (symbol, interval, open_time): the one that came in last; of those that came in together the one with most volume, then the greatest."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(seq), *(F.desc_nulls_last(c) for c in ("close_time", "volume", "close", "high", "low", "open")))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Conflict(Exception):
    """Another writer has committed the version that this one was to become."""


class Manifest:
    """Which files of a candle store are live: one JSON file per version under `_manifest`, never changed once it is there.

    A version maps partitions, `symbol=../interval=../month=..`, to their files. A commit moves a new file to the name of the next version, which
    fails if that version exists, so of two writers one has to start again. Readers list versions and read the last one: they see
    a commit whole or not at all, and the files of the version they read stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = lambda: jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _file(self, version: int):
        return self._path(f"{self.root}/_manifest/{version:012d}.json")

    def version(self) -> int:
        """The last version, 0 if nothing was ever stored."""
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def live(self, version: int | None = None) -> dict[str, list[str]]:
        """partition -> its files, as paths below the root."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, files: dict[str, list[str]]) -> None:
        """Makes files the given version; Conflict if there is one already."""
        waiting = self._path(f"{self.root}/_manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(waiting, False)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context().rename(waiting, self._file(version), none)
        except Exception as e:
            self._fs.delete(waiting, False)
            if self._fs.exists(self._file(version)):
                raise Conflict(f"version {version} of {self.root} is another writer's") from e
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep`, and the files that none of these names: how many went. For times without writers and old readers."""
        last = self.version()
        kept = {f for v in range(max(1, last - keep + 1), last + 1) for files in self.live(v).values() for f in files}
        gone = 0
        found = self._fs.listFiles(self._path(self.root), True)
        base = self._fs.makeQualified(self._path(self.root)).toString()
        while found.hasNext():
            path = found.next().getPath()
            name = path.toString()[len(base) + 1 :]
            old = name.startswith("_manifest/") and (not name.endswith(".json") or int(path.getName()[:-5]) <= last - keep)
            if old or (not name.startswith("_manifest/") and name not in kept):
                self._fs.delete(path, False)
                gone += 1
        return gone

    def read(self, partitions: set[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the live files, of some partitions or all."""
        schema = CANDLE_SCHEMA + ", ingest_seq long"
        files = [f"{self.root}/{f}" for p, names in self.live(version).items() if partitions is None or p in partitions for f in names]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)


def _month(time: str = "open_time") -> Column:
    return F.date_format(time, "yyyy-MM")


def _partition() -> Column:
    return F.concat(F.lit("symbol="), F.col("symbol"), F.lit("/interval="), F.col("interval"), F.lit("/month="), _month())


def read_candles(spark: SparkSession, root: str, symbols: list[str] | None = None, interval: str | None = None) -> DataFrame:
    """The stored candles of the last version, from the files of the partitions asked for alone; none if nothing is stored."""
    wanted = None if symbols is None else {s.upper() for s in symbols}
    manifest = Manifest(spark, root)
    version = manifest.version()

    def asked(partition: str) -> bool:
        symbol, kind, _ = re.fullmatch("symbol=(.*)/interval=([^/]*)/month=([^/]*)", partition).groups()
        return (wanted is None or symbol in wanted) and (interval is None or kind == interval)

    return manifest.read({p for p in manifest.live(version) if asked(p)}, version)


def upsert(spark: SparkSession, root: str, new: DataFrame, seq: int, tries: int = 5) -> int:
    """Stores the closed rows of `new` over stored rows of the same key; only the months that they are in are written again. Returns the version.

    The merged rows go to new files, which count from the commit on; a writer that comes second merges again with what the first has stored.
    """
    new = closed_only(new).withColumn("ingest_seq", F.lit(seq).cast("long"))
    touched = {r[0] for r in new.select(_partition().alias("p")).distinct().collect()}  # a row per month written
    manifest = Manifest(spark, root)
    if not touched:
        return manifest.version()
    for last in range(tries):
        version = manifest.version()
        live = manifest.live(version)
        merged = keep_last(manifest.read(touched, version).unionByName(new)).withColumn("_p", _partition())
        folder = f"data/{uuid.uuid4().hex}"
        merged.repartition("_p").sortWithinPartitions("_p", "open_time").write.partitionBy("_p").parquet(f"{manifest.root}/{folder}")
        # files are found by their rows' partition, which their folders' names hold in escaped form
        written = spark.read.parquet(f"{manifest.root}/{folder}").select(_partition().alias("p"), F.col("_metadata.file_path").alias("f")).distinct()
        files: dict[str, list[str]] = {}
        for r in written.collect():  # a row per file written
            name = unquote(r["f"])  # the column holds a URI
            files.setdefault(r["p"], []).append(name[name.index(folder) :])
        try:
            manifest.commit(version + 1, live | files)
            return version + 1
        except Conflict:
            if last == tries - 1:
                raise
    return version


def next_seq(spark: SparkSession, root: str) -> int:
    """The sequence number after the greatest stored one."""
    last = read_candles(spark, root).agg(F.max("ingest_seq")).first()[0]
    return 0 if last is None else last + 1


def save_frame(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_artifacts(frames: dict[str, DataFrame | None], root: str) -> list[str]:
    """Writes each frame under its name, such as "features/features.parquet"; returns the names written. What fails is logged and left out."""
    written = []
    for name, df in frames.items():
        if df is not None:
            try:
                save_frame(df, f"{root.rstrip('/')}/{name}")
                written.append(name)
            except Exception as e:  # an analysis goes on without its files
                logging.getLogger(__name__).warning("%s wasn't written: %s", name, e)
    return written


class Log:
    """Messages in a table, of which readers see the last ones."""

    SCHEMA = "seq long, at timestamp, message string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/log"

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def write(self, *messages: str) -> None:
        last = self._all().agg(F.max("seq")).first()[0]
        rows = self.spark.createDataFrame([((-1 if last is None else last) + i, m) for i, m in enumerate(messages, 1)], "seq long, message string")
        rows.select("seq", F.current_timestamp().alias("at"), "message").coalesce(1).write.mode("append").parquet(self.path)

    def tail(self, n: int = 300) -> DataFrame:
        return self._all().orderBy(F.desc("seq")).limit(n)


class Runs:
    """Runs and their records: one status table (append only, last row counts) and one table per kind of record."""

    STATUS = "run_id string, seq long, status string, spec string, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, spec: dict) -> str:
        run_id = uuid.uuid4().hex[:12]
        self.mark(run_id, "created", spec)
        return run_id

    def mark(self, run_id: str, status: str, spec: dict | None = None) -> None:
        seq = self.statuses().where(F.col("run_id") == run_id).count()
        row = self.spark.createDataFrame([(run_id, seq, status, json.dumps(spec) if spec else None)], "run_id string, seq long, status string, spec string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/status")

    def statuses(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.STATUS).parquet(f"{self.root}/status")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.STATUS)

    def list(self) -> DataFrame:
        w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
        return self.statuses().withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def load(self, run_id: str) -> dict:
        """run_id, spec and status of one run; a run that isn't there is a KeyError."""
        rows = self.statuses().where(F.col("run_id") == run_id)
        got = rows.agg(F.max_by("status", "seq").alias("status"), F.max_by("spec", F.when(F.col("spec").isNotNull(), F.col("seq"))).alias("spec")).first()
        if got["status"] is None:
            raise KeyError(run_id)
        return {"run_id": run_id, "status": got["status"], "spec": json.loads(got["spec"] or "{}")}

    def latest(self, kind: str, run_id: str, order: str) -> dict | None:
        """The last record of a kind."""
        row = self.tail(kind, run_id, 1, order).first()
        return None if row is None else row.asDict(recursive=True)

    def interrupt_unfinished(self) -> int:
        """Marks runs that are neither completed nor failed as interrupted."""
        open_runs = [r["run_id"] for r in self.list().where(~F.col("status").isin("completed", "failed", "interrupted")).select("run_id").collect()]
        for run_id in open_runs:
            self.mark(run_id, "interrupted")
        return len(open_runs)

    def append(self, kind: str, run_id: str, rows: DataFrame) -> None:
        rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{kind}")

    def read(self, kind: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}").where(F.col("run_id") == run_id)

    def tail(self, kind: str, run_id: str, n: int, order: str) -> DataFrame:
        return self.read(kind, run_id).orderBy(F.desc(order)).limit(n)
