"""Token-id files: blocks of ids transposed into bit or byte planes, each plane compressed, with an index of chunks.

A folder holds part files and `manifest.json`. A part file is

    magic (8 bytes) | chunks | index | footer

- A chunk has up to BLOCK ids. They are transposed into planes (plane p of kind "byte" holds byte p of every id, of kind
  "bit" bit p of every id, eight ids to a byte, lowest bit first); each plane is one zstandard frame, planes of zeros
  alone take no bytes. After the planes comes one frame with the documents that start in the chunk: doc_id (int64),
  whether it is null (int8) and length in ids (int64), column by column.
- The index, one zstandard frame of int64: per chunk its offset, its ids, its crc32, its documents, where the first of
  them starts in the chunk, the least and the greatest of their doc_ids, the bytes of the documents' frame and the bytes
  of each plane. With it a reader can begin at any chunk.
- The footer: offset and length of the index, kind of planes (1 bit, 8 byte), chunks, and the magic again.

All numbers are little-endian. Part files have names of their own for each attempt of a task, and the manifest, which the
driver moves into place when all tasks have ended, names those that count: a lost executor's half-written file is never
read. The manifest has one entry per file, so its size is that of the files' number, not of the corpus.

Spark reads and writes the folder as a data source (`write_ids`, `read_ids`); files are opened with pyarrow's file
systems, so the folder may be on any store that they know.

Defined results: a null or empty text has the end id alone; rows without doc_id come first; rows that repeat a doc_id
come in the order of a hash of their text, equal rows in any; an empty table gives a folder without part files, and no
rows; other columns are not carried. A chunk that doesn't fit its crc32 is an error.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidegauge.llm.common import partitions, private, texts
from tidegauge.llm.packing import word_codec

MAGIC = b"TGPLANE1"
FOOTER = struct.Struct("<qqqq8s")
#: Ids of a chunk; ids and documents after which a part file is closed; ids that one reading task gets at least.
BLOCK, FILE_IDS, FILE_DOCS, SPLIT = 1 << 16, 1 << 28, 1 << 24, 1 << 21
#: Values of an index row before the planes' lengths.
HEAD = 8
PLANES = {"bit": 32, "byte": 4}
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_LEVEL = 3


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; a plane of zeros is empty."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        planes = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bit":
        width = (n + 7) // 8
        packed = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
        rows = np.packbits(np.unpackbits(packed, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def _store(path: str):
    """pyarrow's file system of a folder, and the folder's path there."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


class PartWriter:
    """One part file, written front to back: what it holds in memory is a chunk and the index."""

    def __init__(self, out, kind: str, block: int = BLOCK):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=_LEVEL).compress
        self.at = len(MAGIC)
        self.pending, self.docs, self.first_at = bytearray(), [], 0
        self.index: list[list[int]] = []
        self.n_ids = self.n_docs = 0
        self.least: int | None = None
        self.most: int | None = None
        self.has_null = False
        out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if not self.docs:
            self.first_at = len(self.pending) // 4
        self.docs.append((doc, n))
        self.pending += ids
        self.n_docs += 1
        self.n_ids += n
        if doc is None:
            self.has_null = True
        else:
            self.least = doc if self.least is None else min(self.least, doc)
            self.most = doc if self.most is None else max(self.most, doc)
        while len(self.pending) >= 4 * self.block:
            self._chunk(4 * self.block)

    def _chunk(self, size: int) -> None:
        raw = bytes(self.pending[:size])
        del self.pending[:size]
        frames = [self.squeeze(p) if p else b"" for p in to_planes(np.frombuffer(raw, "<u4"), self.kind)]
        known = [d for d, _ in self.docs if d is not None]
        docs = b"".join([
            np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(), bytes(d is None for d, _ in self.docs),
            np.array([n for _, n in self.docs], "<i8").tobytes(),
        ])
        frames.append(self.squeeze(docs) if self.docs else b"")
        low, high = (min(known), max(known)) if known else (0, -1)
        self.index.append([self.at, len(raw) // 4, zlib.crc32(raw), len(self.docs), self.first_at, low, high, len(frames[-1]), *map(len, frames[:-1])])
        for f in frames:
            self.out.write(f)
            self.at += len(f)
        self.docs, self.first_at = [], 0

    def close(self) -> None:
        if self.pending or self.docs:
            self._chunk(len(self.pending))
        index = self.squeeze(np.array(self.index, "<i8").tobytes())
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(index), 1 if self.kind == "bit" else 8, len(self.index), MAGIC))


class PartReader:
    """A part file's chunks and documents, from any chunk on."""

    def __init__(self, file):
        import zstandard

        self.file = file
        self.spread = zstandard.ZstdDecompressor().decompress
        size = file.size()
        at, length, width, chunks, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.kind = "bit" if width == 1 else "byte"
        self.index = np.frombuffer(self.spread(self._bytes(at, length)), "<i8").reshape(chunks, HEAD + PLANES[self.kind])

    def _bytes(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def ids(self, k: int) -> bytes:
        """The ids of chunk k."""
        at, n, crc, _, _, _, _, _, *lengths = self.index[k].tolist()
        raw, planes = self._bytes(at, sum(lengths)), []
        for length in lengths:
            planes.append(self.spread(raw[:length]) if length else b"")
            raw = raw[length:]
        found = from_planes(planes, n, self.kind).tobytes() if n else b""
        if zlib.crc32(found) != crc:
            raise ValueError(f"chunk {k} doesn't fit its crc32")
        return found

    def docs(self, k: int) -> list[tuple[int | None, int]]:
        """doc_id and length of the documents that start in chunk k."""
        row = self.index[k].tolist()
        if not row[3]:
            return []
        raw, n = self.spread(self._bytes(row[0] + sum(row[HEAD:]), row[7])), row[3]
        ids, null, lengths = np.frombuffer(raw, "<i8", n), raw[8 * n : 9 * n], np.frombuffer(raw, "<i8", n, 9 * n)
        return [(None if z else d, m) for d, z, m in zip(ids.tolist(), null, lengths.tolist())]

    def documents(self, first: int, last: int, between: tuple[int | None, int | None] = (None, None)) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id's place in the file, ids) of the documents that start in chunks first to last - 1.

        With limits only chunks that may hold such doc_ids are opened; rows without doc_id are left out then.
        """
        low, high = between
        base = np.concatenate([[0], np.cumsum(self.index[:, 1])])
        held, buffer = -1, b""
        for k in range(first, last):
            row = self.index[k]
            if (low is not None and row[6] < low) or (high is not None and row[5] > high) or (between != (None, None) and row[6] < row[5]):
                continue
            at = int(base[k] + row[4])
            for doc, n in self.docs(k):
                start, at = at, at + n
                if between != (None, None) and (doc is None or (low is not None and doc < low) or (high is not None and doc > high)):
                    continue
                if held != k:
                    held, buffer = k, self.ids(k)
                skip = 4 * (start - int(base[k]))
                parts, left, c = [buffer[skip : skip + 4 * n]], n, k
                left -= len(parts[0]) // 4
                while left:
                    c += 1
                    more = self.ids(c)
                    if len(more) <= 4 * left:
                        parts.append(more)
                    else:
                        parts.append(more[: 4 * left])
                    left -= len(parts[-1]) // 4
                yield doc, start, b"".join(parts)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (partition, files in order)."""

    partition: int
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, block: int, file_ids: int, definition: str | None, end_id: int | None):
        self.path, self.kind, self.block, self.file_ids = path, kind, block, file_ids
        self.definition, self.end = definition, b"" if end_id is None else array("I", [end_id]).tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = _store(self.path)
        partition, files, part = TaskContext.get().partitionId(), [], None

        def end() -> None:
            part.close()
            part.out.close()
            files.append({"file": name, "docs": part.n_docs, "ids": part.n_ids, "chunks": len(part.index), "least": part.least, "most": part.most, "has_null": part.has_null})

        encode = word_codec(self.definition).encode if self.definition else None
        for batch in iterator:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text" if encode else "ids")):
                ids = (encode(x.as_py() or "") if encode else x.as_py() or b"") + self.end
                if part is None:
                    name = f"part-{partition:05d}-{len(files):03d}-{uuid.uuid4().hex}.ids"
                    part = PartWriter(store.open_output_stream(f"{folder}/{name}"), self.kind, self.block)
                part.add(doc, ids)
                if part.n_ids >= self.file_ids or part.n_docs >= FILE_DOCS:
                    end()
                    part = None
        if part is not None:
            end()
        return Written(partition, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        files, start = [], 0
        for m in done:
            for f in m.files:
                files.append(f | {"start": start})
                start += f["ids"]
        waiting = f"{folder}/_manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(waiting) as out:
            out.write(json.dumps({"planes": self.kind, "block": self.block, "ids": start, "files": files}).encode())
        store.move(waiting, f"{folder}/manifest.json")  # a reader sees the whole manifest or none

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            for f in m.files if m else ():
                store.delete_file(f"{folder}/{f['file']}")


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder)


class _Reader(DataSourceReader):
    def __init__(self, path: str, between: tuple[int | None, int | None]):
        self.path, self.between = path, between

    def partitions(self) -> list[InputPartition]:
        low, high = self.between
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/manifest.json") as f:
            manifest = json.loads(f.read())
        found = []
        for f in manifest["files"]:
            if self.between != (None, None) and (f["least"] is None or (low is not None and f["most"] < low) or (high is not None and f["least"] > high)):
                continue
            step = max(1, SPLIT // manifest["block"])
            found += [InputPartition((f["file"], f["start"], k, min(k + step, f["chunks"]))) for k in range(0, f["chunks"], step)]
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, base, first, last = partition.value
        store, folder = _store(self.path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        with store.open_input_file(f"{folder}/{name}") as file:
            for doc, at, ids in PartReader(file).documents(first, last, self.between):
                rows.append((doc, base + at, len(ids) // 4, ids))
                size += len(ids) + 32
                if size > 1 << 22:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class PlaneSource(DataSource):
    """Options: path; for writing planes ("bit" or "byte"), block, file_ids, end_id (put after each document) and tokenizer
    (a path; then text is encoded by the writing task); for reading from and to, limits of doc_id."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        o, definition = self.options, None
        if "tokenizer" in o:  # read here, on the driver, and sent with the tasks
            with open(o["tokenizer"]) as f:
                definition = f.read()
        end_id = int(o["end_id"]) if "end_id" in o else None
        return _Writer(o["path"], o.get("planes", "byte"), int(o.get("block", BLOCK)), int(o.get("file_ids", FILE_IDS)), definition, end_id)

    def reader(self, schema) -> _Reader:
        limit = [int(self.options[k]) if k in self.options else None for k in ("from", "to")]
        return _Reader(self.options["path"], (limit[0], limit[1]))


def write_ids(rows: DataFrame, path: str, planes: str = "byte", **options: object) -> None:
    """Writes doc_id and ids (binary, little-endian unsigned 32-bit), or text with a tokenizer, in the order of partitions
    and rows; options are those of PlaneSource. The folder must not hold ids yet."""
    if planes not in PLANES:
        raise ValueError(f"planes must be one of {sorted(PLANES)}")
    store, folder = _store(path)
    store.create_dir(folder)
    if any(f.path.endswith("/manifest.json") for f in store.get_file_info(_selector(folder))):
        raise ValueError(f"{path} already holds token ids")
    rows.sparkSession.dataSource.register(PlaneSource)
    rows.write.format("token_planes").options(path=path, planes=planes, **options).mode("append").save()


def read_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; with limits only of doc_ids from first to last."""
    spark.dataSource.register(PlaneSource)
    reader = spark.read.format("token_planes").option("path", path)
    for name, x in (("from", first), ("to", last)):
        reader = reader if x is None else reader.option(name, x)
    return reader.load()


def in_order(docs: DataFrame, tasks: int) -> DataFrame:
    """doc_id and text by ascending doc_id over the partitions; rows that share a doc_id are spread over several, if many."""
    tie, place = private(docs, "tie", "place")
    t = texts(docs).withColumn(tie, F.xxhash64("text")).withColumn(place, F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col(tie), F.col(place)]
    return t.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, planes: str = "byte", tasks: int | None = None) -> None:
    """Encodes documents and writes their ids, with the end id after each, by ascending doc_id."""
    ordered = in_order(docs, tasks or partitions(docs.sparkSession))
    write_ids(ordered, path, planes, tokenizer=tokenizer_path, end_id=end_id)


def digests(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
