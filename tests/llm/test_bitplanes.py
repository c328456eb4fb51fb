"""Token-id files: planes and files against plain encodings, and what happens to broken ones."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import bitplanes
from tidegauge.llm.queries import op12_bit_planes

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain(rows, end_id=2):
    """doc_id, start, n_tokens and crc32 as the tokenizers library alone gives them."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=100), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    x = np.array(ids, "<u4")
    planes = bitplanes.to_planes(x, kind)
    assert len(planes) == bitplanes.PLANES[kind]
    if ids:
        assert bitplanes.from_planes(planes, len(ids), kind).tolist() == ids
        assert max(i for i, p in enumerate([b"x", *planes]) if p) == -(-max(ids).bit_length() // (1 if kind == "bit" else 8))


def test_bit_planes_hold_the_bits():
    planes = bitplanes.to_planes(np.array([1, 2, 3, 0, 0, 0, 0, 0, 1], "<u4"), "bit")
    assert planes[0] == bytes([0b00000101, 1]) and planes[1] == bytes([0b00000110, 0]) and not any(planes[2:])


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files_give_back_every_document(spark, tmp_path, planes):
    r = random.Random(2)
    docs = [(None if i == 0 else i, [r.choice([0, 1, 49_407, 2**32 - 1]) for _ in range(r.choice([0, 1, 7, 8, 100, 3000]))]) for i in range(200)]
    rows = [(d, i, struct.pack(f"<{len(x)}I", *x)) for i, (d, x) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, i int, ids binary").repartitionByRange(3, "i").sortWithinPartitions("i").select("doc_id", "ids")
    path = f"{tmp_path}/ids"
    bitplanes.write_ids(df, path, planes, block=64, file_ids=10_000)
    got = sorted(bitplanes.read_ids(spark, path).collect(), key=lambda x: (x.start, x.doc_id or 0))
    start = 0
    want = []
    for d, x in docs:
        want.append((d, start, len(x), struct.pack(f"<{len(x)}I", *x)))
        start += len(x)
    assert sorted((x.doc_id or 0, x.start, x.n_tokens, bytes(x.ids)) for x in got) == sorted((d or 0, *rest) for d, *rest in want)
    manifest = json.loads((tmp_path / "ids" / "manifest.json").read_text())
    assert len(manifest["files"]) > 3 and manifest["ids"] == start


def test_limits_open_only_the_chunks_that_may_hold_them(spark, tmp_path):
    rows = [(i, struct.pack("<4I", i, i, i, 2)) for i in range(1000)]
    path = f"{tmp_path}/ids"
    bitplanes.write_ids(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), path, block=64)
    assert [tuple(x) for x in bitplanes.read_ids(spark, path, 500, 502).sort("doc_id").select("doc_id", "start", "n_tokens").collect()] == [(500, 2000, 4), (501, 2004, 4), (502, 2008, 4)]
    assert bitplanes.read_ids(spark, path, 5000).count() == 0
    (name,) = [p for p in (tmp_path / "ids").iterdir() if p.name.startswith("part-")]
    store, _ = bitplanes._store(path)
    opened = []
    with store.open_input_file(str(name)) as f:
        reader = bitplanes.PartReader(f)
        whole = reader.ids
        reader.ids = lambda k: opened.append(k) or whole(k)
        assert len(list(reader.documents(0, len(reader.index), (500, 502)))) == 3
    assert opened == [31]


def test_damage_and_half_written_files(spark, tmp_path):
    rows = [(i, struct.pack("<3I", i, i + 1, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1)
    path = f"{tmp_path}/ids"
    bitplanes.write_ids(df, path)
    with pytest.raises(ValueError, match="already holds"):
        bitplanes.write_ids(df, path)
    (tmp_path / "ids" / "part-00000-000-left-by-a-lost-executor.ids").write_bytes(b"half")
    assert bitplanes.read_ids(spark, path).count() == 300
    live = tmp_path / "ids" / json.loads((tmp_path / "ids" / "manifest.json").read_text())["files"][0]["file"]
    raw = bytearray(live.read_bytes())
    with live.open("rb") as f:
        import pyarrow as pa

        reader = bitplanes.PartReader(pa.PythonFile(f))
        row = reader.index[0].tolist()
    import zstandard

    ids = np.frombuffer(b"".join(x[1] for x in rows), "<u4").copy()
    ids[5] += 1
    plane = zstandard.ZstdCompressor(level=3).compress(bitplanes.to_planes(ids, "byte")[0])
    assert len(plane) <= row[8] + 8
    raw[row[0] + 20] ^= 0xFF
    live.write_bytes(raw)
    with pytest.raises(Exception, match="crc32|zstd|decompress|Data corruption|error"):
        bitplanes.read_ids(spark, path).collect()


def test_documents_equal_the_library(spark, tmp_path, make_docs, corpus):
    df = make_docs([*corpus, (3, "again, with the same id"), (3, "again, with the same id"), (None, "no id")])
    path = f"{tmp_path}/ids"
    bitplanes.write_documents(df, path, public_tokenizers.path("word_bpe_49k.json"), tasks=4)
    got = [tuple(x) for x in bitplanes.digests(bitplanes.read_ids(spark, path)).sort("start").collect()]
    ids = [x[0] for x in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    text = {}
    for d in df.collect():
        text.setdefault(d.doc_id, []).append(d.text)
    by_id = {d: sorted((n, c) for e, _, n, c in got if e == d) for d in text}
    assert by_id == {d: sorted(x[2:] for x in plain([(d, t) for t in ts])) for d, ts in text.items()}
    assert [x[1] for x in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


def test_query_and_empty_table(spark, tmp_path, make_docs, corpus):
    make_docs(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in op12_bit_planes(spark, str(tmp_path)).collect())
    assert got == plain(list(enumerate(corpus)))
    bitplanes.write_documents(make_docs(["a"]).limit(0), f"{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"))
    assert bitplanes.read_ids(spark, f"{tmp_path}/none").count() == 0
