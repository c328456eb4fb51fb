"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, decoding by the byte table.

A rank file (base64 token, rank) and a split pattern define the vocabulary. The driver turns them into one
tokenizer definition (its size is that of the vocabulary, not of the data) and ships it with the tasks.

Texts are cut into pieces at white space, where no match of the split pattern can cross; each distinct piece of a
task is encoded once and remembered in a bounded memo. Memory per task is the memo, one Arrow batch and one text.

Defined results: a null or empty text has no ids; ids outside the vocabulary are an error in decode(); other
columns of the input are kept as they are, and a clash with an output column is an error naming it.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WHITE_SPACE, private, texts

#: At most so many distinct pieces, none longer than MEMO_CHARS, are remembered in a worker; then it starts afresh.
MEMO, MEMO_CHARS = 600_000, 64
PIECE = re.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: A word of plain letters, then marks.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(path).read_bytes().splitlines())}


def parent_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token, found by merging its bytes with the lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            raise ValueError(f"{token!r} can't be merged from lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The tokenizers definition of a rank file, built on the driver."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    name = lambda t: "".join(chars[b] for b in t)
    merges = [tuple(map(name, parent_pair(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tok = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


class Codec:
    """One worker's tokenizer, its memos of pieces and matches, and its table from id to bytes."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(definition)
        self.split, self.model = tok.pre_tokenizer.pre_tokenize_str, tok.model
        self.chars = dict(enumerate(byte_chars()))
        as_simple = [" aé..."[i:j] for _, (i, j) in self.split(" aé...")] == [" aé", "..."]  # as SIMPLE parts words and marks
        self.simple = SIMPLE.fullmatch if as_simple else None
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = tok.get_vocab()
        self.table = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.table[i] = bytes(back[c] for c in t)
        self.pieces: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        """The ids of one match of the split pattern."""
        if (ids := self.matches.get(match)) is None:
            mapped = match.encode().decode("latin-1").translate(self.chars)
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.matches) >= MEMO:
                self.matches.clear()
            if len(match) <= MEMO_CHARS:
                self.matches[match] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if word := self.simple and self.simple(piece):  # most pieces: the library's splitter need not look at them
            letters, rest = word.groups()
            ids = self._match(letters) + self._match(rest) if rest else self._match(letters)
        else:
            ids = b"".join([self._match(piece[i:j]) for _, (i, j) in self.split(piece)])
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        if len(piece) <= MEMO_CHARS:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.pieces.get
        return b"".join([known(p) or self._piece(p) for p in PIECE.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def char_offsets(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that are so many bytes long; a character split over tokens counts to each of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return char_of[starts] if len(ends) else ends, char_of[ends - 1] + 1 if len(ends) else ends


_CODECS: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    """The worker's codec, kept between tasks."""
    if hash(definition) not in _CODECS:
        _CODECS.clear()
        _CODECS[hash(definition)] = Codec(definition)
    return _CODECS[hash(definition)]


def _check_free(df: DataFrame, names: list[str]) -> None:
    if clash := [n for n in names if n in df.columns]:
        raise ValueError(f"the input already has the columns {clash}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ids (array<long>) and, with offsets, the byte and character spans of each token."""
    _check_free(docs, ["ids", "byte_start", "char_start", "char_end"])
    definition = tokenizer_json(ranks_path, pattern)
    more = ", byte_start array<long>, char_start array<long>, char_end array<long>" if offsets else ""

    @F.pandas_udf(f"ids array<long>{more}")
    def tokens(text):
        import pandas as pd

        c, rows = codec(definition), []
        for t in text.fillna(""):
            ids = np.frombuffer(c.encode(t), "<u4").astype(np.int64)
            if offsets:
                lengths = np.array([len(c.table[i]) for i in ids.tolist()], np.int64)
                rows.append((ids, np.cumsum(lengths) - lengths, *char_offsets(t, lengths)))
            else:
                rows.append((ids,))
        names = ["ids", "byte_start", "char_start", "char_end"] if offsets else ["ids"]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    (new,) = private(docs, "t")
    return docs.withColumn(new, tokens(F.col(text_col))).select(*(F.col(f"`{c}`") for c in docs.columns), f"{new}.*")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary, exact), decoded_text (invalid bytes replaced) and decoded_parts: what each token adds to
    the text, where a character that is split over tokens appears with the last of them."""
    _check_free(df, ["decoded", "decoded_text", "decoded_parts"])
    definition = tokenizer_json(ranks_path, pattern)

    @F.pandas_udf("decoded binary, decoded_text string, decoded_parts array<string>")
    def back(ids):
        import pandas as pd

        c, rows = codec(definition), []
        for x in ids:
            parts = [c.table[i] for i in (x if x is not None else [])]
            inc = codecs.getincrementaldecoder("utf-8")("replace")
            text_parts = [inc.decode(p, final=i == len(parts) - 1) for i, p in enumerate(parts)]
            rows.append((b"".join(parts), "".join(text_parts), text_parts))
        names = ["decoded", "decoded_text", "decoded_parts"]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    (new,) = private(df, "d")
    return df.withColumn(new, back(F.col(ids_col))).select(*(F.col(f"`{c}`") for c in df.columns), f"{new}.*")


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, their digest and the digest of what they decode to."""
    definition = tokenizer_json(ranks_path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition)
        for b in batches:
            out: list[list] = [[], [], []]
            for t in b.column(1):
                ids = c.encode(t.as_py())
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
