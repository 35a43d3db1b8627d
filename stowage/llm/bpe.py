"""Byte-level BPE through a sentencepiece model that is written out directly.

A rank file lists byte strings by merge priority. The same merges result from a sentencepiece
BPE model whose pieces are those byte strings, each byte mapped to one letter, scored by
negative rank: the best-scored neighbouring pair merges first, the left one on ties. The model
is serialised field by field; nothing is trained. Normalisation is the identity.

Texts are cut into pre-tokens by a pattern, and each pre-token is encoded by itself. Distinct
pre-tokens are encoded once and kept in a memo, which starts anew when it grows too large. A pre-token that is a vocabulary
entry is taken whole, as rank encoders do.

Null texts count as empty and encode to no ids. Any other text decodes to its own bytes.
Repeated rows give repeated results. All columns of the input are passed on; a column of the
name of the result is replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stowage.llm.common import small_batches

# Byte b is written as the letter FIRST_LETTER + b: one code point, never white space.
FIRST_LETTER = 0x100
LETTERS = {byte: FIRST_LETTER + byte for byte in range(256)}
MEMO_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a rank file: one base64 text and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def as_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(LETTERS)


def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The model file, and the rank of each of its ids (id 0 is the unknown piece).

    Field numbers are those of the public sentencepiece model format.
    """
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    unknown = _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)
    pieces = [_block(1, unknown)]
    for raw, rank in ordered:
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        pieces.append(_block(1, _block(1, as_letters(raw).encode()) + score))
    no_id = -1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0)
    trainer += b"".join(_number(field, no_id) for field in (41, 42, 43))
    normaliser = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join([*pieces, _block(2, trainer), _block(3, normaliser)]), [-1, *(r for _, r in ordered)]


class Encoder:
    """Encodes whole texts; lives in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        model, id_ranks = serialise(ranks)
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._ranks = np.array(id_ranks, "<i8")
        self._split = regex.compile(pattern).findall
        self._whole = {}
        for raw, rank in ranks.items():
            try:
                self._whole[raw.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:  # a part of a letter is never a pre-token
                continue
        self._memo = dict(self._whole)

    def _learn(self, unseen: list[str]) -> None:
        found = self._pieces.encode([as_letters(token.encode()) for token in unseen], num_threads=1)
        sizes = np.fromiter(map(len, found), "i8", len(found))
        ids = np.fromiter(chain.from_iterable(found), "i8", int(sizes.sum()))
        ranks = self._ranks[ids].astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        for token, begin, end in zip(unseen, [0, *ends], ends):
            self._memo[token] = ranks[begin:end]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        for text in texts:
            tokens = self._split(text)
            try:
                yield b"".join(map(self._memo.__getitem__, tokens))
            except KeyError:
                distinct = set(tokens)
                if len(self._memo) + len(distinct) > MEMO_ENTRIES:
                    self._memo = dict(self._whole)
                self._learn([token for token in distinct if token not in self._memo])
                yield b"".join(map(self._memo.__getitem__, tokens))


@lru_cache(maxsize=2)
def _worker_encoder(key: tuple, pattern: str) -> Encoder:
    return Encoder(dict(key), pattern)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, column in enumerate(batch.schema.names) if column != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in keep), values], [*(batch.schema.names[i] for i in keep), name]
    )


def _extended(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text", to: str = "ids") -> DataFrame:
    """Add `to`: the ids of `column` as little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)
    # The vocabulary is the one thing broadcast: fixed size, under 2 MB for 50,000 entries.
    shared = df.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared.value, pattern)
        for batch in batches:
            texts = [text or "" for text in batch.column(column).to_pylist()]
            yield _with_column(batch, to, pa.array(encoder.encode(texts), pa.binary()))

    return df.mapInArrow(run, _extended(df, to))


def decode(df: DataFrame, ranks: dict[bytes, int], column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add `to`: the bytes that the ids of `column` stand for, by the inverse of the vocabulary."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_of = {rank: raw for raw, rank in shared.value}.__getitem__
        for batch in batches:
            ids = (np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(column).to_pylist())
            yield _with_column(batch, to, pa.array((b"".join(map(raw_of, x)) for x in ids), pa.binary()))

    return df.mapInArrow(run, _extended(df, to))
