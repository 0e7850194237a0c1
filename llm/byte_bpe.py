"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

Every token's bytes become characters (one per byte), scored by the negative
rank: sentencepiece then joins the neighbours of lowest rank first, leftmost
among equals, as the rank file asks. The normaliser is the identity. A match of
the pattern that is a token itself is taken whole, as the tokenizer's own library does.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import F, UnitTable, chunks, free_name, units, with_source

#: Units a task keeps.
KEPT_UNITS = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece k has rank k, the unknown piece comes last.

    Field numbers are those of sentencepiece's public model description. Ranks
    must run from 0 without a gap and hold all 256 single bytes.
    """
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without a gap and hold every single byte")
    characters = byte_characters()
    pieces = b""
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(characters[b] for b in token).encode()
        pieces += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # no control pieces: begin, end and padding are switched off with -1
    off = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, off) + _field(42, off) + _field(43, off)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, identity)


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need: bounded by the vocabulary, about 2 MB."""

    model: bytes
    tokens: tuple[bytes, ...]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        ranks = read_ranks(path)
        return cls(sentencepiece_model(ranks), tuple(sorted(ranks, key=ranks.__getitem__)), pattern)


class Coder:
    """Encodes and decodes inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.tokens = vocabulary.tokens
        self.ranks = {t: k for k, t in enumerate(vocabulary.tokens)}
        self.split = regex.compile(vocabulary.pattern).findall
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        self.known = UnitTable(self._encode_units, size=KEPT_UNITS)

    def _encode_units(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has: its pre-tokens one by one."""
        split = [self.split(unit) for unit in new]
        ids: dict[str, list[int]] = {}
        spelled: dict[str, str] = {}
        for piece in {p for pieces in split for p in pieces}:
            data = piece.encode()
            if data in self.ranks:
                ids[piece] = [self.ranks[data]]
            else:
                # latin-1 gives a character per byte, translate the byte's own one
                spelled[piece] = data.decode("latin-1").translate(self.characters)
        if spelled:
            ids |= zip(spelled, self.processor.encode(list(spelled.values()), num_threads=1))
        found = [[i for p in pieces for i in ids[p]] for pieces in split]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids.astype("<u4", copy=False) for ids in self.known.ids_of([units(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _coder(vocabulary: Vocabulary) -> Coder:
    return Coder(vocabulary)


def with_tokens(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "tokens", digests: bool = False, keep_text: bool = True
) -> DataFrame:
    """``docs`` with a struct column ``out`` added: ids (array<int>) and decoded (the bytes of the ids).

    With ``digests`` the struct has n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 instead, so that ids need not leave
    the task. NULL and empty texts have no ids. Each row is encoded by itself, also
    when its id is NULL or repeated; an empty table gives an empty result. Other
    columns pass unchanged, the text only with ``keep_text``; ``out`` gets underscores in front if the name is taken.
    """
    import hashlib

    out = free_name(docs, out)
    fields = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" if digests else "ids: array<int>, decoded: binary"
    source, whole = with_source(docs, text, "_whole_text")
    kept = docs if keep_text or whole not in docs.columns else docs.drop(whole)
    others = kept.columns
    schema = kept.withColumn(out, F.lit(None).cast(f"struct<{fields}>")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in chunks(batches, whole):
            lists = coder.encode([t or "" for t in batch.column(whole).to_pylist()])
            if digests:
                columns = [
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in lists], pa.string()),
                ]
                result = pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                decoded = pa.array(map(coder.decode, lists), pa.binary())
                columns = [pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())), decoded]
                result = pa.StructArray.from_arrays(columns, ["ids", "decoded"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), result], [*others, out])

    return source.mapInArrow(coded, schema)
