"""Helpers of the operators: reading tables, staging, and text batches inside tasks."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.storage import stage

__all__ = ["F", "UnitCache", "UnitTable", "byte_level_encoder", "byte_level_entries", "chunks", "distinct_units", "free_name", "gathered", "hashed_words", "mixed", "sampled_labels", "stage", "table", "texts_of", "unit_starts", "units", "with_source"]

#: Unicode white space, then what follows up to the next one. Tokens of the byte-level
#: patterns never hold white space behind another character, so that a token starts
#: where a unit starts, whatever comes before.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
units = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall

#: The UTF-8 bytes of white space beyond ASCII, as numbers.
_WIDE_SPACE = np.array(
    [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)

#: Text bytes that one step inside a task works on at once.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def with_source(docs: DataFrame, text: str, base: str) -> tuple[DataFrame, str]:
    """``docs`` and the column that holds ``text``: the column of that name itself, else a new one named like ``base``.

    Python workers and the JVM then hold a text once in a batch, not twice.
    """
    if text.isidentifier() and text in docs.columns and [c.lower() for c in docs.columns].count(text.lower()) == 1:
        return docs, text
    name = free_name(docs, base)
    return docs.withColumn(name, F.col(text)), name


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` text bytes (one row at least), so that memory is bounded by the longest text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a text or a unit starts: ASCII white space behind what is not white space.

    These are units of ``units``, some of them in one: in front of other white space nothing is cut.
    """
    space = (data == 32) | (data - np.uint8(9) < 5)
    starts = np.zeros(len(data), bool)
    np.greater(space[1:], space[:-1], out=starts[1:])
    behind = np.flatnonzero(starts)
    behind = behind[data[behind - 1] >= 128]
    code = sum(data[np.maximum(behind - k, 0)].astype(np.int64) << 8 * (k - 1) for k in (1, 2, 3))
    starts[behind[np.isin(code, _WIDE_SPACE) | np.isin(code & 0xFFFF, _WIDE_SPACE)]] = False
    starts[begins[begins < len(data)]] = True
    return np.flatnonzero(starts)


def distinct_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different units of a string column, the place there of each unit in order, and where each text's units start (one more at the end).

    NULL is empty. Texts stay Arrow columns: Python meets a unit once, however often it stands in them.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    begins, content = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if len(texts):
        begins = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        if begins[-1] > begins[0]:
            content = np.frombuffer(texts.buffers()[2], np.uint8, begins[-1] - begins[0], begins[0])
        begins = begins - begins[0]
    starts = unit_starts(content, begins)
    bounds = pa.py_buffer(np.append(starts, len(content)))
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(content)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(starts, begins)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one after the other, and the place where each document starts (one more at the end)."""
    import pandas as pd
    import xxhash

    starts = np.zeros(len(documents) + 1, np.int64)
    np.cumsum([len(d) for d in documents], out=starts[1:])
    flat = np.empty(starts[-1], object)
    at = 0
    for words in documents:
        flat[at : at + len(words)] = words
        at += len(words)
    codes, unique = pd.factorize(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), np.uint64, len(unique))
    return (hashes[codes] if len(codes) else np.zeros(0, np.uint64)), starts


def sampled_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id: a bounded table of (doc_id, label).

    NULL ids and labels other than 0 and 1 are left out; an id with both labels too.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("_most"))
        .where(F.col("label") == F.col("_most"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id")
        .limit(rows)
        .select("doc_id", "label")
    )


class UnitCache:
    """Ids of units seen by a task, as little-endian 32-bit integers: at most ``size`` units of up to 64 characters.

    When it is full the older half goes.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], size: int = 800_000):
        self.encode, self.size = encode, size
        self.known: dict[str, bytes] = {}

    def ids_of(self, texts: list[list[str]], at_once: int = 10_000) -> list[bytes]:
        """The ids of many texts; units that are new to any of them are encoded together, ``at_once`` a call."""
        new = list(set().union(*texts).difference(self.known))
        for k in range(0, len(new), at_once):
            part = new[k : k + at_once]
            self.known.update(zip(part, (x if isinstance(x, bytes) else array("I", x).tobytes() for x in self.encode(part))))
        result = [b"".join(map(self.known.__getitem__, units)) for units in texts]
        for u in new:
            if len(u) > 64:
                del self.known[u]
        if len(self.known) > self.size:
            self.known = dict(islice(self.known.items(), self.size // 2, None))
        return result


def gathered(values: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each numbered list one after the other, and how many each has; list i is ``values[bounds[i]:bounds[i + 1]]``."""
    first = bounds[numbers]
    counts = bounds[numbers + 1] - first
    at = np.repeat(first - (np.cumsum(counts) - counts), counts)
    at += np.arange(len(at))
    return values[at], counts


class UnitTable:
    """Numbers for the units seen by a task, and the ids that each encoder has for them: about ``size`` units of up to 64 characters.

    An encoder takes units and returns their ids one after the other, and how many each has.
    When the table is full, units met once go; of the others at most half the size stays, the most frequent ones.
    """

    def __init__(self, *encoders: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int = 500_000):
        self.encoders, self.size = encoders, size
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.uses = np.zeros(0, np.int64)
        self.values = [np.zeros(0, np.uint32) for _ in self.encoders]
        self.bounds = [np.zeros(1, np.int64) for _ in self.encoders]

    def numbers(self, texts: Iterable[list[str]], at_once: int = 10_000) -> np.ndarray:
        """A number for each unit of the texts, valid until the next call; new units are encoded ``at_once`` a call."""
        self._trim()
        before = len(self.uses)
        try:
            numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
            uses = np.bincount(numbers, minlength=before)
            n_new = len(uses) - before
            uses[:before] += self.uses
            self.uses = uses
            new = list(islice(reversed(self.known), n_new))[::-1]
            for k, encode in enumerate(self.encoders):
                found = [encode(new[i : i + at_once]) for i in range(0, n_new, at_once)]
                self.values[k] = np.concatenate([self.values[k], *(ids for ids, _ in found)])
                counts = np.concatenate([self.bounds[k][-1:], *(n for _, n in found)])
                self.bounds[k] = np.concatenate([self.bounds[k][:-1], np.cumsum(counts)])
        except BaseException:
            self.clear()  # units without ids must not stay
            raise
        for u in new:
            if len(u) > 64:
                del self.known[u]
        return numbers

    def ids(self, numbers: np.ndarray, encoder: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered units one after the other, and how many each unit has."""
        return gathered(self.values[encoder], self.bounds[encoder], numbers)

    def ids_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts that are lists of units, by the first encoder."""
        ids, counts = self.ids(self.numbers(texts))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(units) for units in texts], dtype=np.int64)]
        return np.split(ids, ends[:-1]) if texts else []

    def _trim(self) -> None:
        if len(self.uses) <= self.size and max(map(len, self.values)) <= 16 * self.size:
            return
        kept = np.zeros(len(self.uses), bool)
        kept[np.fromiter(self.known.values(), np.int64, len(self.known))] = True
        kept &= self.uses > 1
        rows = np.flatnonzero(kept)
        if len(rows) > self.size // 2:
            rows = np.sort(rows[np.argsort(-self.uses[rows], kind="stable")[: self.size // 2]])
        place = np.full(len(self.uses), -1)
        place[rows] = np.arange(len(rows))
        # in the order of their numbers, which is the order of the dictionary
        moved = ((u, i) for u, i in zip(self.known, place[np.fromiter(self.known.values(), np.int64)].tolist()) if i >= 0)
        self.known = defaultdict(count(len(rows)).__next__, moved)
        self.uses = self.uses[rows] // 2
        for k, (values, bounds) in enumerate(zip(self.values, self.bounds)):
            self.values[k], counts = gathered(values, bounds, rows)
            self.bounds[k] = np.concatenate([[0], np.cumsum(counts)])


def byte_level_entries(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; an added token's entry is plain text."""
    from llm.byte_bpe import byte_characters

    byte_of = {c: b for b, c in enumerate(byte_characters())}
    entries = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        spelled = all(c in byte_of for c in entry)
        out[i] = bytes(byte_of[c] for c in entry) if spelled else entry.encode()
    return out


def byte_level_encoder(tokenizer, sizes: np.ndarray) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of units by a byte-level tokenizer of the tokenizers library, many units in one text; an encoder of ``UnitTable``.

    A token starts where a unit of white space and text starts, so that such units are encoded in a row, and
    cut by the bytes of their tokens (``sizes`` by id). Others are encoded one by one.
    """

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in found)]), np.array([len(x) for x in found], np.int64)

    def encode(new: list[str], in_row: int = 500) -> tuple[np.ndarray, np.ndarray]:
        fits = np.array([u[0] in " \n\r\t" and not u[-1].isspace() for u in new], bool)
        safe = [u for u, fit in zip(new, fits.tolist()) if fit]
        ids, _ = whole(["".join(safe[k : k + in_row]) for k in range(0, len(safe), in_row)])
        spelled, wanted = np.cumsum(sizes[ids]), np.cumsum([len(u.encode()) for u in safe], dtype=np.int64)
        if safe and (not len(ids) or spelled[-1] != wanted[-1]):
            return whole(new)  # tokens that do not spell the units do not tell where these end
        counts = np.diff(np.searchsorted(spelled, wanted) + 1, prepend=0)
        if len(safe) == len(new):
            return ids, counts
        others, more = whole([u for u, fit in zip(new, fits.tolist()) if not fit])
        place = np.empty(len(new), np.int64)
        place[np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])] = np.arange(len(new))
        return gathered(np.concatenate([ids, others]), np.concatenate([[0], np.cumsum(np.concatenate([counts, more]))]), place)

    return encode
