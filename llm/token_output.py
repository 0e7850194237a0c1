"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a 4-bit selector and as many ids as fit into 60 bits at one
width; an id that needs more than 60 bits goes to the block's escape table and
its word holds the place there. A file is a table of blocks, so that each block
can be read and decoded by itself, all words of a selector at once:

    magic (8 bytes), number of blocks (int64)
    per block: byte offset, ids before it in the file, ids, documents, words, escapes (int64 each)
    per block: document ids (int64), whether each is NULL (one byte each, padded to 8),
               ids per document (int64), words (uint64), escapes (uint64)

Numbers are little-endian. Tasks write files under names of their own and
return them as rows; the stored manifest names the files that count, so that
what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from featwright.storage import shared_dir
from llm.common import F, UnitTable, byte_level_encoder, byte_level_entries, chunks, distinct_units, gathered, stage

MAGIC = b"SIMPLE8B"
#: Fixed values of Simple-8b: ids per word by selector 1 to 14; the width is 60 divided by it. Selector 0 is the escape.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
#: Units that a task keeps with their ids.
KEPT_UNITS = 700_000
#: Text bytes encoded at once; a unit is looked up once in them.
CHUNK_BYTES = 4_000_000


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of non-negative 64-bit values: each word takes as many as fit."""
    values = values.astype(np.uint64)
    n = len(values)
    selector = np.zeros(n, np.uint8)
    widest = int(values.max()).bit_length() if n else 0
    # behind the end everything fits, so that the last word may be partly empty
    ahead = np.append(values, np.zeros(max(PER_WORD), np.uint64)).astype(np.uint32 if widest <= 32 else np.uint64)
    for k in reversed(range(len(PER_WORD))):
        per = PER_WORD[k]
        if widest <= 60 // per:
            selector[:] = k + 1
            continue
        fits, have = ahead < ahead.dtype.type(1 << 60 // per), 1
        while have < per:  # a place where ``have`` values in a row fit, and one behind it
            step = min(have, per - have)
            fits, have = fits[:-step] & fits[step:], have + step
        np.copyto(selector, k + 1, where=fits[:n])
    first = _walk(np.arange(n) + np.array([1, *PER_WORD])[selector])
    chosen = selector[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(max(PER_WORD), np.uint64)])
    for k, per in enumerate(PER_WORD):
        rows = np.flatnonzero(chosen == k + 1)
        if len(rows):
            at_rows, payload = first[rows], words[rows]
            for slot in range(per):
                payload |= padded[at_rows + slot] << np.uint64(slot * (60 // per))
            words[rows] = payload
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, values[first[escaped]]


def _walk(after: np.ndarray, stride: int = 16) -> np.ndarray:
    """The places met from 0 on, when ``after`` names the next of each: strides of 16 steps by doubling, then all between them."""
    n = len(after)
    if not n:
        return np.zeros(0, np.int64)
    steps = np.append(np.minimum(after, n), n)
    far = steps
    for _ in range(stride.bit_length() - 1):
        far = far[far]
    marks, at, jump = [], 0, far.item
    while at < n:
        marks.append(at)
        at = jump(at)
    rows = np.empty((stride, len(marks)), np.int64)
    rows[0] = marks
    for k in range(1, stride):
        rows[k] = steps[rows[k - 1]]
    met = rows.T.ravel()
    return met[met < n]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    room = np.array([1, *PER_WORD, 0])[selector]
    first = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(first[-1], np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for k, per in enumerate(PER_WORD):
        rows = np.flatnonzero(selector == k + 1)
        if len(rows):
            width = 60 // per
            slots = np.arange(per)
            mask = np.uint64((1 << width) - 1)
            out[first[rows][:, None] + slots] = (payload[rows][:, None] >> (slots * width).astype(np.uint64)) & mask
    escaped = np.flatnonzero(selector == 0)
    out[first[escaped]] = escapes[payload[escaped].astype(np.int64)]
    return out[:n]


def file_bytes(blocks: list[tuple[list[int | None], list[np.ndarray]]]) -> bytes:
    """A file of blocks of (document ids, ids of each document)."""
    heads, bodies = [], []
    offset, before = 16 + 48 * len(blocks), 0
    for doc_ids, lists in blocks:
        values = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        words, escapes = pack(values)
        nulls = bytes(d is None for d in doc_ids)
        body = b"".join([
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), nulls + bytes(-len(nulls) % 8),
            np.array([len(x) for x in lists], "<i8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
        ])
        heads.append([offset, before, len(values), len(doc_ids), len(words), len(escapes)])
        bodies.append(body)
        offset, before = offset + len(body), before + len(values)
    return MAGIC + np.array([len(blocks)], "<i8").tobytes() + np.array(heads, "<i8").tobytes() + b"".join(bodies)


def read_blocks(data: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """Of each block of a file: ids before it, document ids, ids per document, all its ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of packed ids")
    (n_blocks,) = np.frombuffer(data, "<i8", 1, 8)
    for offset, before, n, docs, n_words, n_escapes in np.frombuffer(data, "<i8", 6 * int(n_blocks), 16).reshape(-1, 6).tolist():
        ids = np.frombuffer(data, "<i8", docs, offset)
        nulls = np.frombuffer(data, np.uint8, docs, offset + 8 * docs)
        at = offset + 8 * docs + docs + -docs % 8
        lengths = np.frombuffer(data, "<i8", docs, at)
        words = np.frombuffer(data, "<u8", n_words, at + 8 * docs)
        escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * docs + 8 * n_words)
        yield before, [None if z else i for i, z in zip(ids.tolist(), nulls)], lengths, unpack(words, escapes, n)


@lru_cache(maxsize=2)
def _table(definition: str) -> UnitTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    return UnitTable(byte_level_encoder(tokenizer, np.array([len(b) for b in byte_level_entries(tokenizer)])), size=KEPT_UNITS)


def _encoded(known: UnitTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts one after the other, and where each text's start (one more at the end)."""
    different, places, begins = distinct_units(texts)
    values, sizes = known.ids(known.numbers([different]))
    ids, counts = gathered(values, np.concatenate([[0], np.cumsum(sizes)]), places)
    return ids, np.concatenate([[0], np.cumsum(counts)])[begins]


def write_tokens(docs: DataFrame, definition: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Encode all texts and write them in ascending order of their ids: the manifest and the folder of its files.

    ``definition`` is a byte-level tokenizer's own JSON, whose tokens start where a
    unit of white space and text starts; it travels with the tasks (bounded by the
    vocabulary). The manifest has (part, seq, name, n_docs, n_ids); files in order of
    part and seq hold the documents in order. NULL ids come first, rows with equal
    ids follow each other in order of their text's hash. NULL and empty texts have
    the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    # tasks write where Spark reads: the path with the scheme of the session's own file system
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    # the last key only splits a crowd of equal rows between tasks
    rows = rows.orderBy("id", F.xxhash64("text"), F.monotonically_increasing_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        known = _table(definition)
        part, seq = TaskContext.get().partitionId(), 0
        target, base = fs.FileSystem.from_uri(folder)
        blocks: list[tuple[list[int | None], list[np.ndarray]]] = []
        doc_ids: list[int | None] = []
        lists: list[np.ndarray] = []
        held = in_block = 0

        def flush() -> pa.RecordBatch:
            nonlocal blocks, doc_ids, lists, held, in_block, seq
            if doc_ids:
                blocks.append((doc_ids, lists))
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
            target.create_dir(base, recursive=True)
            with target.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(blocks))
            row = [part], [seq], [name], [sum(len(d) for d, _ in blocks)], [held]
            blocks, doc_ids, lists, held, in_block, seq = [], [], [], 0, 0, seq + 1
            kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "name", "n_docs", "n_ids"])

        for batch in chunks(batches, "text", CHUNK_BYTES):
            found, bounds = _encoded(known, batch.column("text"))
            for i, a, b in zip(batch.column("id").to_pylist(), bounds, bounds[1:]):
                ids = np.append(found[a:b], np.uint32(end_id))
                doc_ids.append(i)
                lists.append(ids)
                held, in_block = held + len(ids), in_block + len(ids)
                if in_block >= BLOCK_IDS:
                    blocks.append((doc_ids, lists))
                    doc_ids, lists, in_block = [], [], 0
                if held >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    return stage(rows.mapInArrow(write, "part int, seq int, name string, n_docs bigint, n_ids bigint")), folder


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of the manifest's files: (id, start, n_tokens, ids_crc32), with ``with_ids`` also ids (array<bigint>).

    ``start`` counts the ids of all documents before. Files are read by Spark and
    decoded block by block; one window runs over a row per part, the others inside the parts.
    """
    earlier = Window.unboundedPreceding, -1
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*earlier)), F.lit(0))
    files = manifest.withColumn("_inside", inside).join(parts, "part").select("name", (F.col("_before") + F.col("_inside")).alias("before"))
    if manifest.isEmpty():
        content = spark.createDataFrame([], "name string, content binary")
    else:
        content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
        content = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = content.join(files, "name").select("before", "content")
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base = batch.column("before")[k].as_py()
                for before, doc_ids, lengths, ids in read_blocks(batch.column("content")[k].as_py()):
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    small = ids.astype("<u4")
                    crcs = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(starts, ends)]
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(base + before + starts), pa.array(lengths), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return rows.mapInArrow(read, schema)
