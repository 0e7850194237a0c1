"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Items are grouped by size; a size class has one window of about 0.8 of the
item's words, and every such window of every item is fingerprinted. Documents
are fingerprinted at strides so short that any passage that keeps enough of an
item holds a whole window of it. A 64-bit fingerprint is cut into four blocks
of 16 bits; looking each block up with up to one bit flipped finds all
fingerprints within 7 bits. Each candidate is then compared exactly: weighted
similarity of its word shingles with those of the item-sized window it points to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import F, chunks, free_name, mixed, texts_of, with_source

WIDTH = 5
PERCENT = 80
RADIUS = 7
BLOCKS = 4
MOST_WEIGHT = 12
#: Words of a window, at most: its lanes must hold less than 2^16. Longer items have several windows.
MOST_WINDOW = (1 << 16) // MOST_WEIGHT - 1
#: Items that one pass over the documents looks for: what is sent to the tasks is bounded by it, more items take more passes.
ITEMS_PER_PASS = 2_000
#: Words that are fingerprinted at once inside a task.
SEGMENT = 1 << 15
TEXT_BYTES = 500_000

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + _PUNCTUATION, bytes(range(97, 123)) + b" " * len(_PUNCTUATION))


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.translate(_NORMAL).split()


def weight(word: bytes) -> int:
    """Longer words say more; the weight needs no look at the corpus."""
    return min(len(word), MOST_WEIGHT)


def window_size(length: int) -> int:
    """Words of the window for an item of ``length`` words: a step of a geometric scale, at most 0.8 of the item where that leaves a shingle."""
    if length <= WIDTH:
        return length
    size, most = WIDTH, max(WIDTH, int(0.8 * length))
    while max(size + 1, size * 6 // 5) <= min(most, MOST_WINDOW):
        size = max(size + 1, size * 6 // 5)
    return size


def _lost(length: int) -> int:
    """Shingles that a passage may lose at an end and still reach the similarity."""
    n = max(length - WIDTH + 1, 1)
    return n * (100 - PERCENT) // (100 + PERCENT)


def shingle_weights(words: list[bytes]) -> dict[tuple[bytes, ...], int]:
    """The different shingles of a window with their weights; fewer words than a shingle has are one shingle."""
    if not words:
        return {}
    width = min(WIDTH, len(words))
    return {s: sum(map(weight, s)) for s in zip(*(words[k:] for k in range(width)))}


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    both = sum(w for s, w in a.items() if s in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def _vectors(unique: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word: its weight in each of 64 lanes of 16 bits whose hash bit is set (as 16 words of 64 bits), and its weight."""
    import xxhash

    hashes = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique)))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    weights = np.minimum(np.fromiter(map(len, unique), np.int64, len(unique)), MOST_WEIGHT)
    return (bits * weights.astype(np.uint16)[:, None]).view(np.uint64), weights


def _running(vectors: np.ndarray) -> np.ndarray:
    """Running sums. Lanes run over into each other, yet the difference over a window is right: its own lanes hold less than 2^16."""
    sums = np.zeros((len(vectors) + 1, *vectors.shape[1:]), vectors.dtype)
    np.cumsum(vectors, axis=0, dtype=vectors.dtype, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, weights: np.ndarray, size: int, stride: int = 1, phase: int = 0) -> np.ndarray:
    """SimHash of the windows of ``size`` words from each ``stride``-th word on: a bit is set where words with it outweigh the others."""
    ends, totals = sums[phase + size :: stride], weights[phase + size :: stride]
    lanes = (ends - sums[phase::stride][: len(ends)]).view(np.uint16)
    half = (totals - weights[phase::stride][: len(ends)]) >> 1
    return np.packbits(lanes > half.astype(np.uint16)[:, None], axis=1).view("<u8").ravel()


@dataclass
class SizeClass:
    """Fingerprints of all windows of the items of a class, with look-up tables of their blocks."""

    size: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, own fingerprint) of all pairs within RADIUS bits."""
        windows, owns = [], []
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        for b, (known, bounds, order) in enumerate(self.tables):
            hit = np.flatnonzero(known[blocks[:, b]])
            if not len(hit):
                continue
            key = blocks[hit, b].astype(np.int64)
            low = bounds[key]
            count = bounds[key + 1] - low
            window = np.repeat(hit, count)
            inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            own = order[np.repeat(low, count) + inside]
            close = np.bitwise_count(prints[window] ^ self.prints[own]) <= RADIUS
            windows.append(window[close])
            owns.append(own[close])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(windows), np.concatenate(owns)


def _tables(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: which keys occur, bounds of each 16-bit key, and the fingerprints whose block is that key or one bit away from it."""
    flips = np.array([0, *(1 << k for k in range(16))])
    tables = []
    for b in range(BLOCKS):
        block = prints.view(np.uint16).reshape(-1, BLOCKS)[:, b].astype(np.int64)
        keys = (block[:, None] ^ flips).ravel()
        order = np.argsort(keys, kind="stable")
        bounds = np.searchsorted(keys[order], np.arange(65537))
        tables.append((np.diff(bounds) > 0, bounds, order // len(flips)))
    return tables


class ItemIndex:
    """The items of one pass; built again in each task from their texts."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of((t or "").encode()) for _, t in items]
        self.shingles = [shingle_weights(w) for w in self.words]
        by_size: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if words:
                by_size.setdefault(window_size(len(words)), []).append(k)
        self.classes = [self._size_class(size, members) for size, members in sorted(by_size.items())]
        self.longest = max(by_size, default=0)

    def _size_class(self, size: int, members: list[int]) -> SizeClass:
        prints, item, offset = [], [], []
        room = min(len(self.words[k]) - _lost(len(self.words[k])) - size + 1 for k in members)
        for k in members:
            first = np.arange(len(self.words[k]) - size + 1)
            vectors, weights = _vectors(self.words[k])
            prints.append(_fingerprints(_running(vectors), _running(weights), size))
            item.append(np.full(len(first), k))
            offset.append(first)
        # half of what a passage without inner changes needs, so that changed ones hold several windows
        all_prints = np.concatenate(prints)
        return SizeClass(size, max(1, room // 2), all_prints, np.concatenate(item), np.concatenate(offset), _tables(all_prints))

    def hits(self, documents: list[list[bytes]]) -> list[list[tuple[int, float, int]]]:
        """Per document: (item, similarity, first word) of the best window of every item found."""
        import pandas as pd

        lengths = np.array([len(d) for d in documents], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.empty(starts[-1], object)
        for k, words in enumerate(documents):
            flat[starts[k] : starts[k + 1]] = words
        codes, unique = pd.factorize(flat)
        vectors, weights = _vectors(list(unique))
        owner = np.repeat(np.arange(len(documents)), lengths)
        found: set[tuple[int, int, int]] = set()
        for a in range(0, len(flat), SEGMENT):
            stop = min(a + SEGMENT + self.longest, len(flat))
            sums, totals = _running(vectors[codes[a:stop]]), _running(weights[codes[a:stop]])
            for c in self.classes:
                if stop - a < c.size:
                    continue
                phase = -a % c.stride
                prints = _fingerprints(sums, totals, c.size, c.stride, phase)
                first = a + phase + c.stride * np.arange(len(prints))
                inside = np.flatnonzero(owner[first] == owner[first + c.size - 1])
                window, own = c.near(prints[inside])
                at = first[inside[window]]
                begin = at - c.offset[own]
                found.update(zip(owner[at].tolist(), c.item[own].tolist(), begin.tolist()))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for doc, item, begin in found:
            low, high = max(begin, starts[doc]), min(begin + len(self.words[item]), starts[doc + 1])
            score = similarity(self.shingles[item], shingle_weights(flat[low:high].tolist()))
            if score * 100 >= PERCENT:
                here = (score, -int(low - starts[doc]))
                best[doc, item] = max(best.get((doc, item), here), here)
        out: list[list[tuple[int, float, int]]] = [[] for _ in documents]
        for (doc, item), (score, begin) in sorted(best.items()):
            out[doc].append((item, score, -begin))
        return out


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", items_per_pass: int = ITEMS_PER_PASS
) -> DataFrame:
    """``docs`` with an array column ``out`` of structs (item_id, similarity, start): the items that the text contains.

    ``start`` counts the document's words before the passage; an item found in
    several places has its best one, the first among equals. NULL and empty texts,
    and items without words, match nothing. Items with equal texts or NULL ids are
    reported each. Rows with NULL or repeated ids are judged by their own text.
    Other columns pass unchanged; ``out`` gets underscores in front if the name is taken.
    """
    out = free_name(docs, out)
    kind = "array<struct<item_id: bigint, similarity: double, start: bigint>>"
    struct = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64())])
    source, whole = with_source(docs, text, "_whole_text")
    result = source.withColumn(out, F.array().cast(kind))
    schema = result.schema
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator()

    def one_pass(items: list[tuple[int | None, str | None]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items)
            for batch in chunks(batches, whole, TEXT_BYTES):
                hits = index.hits([words_of(t) for t in texts_of(batch.column(whole))])
                before = batch.column(out).to_pylist()
                now = [
                    [*old, *({"item_id": index.ids[k], "similarity": s, "start": at} for k, s, at in new)] for old, new in zip(before, hits)
                ]
                columns = [pa.array(now, pa.list_(struct)) if c == out else batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return run

    while items := [(r["item_id"], r["text"]) for r in islice(rows, items_per_pass)]:
        result = result.mapInArrow(one_pass(items), schema)
    return result if whole in docs.columns else result.drop(whole)
