"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

The end offsets of a text are two sorted lists. Every offset of the shorter list is
looked for in the longer one by galloping: exponential steps away from its proportional
place until it is enclosed, then a binary search in between, all offsets
of a block of texts at once. The common offsets cut both lists into groups; the differences of
their ranks are the groups' token ranges. The last tokens of a group are linked.

How often two ids are linked is counted over all texts. A block of texts names each pair of ids
once, with the number of its links, so that counting, and bringing the counts back, shuffles
different pairs of a block rather than links, and no pair is on more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.byte_bpe import _field
from llm.common import F, UnitTable, byte_level_encoder, byte_level_entries, chunks, gathered, stage, units

#: Text bytes of a block.
BLOCK_BYTES = 3_000_000
#: Units a task keeps.
KEPT_UNITS = 500_000
#: Stands for a unit whose tokens do not spell it.
UNFAITHFUL = (1 << 32) - 1


@dataclass(frozen=True)
class Tokenizers:
    """What tasks need, bounded by the two vocabularies.

    ``first``: a byte-level tokenizer's own JSON, ``second``: a serialised sentencepiece model. Tokens
    of the first must start where a unit of white space and text starts; pieces of the second hold
    spaces only in front and line feeds only by themselves, which is checked.
    """

    first: str
    second: bytes

    @classmethod
    def load(cls, first_path: str, second_path: str) -> Tokenizers:
        with open(first_path, encoding="utf-8") as text, open(second_path, "rb") as model:
            return cls(text.read(), model.read())


def _checked(encode: Callable, spelled: list[bytes], sizes: np.ndarray) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """``encode`` with the single id ``UNFAITHFUL`` for a unit that its tokens do not spell."""

    def checked(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = encode(new)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        wanted = [u.encode() for u in new]
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[bounds])
        words = list(map(spelled.__getitem__, ids.tolist()))
        # with equal lengths, equal bytes of all units are equal bytes of each
        if [*map(len, wanted)] == lengths.tolist() and b"".join(words) == b"".join(wanted):
            return ids, counts
        bad = np.full(1, UNFAITHFUL, np.uint32)
        found = [ids[a:b] if b"".join(words[a:b]) == w else bad for w, a, b in zip(wanted, bounds, bounds[1:])]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    return checked


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)


class Coder:
    """Both tokenizers inside a task: ids of texts, and the bytes of ids."""

    def __init__(self, tokenizers: Tokenizers):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(tokenizers.first)
        first.encode_special_tokens = True
        # units carry their own space in front: a second normaliser message, which readers merge with the first, adds none
        second = SentencePieceProcessor(model_proto=tokenizers.second + _field(3, _field(3, 0)))
        self.first_bytes = byte_level_entries(first)
        self.second_bytes = []
        inner: set[str] = set()  # white space that a piece holds behind a character
        for i in range(second.get_piece_size()):
            piece = second.id_to_piece(i)
            if second.is_byte(i):
                self.second_bytes.append(bytes([int(piece[3:-1], 16)]))
                continue
            plain = piece.replace("▁", " ")
            if not (second.is_control(i) or second.is_unknown(i)):
                inner.update(part[0] for part in units(plain)[1:])
            self.second_bytes.append(plain.encode())
        if inner & {" ", "\n"}:
            raise ValueError("a piece holds a space or line feed behind a character")
        self.inner = re.compile(f"[{re.escape(''.join(inner))}]").search if inner else lambda text: None
        # merges do not cross these either, whatever the text
        self.second_units = re.compile("\n| *[^ \n]+| +").findall
        self.first_sizes = np.array([len(b) for b in self.first_bytes], np.int64)
        self.second_sizes = np.array([len(b) for b in self.second_bytes], np.int64)
        self.known = UnitTable(
            _checked(byte_level_encoder(first, self.first_sizes), self.first_bytes, self.first_sizes),
            _checked(lambda new: _flat(second.encode(new, num_threads=1)), self.second_bytes, self.second_sizes),
            size=KEPT_UNITS,
        )
        # decimal ids with what follows them: the next of the group, or the end of the group's list
        self.printed = [f"{i}{c}" for i in range(len(self.first_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.second_bytes)) for c in ",;"]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both: ids of a space and each text one after the other, and where each text's start (one more at the end).

        Texts that are empty, or that one of the two does not spell, have none.
        """
        spaced = [" " + t for t in texts]
        split = [units(t) for t in spaced]
        odd = {k: self.second_units(t) for k, t in enumerate(spaced) if self.inner(t)}
        # texts that the second splits in another way come once more behind the others
        numbers = self.known.numbers([*split, *odd.values()])
        begin = np.concatenate([[0], np.cumsum([len(found) for found in (*split, *odd.values())], dtype=np.int64)])
        own = np.arange(len(texts))
        own[list(odd)] = len(texts) + np.arange(len(odd))
        usable = np.array([t != "" for t in texts], bool)
        both = []
        for k, chosen in enumerate((np.arange(len(texts)), own)):
            ids, counts = self.known.ids(numbers, k)
            bounds = np.concatenate([[0], np.cumsum(counts)])[begin]
            if odd:
                ids, counts = gathered(ids, bounds, chosen)
                bounds = np.concatenate([[0], np.cumsum(counts)])
            usable &= np.diff(np.concatenate([[0], np.cumsum(ids == UNFAITHFUL)])[bounds]) == 0
            both.append((ids, bounds))
        if not usable.all():
            kept = np.flatnonzero(usable)
            for k, (ids, bounds) in enumerate(both):
                sizes = np.where(usable, np.diff(bounds), 0)
                both[k] = gathered(ids, bounds, kept)[0], np.concatenate([[0], np.cumsum(sizes)])
        return [(ids.astype(np.int64), starts) for ids, starts in both]


@lru_cache(maxsize=2)
def _coder(tokenizers: Tokenizers) -> Coder:
    return Coder(tokenizers)


def gallop(values: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value the first place of ``ends`` in ``first`` to ``last`` (exclusive) that is not below it, else ``last``.

    ``ends`` rises inside each such range, ``guess`` is a place in it. Steps of 1, 2, 4, … lead
    away from the guess until the value is enclosed; a binary search follows.
    """
    up = ends[guess] < values
    left = np.where(up, guess, first - 1)  # below the value, or in front of the range
    right = np.where(up, last, guess)  # not below it, or behind the range
    active, step = np.arange(len(values), dtype=guess.dtype), 1
    while len(active):
        probe = guess[active] + np.where(up[active], guess.dtype.type(step), guess.dtype.type(-step))
        inside = (probe >= first[active]) & (probe < last[active])
        active, probe = active[inside], probe[inside]
        less = ends[probe] < values[active]
        left[active[less]] = probe[less]
        right[active[~less]] = probe[~less]
        active = active[less == up[active]]
        step *= 2
    active = np.flatnonzero(right - left > 1).astype(guess.dtype)
    while len(active):
        middle = (left[active] + right[active]) >> 1
        less = ends[middle] < values[active]
        left[active[less]] = middle[less]
        right[active[~less]] = middle[~less]
        active = active[right[active] - left[active] > 1]
    return right


def common_ends(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the offsets that both hold, of texts one after the other.

    Text k has the rising offsets ``a[a_starts[k]:a_starts[k + 1]]``, likewise in ``b``, and no text shares an offset with the next.
    """
    marked = np.zeros(len(a), bool), np.zeros(len(b), bool)
    sides = (a, a_starts), (b, b_starts)
    for short, long in ((0, 1), (1, 0)):
        (values, starts), (ends, begins) = sides[short], sides[long]
        sizes, others = np.diff(starts), np.diff(begins)
        chosen = np.flatnonzero((sizes <= others if short == 0 else sizes < others) & (sizes > 0))
        n = sizes[chosen]
        rank = np.arange(n.sum(), dtype=n.dtype) - np.repeat((np.cumsum(n) - n).astype(n.dtype), n)
        at = np.repeat(starts[:-1][chosen], n) + rank
        first, last = np.repeat(begins[:-1][chosen], n), np.repeat(begins[1:][chosen], n)
        # both in proportion: the rank times the other list's share of this one
        guess = np.minimum(first + (rank * np.repeat(others[chosen] / n, n)).astype(n.dtype), last - 1)
        found = gallop(values[at], ends, first, last, guess)
        met = found < last
        met[met] = ends[found[met]] == values[at[met]]
        marked[short][at[met]] = True
        marked[long][found[met]] = True
    return np.flatnonzero(marked[0]), np.flatnonzero(marked[1])


_BLOCK = (
    "ids: array<bigint>, n_a: array<int>, n_b: array<int>, n_groups: array<int>, groups: array<string>, "
    "link_starts: array<int>, link_pair: array<int>, link_n: array<int>, pairs: array<bigint>, totals: array<bigint>"
)
_RESULT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, n_links bigint, n_best bigint, count_sum bigint"


def _block(coder: Coder, doc_ids: pa.Array, texts: list[str], digests: bool) -> pa.RecordBatch:
    """One row of all texts: sizes, groups, and each text's links as numbers of the block's different pairs."""
    (a, a_starts), (b, b_starts) = coder.ids(texts)
    # the two spell the same bytes, so that offsets may run on from text to text
    ends_a, ends_b = np.cumsum(coder.first_sizes[a]), np.cumsum(coder.second_sizes[b])
    # a block seldom needs long integers
    kind = np.int32 if not len(a) or ends_a[-1] < 1 << 30 else np.int64
    in_a, in_b = common_ends(ends_a.astype(kind), a_starts.astype(kind), ends_b.astype(kind), b_starts.astype(kind))
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[in_a] = 1
    closes_b[in_b] = 1
    n_groups = np.diff(np.concatenate([[0], np.cumsum(closes_a)])[a_starts])
    # a group's tokens of a, then those of b: every token moves behind the other list's tokens of the groups before
    printed = np.empty(len(a) + len(b), np.int64)
    b_before, a_until = np.concatenate([[0], in_b + 1]), np.concatenate([in_a + 1, [0]])
    printed[np.arange(len(a)) + b_before[np.cumsum(closes_a) - closes_a]] = 2 * a + closes_a
    printed[np.arange(len(b)) + a_until[np.cumsum(closes_b) - closes_b]] = 2 * (len(coder.first_bytes) + b) + closes_b
    groups = []
    for lo, hi in zip(a_starts[:-1] + b_starts[:-1], a_starts[1:] + b_starts[1:]):
        text = "".join(map(coder.printed.__getitem__, printed[lo:hi].tolist()))[:-1]
        groups.append(hashlib.sha256(text.encode()).hexdigest() if digests and text else text)
    number, pairs = pd.factorize(a[in_a] * len(coder.second_bytes) + b[in_b])
    width = max(len(pairs), 1)
    linked, times = np.unique(np.repeat(np.arange(len(texts)), n_groups) * width + number, return_counts=True)
    link_starts = np.searchsorted(linked, np.arange(len(texts) + 1) * width)
    columns = [
        (doc_ids, pa.int64()), (np.diff(a_starts), pa.int32()), (np.diff(b_starts), pa.int32()), (n_groups, pa.int32()), (groups, pa.string()),
        (link_starts, pa.int32()), (linked % width, pa.int32()), (times, pa.int32()), (pairs, pa.int64()), (np.bincount(number, minlength=len(pairs)), pa.int64()),
    ]
    arrays = [pa.array([values if isinstance(values, pa.Array) else pa.array(values, kind, safe=True)], pa.list_(kind)) for values, kind in columns]
    return pa.RecordBatch.from_arrays(arrays, [f.split(":")[0] for f in _BLOCK.split(", ")])


def align(docs: DataFrame, tokenizers: Tokenizers, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: (id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum).

    A space and the text are encoded by the first tokenizer (a) and the second (b), special
    tokens being plain text. ``groups`` lists the groups' ids as ``a1,a2|b1;a3|b2,b3``, with ``digests`` its SHA-256. A
    link is a token of each that end at the same byte; a pair of ids counts as often as it
    is linked in all texts. n_best are the links whose count is the highest that their id of
    b has, count_sum is the sum of all links' counts. Texts that are NULL or empty, or that one of the two does
    not spell exactly, have no tokens: zeros and an empty ``groups``. Rows with equal or NULL ids are rows of their own
    and all count; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizers)
        for batch in chunks(batches, "text", BLOCK_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield _block(coder, batch.column("id"), texts, digests)

    schema = ", ".join(_BLOCK.replace(":", "").split(", "))
    blocks = stage(rows.mapInArrow(blocks_of, schema).withColumn("block", F.monotonically_increasing_id()))
    width = _second_size(tokenizers)
    named = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("number", "x")).select(
        "block", "number", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total")
    )
    counts = named.groupBy("pair").agg(F.sum("total").alias("n")).withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = stage(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    # a block has at most as many different pairs as links, bounded by its bytes
    back = named.select("block", "number", "pair").join(counts, "pair").groupBy("block")
    back = back.agg(F.sort_array(F.collect_list(F.struct("number", "n", "best"))).alias("counted"))
    joined = blocks.drop("pairs", "totals").join(back, "block", "left")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RESULT.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c).slice(k, 1).flatten() for c in batch.schema.names if c != "block"}
                n, best = (row["counted"].field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "best"))
                pair, times = row["link_pair"].to_numpy(), row["link_n"].to_numpy().astype(np.int64)
                at = row["link_starts"].to_numpy()
                sums = (np.concatenate([[0], np.cumsum(x)])[at] for x in (times * best[pair], times * n[pair]))
                n_best, count_sum = (pa.array(np.diff(x)) for x in sums)
                wide = [row[c].cast(pa.int64()) for c in ("n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([row["ids"], *wide, row["groups"], wide[2], n_best, count_sum], names)

    return joined.mapInArrow(results, _RESULT)


def _second_size(tokenizers: Tokenizers) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=tokenizers.second).get_piece_size()
