"""Runs of periodically repeated words, by constant-time longest common extensions in suffix trees.

A run is a stretch of words whose smallest period q goes into it several times
and that no neighbouring word extends. Ukkonen's algorithm builds the suffix
trees of a stretch of words and of its reversal; an Euler tour of each tree and
a sparse table of the tour's minima give the depth of the lowest common ancestor of
two leaves, and so the longest common extension of two places, in constant
time. Every run has a root that is the longest Lyndon word from its first word on,
in one of two opposite orders of the words. The candidates are therefore one period
a place and order, each extended in both directions.

A run of ``min_length`` words holds no group of words (``GRAM`` in a row) that
occurs once only. Places outside such stretches are ruled out first, so that trees are
built for those parts of a text that can hold a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import F, chunks, free_name, mixed, texts_of

#: Words in a row of which a run of 24 words and three periods holds each at least twice (a third of its length, at most 8).
GRAM = 8
MIN_LENGTH = 24
MIN_PERIODS = 3


def suffix_tree(text: list[int]) -> tuple[list[int], dict[int, int]]:
    """Ukkonen's tree of ``text``: the lengths of the edges to its nodes, and the nodes by ``parent * width + first word``.

    ``text`` ends in a 0 that occurs nowhere else, so that every suffix has a leaf; width is its largest word plus 1.
    """
    n, width = len(text), max(text) + 1
    start, end, link = [0], [0], [0]
    edges: dict[int, int] = {}
    node = edge = length = rest = 0
    for i, word in enumerate(text):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * width + text[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                begin = start[child]
                size = min(end[child], i + 1) - begin
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if text[begin + length] == word:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                start += [begin, i]
                end += [begin + length, n]
                link += [0, 0]
                edges[key] = split
                edges[split * width + word] = split + 1
                start[child] = begin + length
                edges[split * width + text[begin + length]] = child
                if last:
                    link[last] = split
                last = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return [e - s for s, e in zip(start, end)], edges


class Extensions:
    """Longest common extensions to the right between any two places of a text."""

    def __init__(self, text: np.ndarray):
        words = [*text.tolist(), 0]
        n = len(words)
        self.sizes, edges = suffix_tree(words)
        width = max(words) + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.kids = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        parents = keys[order] // width
        self.ends_here = (keys[order] % width == 0).tolist()
        self.first = np.searchsorted(parents, np.arange(len(self.sizes) + 1)).tolist()
        self.depths = [0] * len(self.sizes)
        leaves, shallowest = self._tour()
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        # level k: minima of 2**k neighbouring stretches of the tour
        self.table = [np.array(shallowest, np.int32)]
        while 2 * (1 << len(self.table) - 1) <= len(shallowest):
            below, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(below[:-half], below[half:]))

    def _tour(self) -> tuple[list[int], list[int]]:
        """Suffixes in the order of their leaves; depth of the shallowest node the Euler tour meets between neighbours."""
        sizes, depths, kids, first = self.sizes, self.depths, self.kids, self.first
        n = len(self.sizes)
        leaves: list[int] = []
        shallowest: list[int] = []
        stack, above = [0], [0]
        turned = -1  # depth of the node where the tour left the last leaf's branch
        while stack:
            node, depth = stack.pop(), above.pop()
            if turned < 0:
                turned = depth
            depth += sizes[node]
            depths[node] = depth
            lo, hi = first[node], first[node + 1]
            if lo == hi and n > 1:
                leaves.append(depth)
                shallowest.append(turned)
                turned = -1
            else:
                stack += kids[lo:hi][::-1]
                above += [depth] * (hi - lo)
        whole = max(leaves)
        return [whole - d for d in leaves], shallowest[1:]

    def opposite_rank(self) -> np.ndarray:
        """Ranks of the suffixes when larger words come first; the end still comes before all words."""
        depths, kids, first, ends_here = self.depths, self.kids, self.first, self.ends_here
        leaves: list[int] = []
        stack = [0]
        while stack:
            node = stack.pop()
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                leaves.append(depths[node])
            elif ends_here[lo]:
                stack += kids[lo + 1 : hi]
                stack.append(kids[lo])
            else:
                stack += kids[lo:hi]
        depth = np.array(leaves)
        rank = np.empty(len(depth), np.int64)
        rank[depth.max() - depth] = np.arange(len(depth))
        return rank

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from ``i`` and ``j`` (different places, up to the text's length) have in common."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller suffix: the longest Lyndon word from a place on ends before it."""
    ranks = rank.tolist()
    out = [0] * (len(ranks) - 1)
    stack = [len(ranks) - 1]
    for i in range(len(ranks) - 2, -1, -1):
        own = ranks[i]
        while ranks[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs of a text of non-negative word numbers, by start and then period.

    A run has at least ``min_length`` words and ``min_periods`` (2 or more) periods; equal words are equal numbers.
    """
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    text = np.unique(words, return_inverse=True)[1] + 1
    right, left = Extensions(text), Extensions(text[::-1])
    place = np.arange(n)
    found = []
    for rank in (right.rank, right.opposite_rank()):
        after = _next_smaller(rank)
        period = after - place
        start = place - left(n - place, n - after)
        length = after + right(place, after) - start
        kept = length >= np.maximum(min_length, min_periods * period)
        found.append(np.stack([start, length, period], axis=1)[kept])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(words: np.ndarray, starts: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Rows (begin, end) of the stretches that can hold a run of ``MIN_LENGTH`` words and ``MIN_PERIODS`` periods.

    ``words`` are the word numbers of texts one after the other, text k begins at ``starts[k]``. In such a
    run every group of ``GRAM`` words occurs a second time, so that a run lies in a row of groups
    that their stretch holds twice. Rounds narrow the stretches; equal hashes of different groups only leave more.
    """
    bounds = np.stack([starts[:-1], starts[1:]], axis=1)
    for _ in range(rounds):
        bounds = bounds[bounds[:, 1] - bounds[:, 0] >= MIN_LENGTH]
        sizes = bounds[:, 1] - bounds[:, 0] - GRAM + 1
        owner = np.repeat(np.arange(len(bounds)), sizes)
        if not len(owner):
            break
        offset = np.cumsum(sizes) - sizes
        place = np.arange(len(owner)) + np.repeat(bounds[:, 0] - offset, sizes)
        group = mixed(owner)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                group = mixed(group + words[place + k].astype(np.uint64))
        order = np.argsort(group)
        same = group[order[1:]] == group[order[:-1]]
        twice = np.zeros(len(group), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # rows of such groups inside one stretch
        changed = np.diff(owner, prepend=-1) != 0
        begins = np.flatnonzero(twice & (changed | ~np.roll(twice, 1)))
        ends = np.flatnonzero(twice & (np.roll(changed, -1) | ~np.roll(twice, -1)))
        narrowed = np.stack([place[begins], place[ends] + GRAM], axis=1)
        if len(narrowed) == len(bounds) and (narrowed == bounds).all():
            break
        bounds = narrowed
    return bounds[bounds[:, 1] - bounds[:, 0] >= MIN_LENGTH]


def _better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether run ``a`` has more periods than ``b``; ties: smaller start, then smaller period."""
    more = a[1] * b[2] - b[1] * a[2]
    return more > 0 or (more == 0 and (a[0], a[2]) < (b[0], b[2]))


_FIELDS = "n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, most: struct<start: bigint, length: bigint, period: bigint>, collapsed: string"


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``out`` added: n_words, runs, most, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` are those of at least 24 words and
    three periods, by start and then period; ``most`` is the one with the greatest exact
    length / period (ties: smallest start, then period), NULL without runs. ``collapsed`` are the words joined by
    one space, without those that any run holds after its first period. NULL, empty and blank texts have
    no words, no runs and an empty ``collapsed``. Each row stands for itself, also
    when rows or ids repeat; other columns pass unchanged, ``out`` gets underscores in front if the
    name is taken. An empty table gives an empty result.
    """
    out, whole = free_name(docs, out), free_name(docs, "_whole_text")
    source = docs.withColumn(whole, F.col(text))
    schema = docs.withColumn(out, F.lit(None).cast(f"struct<{_FIELDS}>")).schema
    numbers = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(numbers)), ("most", numbers), ("collapsed", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, whole):
            split = [t.split() for t in texts_of(batch.column(whole))]
            starts = np.zeros(len(split) + 1, np.int64)
            np.cumsum([len(words) for words in split], out=starts[1:])
            flat = np.empty(starts[-1], object)
            for words, at in zip(split, starts):
                flat[at : at + len(words)] = words
            codes = pd.factorize(flat)[0]
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for begin, end in stretches(codes, starts).tolist():
                k = int(np.searchsorted(starts, begin, "right")) - 1
                shift = begin - int(starts[k])
                runs.setdefault(k, []).extend((s + shift, length, q) for s, length, q in find_runs(codes[begin:end]).tolist())
            rows = []
            for k, words in enumerate(split):
                own = sorted(runs.get(k, []), key=lambda r: (r[0], r[2]))
                most = None
                kept = words
                if own:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for run in own:
                        drop[run[0] + run[2]] += 1
                        drop[run[0] + run[1]] -= 1
                        if most is None or _better(run, most):
                            most = run
                    kept = flat[starts[k] : starts[k + 1]][np.cumsum(drop[:-1]) == 0].tolist()
                named = [dict(zip(("start", "length", "period"), r)) for r in ([most] if most else []) + own]
                rows.append({"n_words": len(words), "runs": named[1:], "most": named[0] if named else None, "collapsed": b" ".join(kept).decode()})
            others = [c for c in batch.schema.names if c != whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(rows, kind)], [*others, out])

    return source.mapInArrow(found, schema)
