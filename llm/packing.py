"""Packing of token pieces into sequences of a fixed size, by a grouping genetic algorithm on islands.

Pieces are dealt into shards of bounded size by a hash. Every shard is bred on several
islands, each with a population of its own. A gene is a whole sequence: crossover injects
well-filled sequences of one parent into the other, takes out the sequences that hold a piece
twice, and puts the displaced pieces back by best fit. Between epochs the best
individuals of an island migrate to the next one. A shard leaves as soon as it needs no more
sequences than its lower bound.

What a shard's best individual leaves badly filled is dealt anew, with that of the other
shards, into far fewer shards of the next level, until one shard is left.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.byte_bpe import byte_characters
from llm.common import F, UnitCache, chunks, free_name, stage

#: Pieces of a shard on average; hashes of different numbers deal them evenly.
SHARD_PIECES = 4096
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 80
POPULATION = 6
#: Individuals that migrate between epochs.
ELITE = 2
#: A sequence with more than this part of its room free is dealt anew at the next level.
LOOSE = 1 / 256


#: Characters whose lower case and class are the same everywhere, and that no normal form changes: printable Latin, and white space.
_PLAIN = "\t-\r -~\xa1-\u012f\u0131-\u024f"


class WordCoder:
    """Ids of whole texts by a tokenizer whose parts share no token, inside a task.

    Where the tokenizer is one of lower case, a split by a pattern and word ends, texts of plain characters are split here; new parts
    are encoded many in a row by the tokenizer's own model, and cut behind the tokens that end a word. All other texts go
    word by word (ASCII white space in between) through the tokenizer itself. Both are kept, up to 500,000 each.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        steps = [[x["type"] for x in (spec[k] or {}).get(f"{k}s".replace("_", ""), [])] for k in ("normalizer", "pre_tokenizer")]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.words = UnitCache(lambda new: [x.ids for x in self.whole.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)], 500_000)
        self.plain = None
        if suffix and steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and all(c + suffix in spec["model"]["vocab"] for c in byte_characters()):
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            for kind in "LN":
                members = "".join(re.escape(chr(c)) for c in range(33, 0x250) if unicodedata.category(chr(c))[0] == kind)
                pattern = pattern.replace(f"\\p{{{kind}}}", members)
            self.plain, self.split = re.compile(f"[{_PLAIN}]+").fullmatch, re.compile(pattern).findall
            self.model = Tokenizer.from_str(definition)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.array([t.endswith(suffix) for t, _ in sorted(self.whole.get_vocab().items(), key=lambda x: x[1])])
            self.parts = UnitCache(self._encode_parts, 500_000)

    def _encode_parts(self, new: list[str], in_row: int = 500) -> list[bytes]:
        out: list[bytes] = []
        rows = [" ".join(new[k : k + in_row]) for k in range(0, len(new), in_row)]
        for x in self.model.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(x.ids, "<u4")
            data, at = ids.tobytes(), 0
            for cut in (4 * np.flatnonzero(self.ends[ids]) + 4).tolist():
                out.append(data[at:cut])
                at = cut
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end token."""
        # special tokens are matched in the raw text
        plain = [k for k, t in enumerate(texts) if self.plain and self.plain(t) and "<|" not in t]
        others = sorted(set(range(len(texts))).difference(plain))
        out = [b""] * len(texts)
        for k, ids in zip(plain, self.parts.ids_of([self.split(texts[k].lower()) for k in plain]) if plain else ()):
            out[k] = ids
        for k, ids in zip(others, self.words.ids_of([texts[k].encode().split() for k in others])):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def _coder(definition: str) -> WordCoder:
    return WordCoder(definition)


def token_pieces(docs: DataFrame, definition: str, end_id: int, size: int = 4096, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids of every row, cut where they are longer than ``size``: (id, piece, start, length, ids).

    ``definition`` is the JSON of a tokenizer that drops white space and never joins what it
    parts, so that words are encoded once and kept; it travels with the tasks. ``end_id`` follows each text. ``ids`` are
    little-endian unsigned 32-bit integers, ``piece`` counts from 0, ``start`` is the number of the document's ids before it.
    NULL and empty texts have the end id alone. Rows with equal or NULL ids are rows of their own; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    kinds = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition)
        for batch in chunks(batches, "text"):
            out = []
            found = coder.ids([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("id").to_pylist(), found):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(part) // 4, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], list(kinds))

    return rows.mapInArrow(cut, "id bigint, piece int, start bigint, length bigint, ids binary")


def least_sequences(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the sequences that pieces need: beside long ones only short enough pieces fit (bound of Martello and Toth)."""
    if not len(lengths):
        return 0
    up = np.sort(lengths)
    sums = np.concatenate([[0], np.cumsum(up)])
    half = np.searchsorted(up, size / 2, "right")
    # pieces below ``small`` are left out, those above size - small share a sequence with none of the rest
    small = np.unique(np.concatenate([[0], up[:half]]))
    low, high = np.searchsorted(up, small, "left"), np.searchsorted(up, size - small, "right")
    alone, wide = len(up) - high, high - half
    room = wide * size - (sums[high] - sums[half])
    rest = np.maximum(sums[half] - sums[low] - room, 0)
    return int((alone + wide + -(-rest // size)).max())


class Packing:
    """One individual: the sequence of each piece, and the room left in each sequence. Lengths fall from piece to piece."""

    __slots__ = ("places", "free")

    def __init__(self, places: np.ndarray, free: np.ndarray):
        self.places, self.free = places, free

    @classmethod
    def of(cls, places: np.ndarray, lengths: np.ndarray, size: int) -> Packing:
        return cls(places, size - np.bincount(places, weights=lengths).astype(np.int64))

    def fitness(self, size: int) -> tuple[int, int]:
        """Fewer sequences are fitter, then those that leave their free room in few of them."""
        return -len(self.free), int(((size - self.free) ** 2).sum())


def best_fit(pieces: list[int], places: np.ndarray, free: np.ndarray, lengths: np.ndarray, size: int) -> Packing:
    """Each piece goes where least room stays, else into a new sequence."""
    n = len(free)
    free = np.concatenate([free, np.full(len(pieces), -1)])
    for i in pieces:
        left = free[:n] - lengths[i]
        fits = np.flatnonzero(left >= 0)
        if len(fits):
            k = fits[left[fits].argmin()]
        else:
            k, n = n, n + 1
            free[k] = size
        free[k] -= lengths[i]
        places[i] = k
    return Packing(places, free[:n])


def exchange(displaced: list[int], places: np.ndarray, free: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Displaced pieces take the places of shorter ones where they fill the sequence better; who is displaced in the end."""
    rest, pending = [], displaced[::-1]
    while pending:
        i = pending.pop()
        gain = lengths[i] - lengths[i + 1 :]
        owners = places[i + 1 :]
        fits = np.flatnonzero((owners >= 0) & (gain > 0) & (gain <= free[owners]))
        if len(fits):
            j = i + 1 + int(fits[gain[fits].argmax()])
            free[places[j]] -= lengths[i] - lengths[j]
            places[i], places[j] = places[j], -1
            insort(pending, j, key=lambda x: -x)
        else:
            rest.append(i)
    return rest


def crossover(a: Packing, b: Packing, lengths: np.ndarray, size: int, rng: random.Random) -> Packing:
    """A child of ``a`` with some well-filled sequences of ``b``, and with its own loosest one dissolved."""
    filled = np.flatnonzero(b.free <= b.free.mean())
    injected = np.array(rng.sample(filled.tolist(), rng.randint(1, max(1, len(filled) // 16))))
    number = np.full(len(b.free), -1)
    number[injected] = np.arange(len(injected))
    taken = number[b.places] >= 0
    hit = np.zeros(len(a.free), bool)
    hit[a.places[taken]] = True
    hit[a.free.argmax()] = True
    hit[rng.randrange(len(hit))] = True
    kept = np.cumsum(~hit) - 1
    places = np.where(hit[a.places], -1, kept[a.places]).astype(np.int32)
    places[taken] = (~hit).sum() + number[b.places[taken]]
    free = np.concatenate([a.free[~hit], b.free[injected]])
    displaced = exchange(np.flatnonzero(places < 0).tolist(), places, free, lengths)
    return best_fit(sorted(displaced), places, free, lengths, size)


def evolve(lengths: np.ndarray, size: int, population: list[Packing], seed: str, generations: int = GENERATIONS) -> list[Packing]:
    """The island's population after some generations, fittest first; ``lengths`` fall. A missing population is founded.

    It ends early once an individual needs no more sequences than the lower bound.
    """
    rng = random.Random(seed)
    least = least_sequences(lengths, size)

    def founded(order: list[int]) -> Packing:
        return best_fit(order, np.empty(len(lengths), np.int32), np.zeros(0, np.int64), lengths, size)

    if not population:
        plain = lengths.tolist()
        population = [founded(list(range(len(plain))))]
        while len(population) < POPULATION and len(population[0].free) > least:
            population.append(founded(sorted(range(len(plain)), key=lambda i: -plain[i] * rng.uniform(0.8, 1.25))))
    ranked = sorted(((p.fitness(size), k, p) for k, p in enumerate(population)), reverse=True)
    born = len(ranked)
    for _ in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = (ranked[min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))][2] for _ in range(2))
        child = crossover(a, b, lengths, size, rng)
        fitness = child.fitness(size)
        if fitness > ranked[-1][0] and all(fitness != f for f, _, _ in ranked):
            born += 1
            ranked = sorted([*ranked[: POPULATION - 1], (fitness, born, child)], reverse=True)
    return [p for _, _, p in ranked[:POPULATION]]


_ISLAND = "shard bigint, island int, keys array<bigint>, lengths array<int>, population array<array<int>>, n_bins int, settled boolean"


def _breed(states: DataFrame, size: int, seed: str) -> DataFrame:
    """One epoch on every island; ``population`` may hold migrants besides."""

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _ISLAND.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard, island = row.column("shard")[0].as_py(), row.column("island")[0].as_py()
                lengths = row.column("lengths").flatten().to_numpy().astype(np.int64)
                old = [Packing.of(np.array(p.as_py(), np.int32), lengths, size) for p in row.column("population").flatten()]
                bred = evolve(lengths, size, old, f"{seed}-{shard}-{island}")
                least = least_sequences(lengths, size)
                genes = pa.array([[p.places for p in bred]], pa.list_(pa.list_(pa.int32())))
                best = len(bred[0].free)
                columns = [*(row.column(c) for c in names[:4]), genes, pa.array([best], pa.int32()), pa.array([best <= least])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return states.select(*[f.split()[0] for f in _ISLAND.split(", ")][:5]).mapInArrow(epoch, _ISLAND)


def _spread(best: DataFrame, size: int, level: int, last: bool) -> DataFrame:
    """(key, length, sequence_id, offset, loose) of every piece of the shards' best individuals."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths, keys, places = (row.column(c).flatten().to_numpy().astype(np.int64) for c in ("lengths", "keys", "places"))
                order = np.argsort(places, kind="stable")
                sums = np.cumsum(lengths[order]) - lengths[order]
                starts = np.searchsorted(places[order], np.arange(places.max() + 1))
                free = size - np.bincount(places, weights=lengths)
                loose = free > LOOSE * size
                if 2 * loose.sum() > len(free):
                    loose = np.arange(len(free)) == free.argmax()
                bins = places[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order]), pa.array(lengths[order].astype(np.int32)),
                        pa.array((level << 56) + (row.column("shard")[0].as_py() << 20) + bins),
                        pa.array(sums - sums[starts][bins]), pa.array(loose[bins] & (not last)),
                    ],
                    ["key", "length", "sequence_id", "offset", "loose"],
                )

    return best.mapInArrow(placed, "key bigint, length int, sequence_id bigint, offset bigint, loose boolean")


def _level(pieces: DataFrame, n: int, size: int, level: int, islands: int, epochs: int) -> DataFrame:
    """All of ``pieces`` (key, length; n rows) placed inside their shards."""
    shards = -(-n // SHARD_PIECES)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)))
    held = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(-F.col("length"), "key"))).alias("p"))
    state = held.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("p.key").alias("keys"),
        F.transform("p", lambda x: -x["col1"]).alias("lengths"),
        F.lit(None).cast("array<array<int>>").alias("population"),
    )
    # few shards would else meet in one task
    state = stage(_breed(state.repartition(F.expr("shard"), F.expr("island")), size, f"{level}-0"))
    every = [state]
    for epoch in range(1, epochs):
        settled = state.groupBy("shard").agg(F.max("settled").alias("any")).where("NOT any").select("shard")
        open_ = state.join(settled, "shard")
        migrants = open_.select(
            "shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("population", 1, ELITE).alias("guests")
        )
        mixed = open_.join(migrants, ["shard", "island"]).withColumn("population", F.concat("population", "guests"))
        state = stage(_breed(mixed, size, f"{level}-{epoch}"))
        every.append(state)
    found = every[0]
    for more in every[1:]:
        found = found.unionAll(more)
    # later states of a shard come behind; the island's number settles ties
    ranked = found.select("shard", "n_bins", "island", "keys", "lengths", F.element_at("population", 1).alias("places"))
    chosen = F.min_by(F.struct("keys", "lengths", "places"), F.struct("n_bins", "island", "places"))
    best = ranked.groupBy("shard").agg(chosen.alias("b")).select("shard", "b.*")
    return stage(_spread(best, size, level, last=shards == 1))


def pack(pieces: DataFrame, length: str = "length", size: int = 4096, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (bigint) added: who shares a sequence, and where its tokens begin there.

    Sequences hold at most ``size`` tokens without gaps from offset 0; their numbers are unique, not dense. A
    ``length`` above ``size`` is an error; rows whose length is NULL or below 1 get NULL twice. Equal rows are pieces of their own;
    all columns pass unchanged, the new ones get underscores in front if a name is taken. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    key, sequence, offset = (free_name(pieces, c) for c in ("_piece_key", "sequence_id", "offset"))
    whole = stage(pieces.withColumn(key, F.monotonically_increasing_id()))
    lengths = whole.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("length")).where("length >= 1")
    n, longest = lengths.agg(F.count_if(F.col("length") < size), F.max("length")).first()
    if longest is not None and longest > size:
        raise ValueError(f"a piece of {longest} tokens does not fit {size}")
    full = lengths.where(F.col("length") == size)
    placed = full.select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = lengths.where(F.col("length") < size).withColumn("length", F.col("length").cast("int"))
    level = 0
    while n:
        found = _level(rest, n, size, level, islands, epochs)
        placed = placed.unionAll(found.where("NOT loose").select("key", "sequence_id", "offset"))
        rest = found.where("loose").select("key", "length")
        n, level = rest.count(), level + 1
    named = placed.withColumnsRenamed({"key": key, "sequence_id": sequence, "offset": offset})
    return whole.join(named, key, "left").drop(key)


def whole_sequences(packed: DataFrame, sequence: str = "sequence_id", offset: str = "offset", ids: str = "ids") -> DataFrame:
    """(sequence_id, n_pieces, ids): the tokens of each sequence as they lie in it, a bounded group of at most its size."""
    parts = packed.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("sequence_id"))
    parts = parts.agg(F.sort_array(F.collect_list(F.struct(F.col(offset).alias("at"), F.col(ids).alias("ids")))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return parts.select("sequence_id", F.size("p").cast("bigint").alias("n_pieces"), joined.alias("ids"))
