"""Near-duplicate groups by min-max hashing.

Every permutation gives two signature values, the smallest and the largest, so
64 permutations yield 128 values: 32 bands of two minima and two maxima. Two
sets with similarity 0.8 share a band with probability above 1 - 1e-7.

Documents with the same set of shingles form a class; classes are the nodes.
Inside a bucket classes are compared with a leader first, and only what lies in
different components afterwards is compared further, in blocks inside tasks. So
a large group of copies or near copies costs a number of pairs in proportion to
its size. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from llm.common import F, chunks, free_name, hashed_words, mixed, stage, texts_of
from llm.components import components, joined

PERMUTATIONS = 64
BANDS = 32
#: Members of a bucket that one step inside a task compares with as many others.
BLOCK = 128
#: How often the rest of a bucket is compared with a leader before blocks.
LEADER_ROUNDS = 2

#: Permutations of the sketches that the blocks compare: 512 values, so that an estimate of 0.8 has a deviation below 0.018.
SKETCH_PERMUTATIONS = 256
#: Percent that an estimate may lie below the similarity before a pair of a block is ruled out: 3.6 deviations.
SLACK = 6.5

_MULTIPLIERS = mixed(np.arange(1, SKETCH_PERMUTATIONS + 1)) | np.uint64(1)
_OFFSETS = mixed(np.arange(1001, SKETCH_PERMUTATIONS + 1001))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: what bytes.lower and bytes.split do."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> frozenset[bytes]:
    """The set itself, for the exact comparison."""
    words = words_of(text)
    if len(words) < width:
        return frozenset([b" ".join(words)]) if words else frozenset()
    return frozenset(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different 64-bit shingle hashes of each text, one after the other, and where each text starts."""
    hashes, starts = hashed_words([words_of(t) for t in texts])
    n = np.diff(starts)
    parts: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        rolled = np.full(max(len(hashes) - width + 1, 0), width, np.uint64)
        for k in range(width):
            rolled = mixed(rolled + hashes[k : k + len(rolled)])
        for i, count in enumerate(n):
            if count >= width:
                parts.append(np.unique(rolled[starts[i] : starts[i + 1] - width + 1]))
            else:
                key = np.full(min(count, 1), count, np.uint64)
                for h in hashes[starts[i] : starts[i + 1]]:
                    key = mixed(key + h)
                parts.append(key)
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def signatures(keys: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Min-max signatures (two values a permutation) of non-empty sets: minima first, then maxima, of each permutation."""
    out = np.empty((len(bounds) - 1, 2 * permutations), np.uint32)
    high = np.uint64(32)
    with np.errstate(over="ignore"):
        for p in range(permutations):
            moved = keys * _MULTIPLIERS[p] + _OFFSETS[p]
            out[:, p] = np.minimum.reduceat(moved, bounds[:-1]) >> high
            out[:, permutations + p] = np.maximum.reduceat(moved, bounds[:-1]) >> high
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Band hashes (sets x 32) from minima 2b, 2b+1 and maxima 2b+2, 2b+3, so that no permutation occurs twice in a band."""
    wide = signature.astype(np.uint64)
    per = PERMUTATIONS // BANDS
    first = np.arange(BANDS) * per
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(wide), BANDS))
        for k in range(per):
            key = mixed(key + wide[:, first + k])
            key = mixed(key + wide[:, PERMUTATIONS + (first + per + k) % PERMUTATIONS])
    return key.view(np.int64)


def _sets_of(texts: list[bytes], width: int) -> tuple[np.ndarray, list[bytes | None], list[np.ndarray | None]]:
    keys, bounds = shingle_hashes(texts, width)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    marks: list[bytes | None] = [None] * len(texts)
    bands: list[np.ndarray | None] = [None] * len(texts)
    if len(full):
        starts = bounds[:-1][full]
        ends = np.append(starts, len(keys))
        with np.errstate(over="ignore"):
            low, high = np.add.reduceat(mixed(keys + np.uint64(7)), starts), np.add.reduceat(mixed(keys ^ np.uint64(0x5DEECE66D)), starts)
        for at, i in enumerate(full):
            marks[i] = int(low[at]).to_bytes(8, "big") + int(high[at]).to_bytes(8, "big")
        for i, row in zip(full, bands_of(signatures(keys, ends))):
            bands[i] = row
    return sizes, marks, bands


def text_hash(text: Column) -> Column:
    """128 bits that stand for the text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _measured(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """(id, th, n, mark, bands) of every row; mark and bands are NULL for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sizes, marks, bands = _sets_of(texts_of(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "th", "n", "mark", "bands"],
            )

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, th binary, n bigint, mark binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have at least ``percent`` similarity; ``texts`` has (node, text)."""
    sides = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    sides = sides.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, frozenset[bytes]] = OrderedDict()

        def of(key: int, text: bytes) -> frozenset[bytes]:
            if key not in kept:
                kept[key] = shingle_set(text, width)
                if len(kept) > 16:
                    kept.popitem(last=False)
            kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            linked = []
            a, b = batch.column("a"), batch.column("b")
            for i, (u, v) in enumerate(zip(us, vs)):
                x = of(u, (a[i].as_py() or "").encode())
                y = of(v, (b[i].as_py() or "").encode())
                shared = len(x & y)
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            chosen = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(chosen), batch.column("v").filter(chosen)], ["u", "v"])

    return sides.mapInArrow(run, "u bigint, v bigint")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (h, node, n) of the buckets that hold several components, with their component; stored."""
    named = members.join(found, "node", "left").select("h", "node", "n", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("h").agg(F.min("component").alias("_a"), F.max("component").alias("_z")).where("_a <> _z").select("h")
    return stage(named.join(several, "h", "left_semi"))


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, bands, sketch): the bands once more, and the low bytes of a longer signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            keys, bounds = shingle_hashes(texts_of(batch.column("text")), width)
            signature = signatures(keys, bounds, SKETCH_PERMUTATIONS)
            low, high = signature[:, :PERMUTATIONS], signature[:, SKETCH_PERMUTATIONS : SKETCH_PERMUTATIONS + PERMUTATIONS]
            bands = bands_of(np.hstack([low, high]))
            sketches = [row.tobytes() for row in (signature & 255).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sketches)], ["node", "bands", "sketch"])

    return texts.mapInArrow(run, "node bigint, bands array<bigint>, sketch binary")


def _block_rows(named: DataFrame, sketches: DataFrame) -> DataFrame:
    """What is left to compare, in blocks: every member of a bucket in one block, and again, as a probe, in all blocks
    every member outside the bucket's largest component. Sorted by (h, block).

    Two members in different components are not both in the largest one, so that each
    pair meets; and a large group with a few strays is copied once, not squared.
    """
    sizes = named.groupBy("h", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("m"))
    rows = named.join(largest, "h")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    home = rows.select("h", "node", "n", "component", F.pmod(F.hash("node"), blocks).alias("block"), F.lit(False).alias("probe"))
    probes = rows.where("component <> top.component").select(
        "h", "node", "n", "component", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("probe")
    )
    both = home.unionAll(probes).join(sketches, "node")
    return both.repartition("h", "block").sortWithinPartitions("h", "block")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal keys, as one table each."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        values = np.stack([now.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for start, stop in zip(edges, edges[1:]):
            yield now.slice(start, stop - start)
        held = now.slice(edges[-1])
    if held is not None:
        yield held


def _block_pairs(percent: int):
    """Pairs of a probe and a member of its block that lie in different components, for rows sorted by (h, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("h", "block")):
            h = group.column("h")[0].as_py()
            probe = group.column("probe").to_numpy()
            node, n, component = (group.column(c).to_numpy() for c in ("node", "n", "component"))
            bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            home = np.flatnonzero(~probe)
            us, vs = [], []
            for x in np.flatnonzero(probe):
                small, large = np.minimum(n[x], n[home]), np.maximum(n[x], n[home])
                others = home[(100 * small >= percent * large) & (component[home] != component[x])]
                others = others[100 * (sketch[others] == sketch[x]).mean(axis=1) >= percent - SLACK]
                if len(others):
                    # a pair belongs to the first of the bands that it shares
                    own = bands[x][(bands[others] == bands[x]).argmax(axis=1)] == h
                    us.append(np.minimum(node[x], node[others[own]]))
                    vs.append(np.maximum(node[x], node[others[own]]))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (us, vs)], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(th, n_shingles, component, component_id): one row per different text, th = :func:`text_hash`.

    ``component`` names the group, ``component_id`` is its smallest id (NULL if all
    its ids are NULL). A text without words has an empty set, no component and no
    component_id: it is linked with nothing. Texts with fewer than ``width`` words
    have one shingle, the whole sequence. Rows with the same id and different
    texts are different documents. An empty table gives an empty result.
    """
    rows = stage(_measured(docs, id_column, text, width))
    # equal sets are one node, with a number of its own and the smallest of its text hashes
    classes = rows.where("n > 0").groupBy("mark").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()))
    buckets = classes.select("node", "n", F.explode("bands").alias("h"))
    leaders = buckets.groupBy("h").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).where("lead.node <> last")
    members = stage(buckets.join(leaders.select("h", "lead"), "h").select("h", "node", "n", "lead"))
    wanted = members.select("node").distinct().join(classes.select("node", "th"), "node")
    texts = docs.select(text_hash(F.col(text)).alias("th"), F.col(text).alias("text")).join(wanted, "th", "left_semi")
    texts = texts.groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th").select("node", "text")
    texts = stage(texts)

    pairs = members.where((F.col("node") != F.col("lead.node")) & _fits("n", "lead.n", percent))
    pairs = stage(pairs.select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct())
    found = components(_verified(pairs, texts, width, percent))
    named = members.select("h", "node", "n")
    for turn in range(LEADER_ROUNDS):
        named = _unsettled(named, found)
        leads = named.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "node", F.lit(turn)).alias("o"), "node", "n", "component")).alias("lead"))
        more = named.join(leads, "h").where((F.col("component") != F.col("lead.component")) & _fits("n", "lead.n", percent))
        more = more.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct()
        more = stage(more.join(pairs, ["u", "v"], "left_anti"))
        found = joined(found, _verified(more, texts, width, percent))
        pairs = pairs.unionAll(more)
        named = named.drop("component")

    named = _unsettled(named, found)
    sketches = _sketches(texts.join(named.select("node").distinct(), "node", "left_semi"), width)
    more = stage(_block_rows(named, stage(sketches)).mapInArrow(_block_pairs(percent), "u bigint, v bigint").distinct())
    more = more.join(pairs, ["u", "v"], "left_anti")
    found = joined(found, _verified(more, texts, width, percent))

    named = classes.select("mark", "node").join(found, "node", "left").select("mark", F.coalesce("component", "node").alias("component"))
    by_text = rows.groupBy("th").agg(F.first("mark").alias("mark"), F.first("n").alias("n_shingles"), F.min("id").alias("least"))
    by_text = stage(by_text.join(named, "mark", "left").select("th", "n_shingles", "component", "least"))
    smallest = by_text.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    return by_text.join(smallest, "component", "left").select("th", "n_shingles", "component", "component_id")


def with_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, out: str = "near_dup"
) -> DataFrame:
    """``docs`` with a struct column ``out`` added: n_shingles, component, component_id, kept.

    ``kept`` holds for rows whose id is the component's smallest one. A document
    without words is its own component. Rows with a NULL id take part; they are
    kept only where no row of the component has an id. ``out`` gets underscores in
    front if the name is taken.
    """
    out, key = free_name(docs, out), free_name(docs, "_th")
    found = near_duplicates(docs, id_column, text, width, percent)
    named = F.struct("n_shingles", "component", "component_id").alias(f"{key}_found")
    found = found.select(F.col("th").alias(key), named)
    both = docs.withColumn(key, text_hash(F.col(text))).join(found, key)
    own, f = F.col(f"`{id_column}`").cast("bigint"), f"{key}_found"
    smallest = F.when(F.col(f"{f}.component").isNull(), own).otherwise(F.col(f"{f}.component_id"))
    result = F.struct(
        F.col(f"{f}.n_shingles").alias("n_shingles"), F.col(f"{f}.component").alias("component"),
        smallest.alias("component_id"), own.eqNullSafe(smallest).alias("kept"),
    )
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(out))
