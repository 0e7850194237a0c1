"""Line dedup over levelled sorted runs of line hashes.

A run is a stored table (key, n_docs) whose partitions are sorted by key. Each
batch of documents merge-anti-joins the keys that the runs have already found
frequent, counts its other keys, and adds them as a run of level 0. When a
level holds ``fan_out`` runs they are merged into one run of the next level, so
that a key is rewritten once per level and the number of runs stays
logarithmic in the number of batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame

from llm.common import F, free_name, stage

#: The white space that is stripped: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def key_hash(key: Column) -> Column:
    """128 bits of a line key: two rows share a hash only if their keys are equal."""
    return F.unhex(F.md5(key.cast("binary")))


def lines(text: Column) -> Column:
    """Lines of a text, split at ``\\n`` only; NULL or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_keys(text: Column, min_chars: int) -> Column:
    """Hashes of the different keys of a text that have at least ``min_chars`` code points."""
    keys = F.filter(F.array_distinct(F.transform(lines(text), line_key)), lambda k: F.length(k) >= min_chars)
    return F.transform(keys, key_hash)


@dataclass
class LineRuns:
    """Levelled runs; ``levels[i]`` lists the runs of level i, each a stored table sorted by key."""

    min_docs: int = 10
    fan_out: int = 3
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """Counts of all runs together."""
        return _merge(self.runs()) if self.runs() else None

    def frequent(self) -> DataFrame | None:
        """Keys found in at least ``min_docs`` documents so far."""
        merged = self.merged()
        return None if merged is None else merged.where(F.col("n_docs") >= self.min_docs).select("key")

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``keys`` has one row (key) per document and key.

        Keys that are frequent already stay so whatever the batch holds, and are left out.
        """
        counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
        known = self.frequent()
        if known is not None:
            counted = counted.join(known.hint("merge"), "key", "left_anti")
        self._put(0, stage(counted.sortWithinPartitions("key")))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = stage(_merge(self.levels[level]).sortWithinPartitions("key"))
            self.levels[level] = []
            self._put(level + 1, merged)


def _merge(runs: list[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, runs)
    return both if len(runs) == 1 else both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fan_out: int = 3,
    out: str = "line_dedup",
) -> DataFrame:
    """``docs`` with a struct column ``out`` (n_lines, n_dropped, kept text) added.

    A row of ``docs`` is a document, also when its id is NULL or repeated. NULL and
    empty texts have one empty line, whose key is too short to be dropped. Every
    line of a frequent key goes in every document, copies inside one document
    count once. A text that loses all lines becomes empty. An empty table gives
    an empty result. Other columns pass unchanged; ``out`` gets underscores in
    front if the name is taken.

    The documents come as ``batches`` deliveries, dealt by a hash of the text, each
    added to the runs in turn. Rows then meet the frequent keys on the text's hash,
    so that only hashes are joined by key and texts move once.
    """
    out, uid = free_name(docs, out), free_name(docs, "_text_hash")
    fingerprint = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keys = document_keys(F.col(text), min_chars)
    runs = LineRuns(min_docs, fan_out)
    for batch in range(batches):
        part = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(batches)) == batch)
        runs.add(part.select(F.explode(keys).alias("key")))
    frequent = stage(runs.frequent())
    # one row per different text: copies of a document share what is to be dropped
    texts = docs.select(fingerprint.alias(uid), keys.alias("keys")).select(uid, F.explode("keys").alias("key"))
    drops = (
        texts.join(frequent, "key", "left_semi")
        .groupBy(uid, "key")
        .agg(F.lit(1).alias("one"))
        .groupBy(uid)
        .agg(F.collect_list("key").alias("_drop"))
    )
    marked = docs.withColumn(uid, fingerprint).join(drops.withColumnRenamed("_drop", f"{uid}_drop"), uid, "left")
    drop = F.coalesce(F.col(f"{uid}_drop"), F.array().cast("array<binary>"))
    kept = F.filter(
        lines(F.col(text)),
        lambda line: (F.length(line_key(line)) < min_chars) | ~F.array_contains(drop, key_hash(line_key(line))),
    )
    n_lines = F.size(lines(F.col(text))).cast("bigint")
    # texts without a frequent line stay as they are
    whole = F.struct(
        n_lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    left = F.transform(F.array(kept), lambda k: F.struct(
        n_lines.alias("n_lines"), (n_lines - F.size(k)).alias("n_dropped"), F.array_join(k, "\n").alias("text")
    ))[0]
    result = F.when(F.size(drop) == 0, whole).otherwise(left)
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(out))
