"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the different words, word pairs, and pairs with one word skipped of
a document. Every coordinate has its own learning rate; the L1 term keeps the
weights of all but telling features at exactly zero, so that the model is a
short sorted table of (hash, weight) that travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from llm.common import F, chunks, free_name, hashed_words, mixed, sampled_labels, texts_of

#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 16_000
#: Features of fewer sampled documents get no weight.
LEAST_DOCS = 2
#: Bits of a feature's hash.
SPACE_BITS = 31

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + _PUNCTUATION, bytes(range(97, 123)) + b" " * len(_PUNCTUATION))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, pair and skip-pair of whole texts, repeats included."""
    hashes, starts = hashed_words([t.translate(_NORMAL).split() for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    docs, found = [owner], [hashes]
    with np.errstate(over="ignore"):
        for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            inside = owner[:-gap] == owner[gap:]
            found.append(mixed(hashes[:-gap] * np.uint64(factor) + hashes[gap:])[inside])
            docs.append(owner[:-gap][inside])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - SPACE_BITS)).astype(np.int32)


@dataclass(frozen=True)
class Weights:
    """Sorted hashes with their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; a feature counts once in a document."""
        docs, found = features(texts)
        margin = np.full(len(texts), self.bias)
        if len(self.hashes):
            low = np.zeros(1 << 20, bool)
            low[self.hashes & 0xFFFFF] = True
            maybe = np.flatnonzero(low[found & 0xFFFFF])
            at = np.minimum(np.searchsorted(self.hashes, found[maybe]), len(self.hashes) - 1)
            sure = self.hashes[at] == found[maybe]
            pairs = np.unique(docs[maybe[sure]].astype(np.int64) * len(self.hashes) + at[sure])
            margin += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_ftrl(
    rows: list[np.ndarray],
    labels: np.ndarray,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.1,
    passes: int = 3,
    least_docs: int = LEAST_DOCS,
    seed: int = 7,
) -> Weights:
    """FTRL-proximal over documents given as arrays of different features. Without rows, nothing is toxic."""
    if not len(labels):
        return Weights(np.zeros(0, np.int32), np.zeros(0), -4.0)
    flat = np.concatenate(rows)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    # counted by the low bits and piece by piece, so that memory stays small
    counts, pieces = np.zeros(1 << 22, np.int32), range(0, len(flat), 1 << 20)
    for a in pieces:
        counts += np.bincount(flat[a : a + (1 << 20)] & 0x3FFFFF, minlength=1 << 22).astype(np.int32)
    frequent = np.concatenate([counts[flat[a : a + (1 << 20)] & 0x3FFFFF] >= least_docs for a in pieces])
    kept_before = np.concatenate([[0], np.cumsum(frequent)])
    hashes, local = np.unique(flat[frequent], return_inverse=True)
    bounds = kept_before[bounds]
    del flat, frequent, counts, kept_before
    z, n = np.zeros(len(hashes)), np.zeros(len(hashes))
    bias_z = bias_n = 0.0

    def weight(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    bias = 0.0
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(labels)):
            idx = local[bounds[k] : bounds[k + 1]]
            zz, nn = z[idx], n[idx]
            w = weight(zz, nn)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -40, 40)))
            g = p - labels[k]
            step = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[idx] = zz + g - step * w
            n[idx] = nn + g * g
            bias_step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - bias_step * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return Weights(hashes[kept].astype(np.int32), w[kept], float(bias))


def held_out(id_column: Column) -> Column:
    """Whether no label of the row may be learnt: crc32 of the id as text, modulo 4, is 2. NULL ids count as held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, column: str = "toxic") -> Weights:
    """The model from at most ``sample_rows`` labelled documents that are not held out.

    Their features meet in one task (bounded by the sample); only the weights reach the driver.
    """
    chosen = sampled_labels(labels.where(~held_out(F.col("doc_id"))), column, sample_rows)
    # a bounded number of rows of two numbers, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            owner, found = features(texts_of(batch.column("text")))
            pairs = np.unique((owner.astype(np.int64) << SPACE_BITS) | found)
            cuts = np.searchsorted(pairs >> SPACE_BITS, np.arange(batch.num_rows + 1))
            flat = (pairs & ((1 << SPACE_BITS) - 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "found"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, ids = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            marks += batch.column("label").to_pylist()
            lists = batch.column("found")
            flat, cuts = lists.flatten().to_numpy().copy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            rows += np.split(flat, cuts[:-1]) if len(cuts) else []
        # the order of arrival must not matter; a repeated id counts once
        first = {}
        for k in sorted(range(len(ids)), key=lambda k: (ids[k], len(rows[k]), rows[k][:1].tolist())):
            first.setdefault(ids[k], k)
        model = fit_ftrl([rows[k] for k in first.values()], np.array([marks[k] for k in first.values()], float))
        columns = [pa.array([model.hashes], pa.list_(pa.int32())), pa.array([model.weights], pa.list_(pa.float64())), pa.array([model.bias])]
        yield pa.RecordBatch.from_arrays(columns, ["hashes", "weights", "bias"])

    sample = texts.mapInArrow(hashed, "doc_id bigint, label int, found array<int>")
    row = sample.repartition(1).mapInArrow(fitted, "hashes array<int>, weights array<double>, bias double").first()
    if row is None:
        return fit_ftrl([], np.zeros(0))
    return Weights(np.array(row["hashes"], np.int32), np.array(row["weights"], float), row["bias"])


def with_toxicity(docs: DataFrame, model: Weights, text: str = "text", threshold: float = 0.3, out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out`` added: score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the whole text is looked at. NULL and empty texts have the score of the
    bias. Rows with NULL or repeated ids are scored by their own text; an empty
    table gives an empty result. Other columns pass unchanged; ``out`` gets
    underscores in front if the name is taken.
    """
    out, whole = free_name(docs, out), free_name(docs, "_whole_text")
    source = docs.withColumn(whole, F.col(text))
    schema = docs.withColumn(out, F.lit(None).cast("struct<score: double, predicted: int>")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, whole):
            score = model.scores(texts_of(batch.column(whole)))
            verdict = pa.StructArray.from_arrays([pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["score", "predicted"])
            others = [c for c in batch.schema.names if c != whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), verdict], [*others, out])

    return source.mapInArrow(scored, schema)
