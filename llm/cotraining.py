"""Quality classifier by co-training of two views.

One classifier sees the text's content (document statistics), the other the
page's metadata (language, source, stated length). Over some rounds each labels
the unlabelled documents that it is surest of for the other. Each view is then
calibrated on labelled documents that it did not learn from, and both calibrated
log odds are combined by a small logistic regression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm import trees
from llm.common import F, chunks, free_name, sampled_labels, texts_of
from llm.quality_rules import MONOTONE, statistics
from llm.toxicity import held_out

#: Labelled and unlabelled documents that the classifiers are fitted on, at most.
LABELLED_ROWS = 6_000
POOL_ROWS = 6_000
ROUNDS = 3
#: A view passes on documents with at least this confidence, per round and label at most this share of the pool.
CONFIDENT = 0.95
SHARE = 0.05
#: One-hot columns that the values of a metadata column are hashed to.
BUCKETS = 48


def metadata(langs: list[str | None], sources: list[str | None], lengths: list[int | None]) -> np.ndarray:
    """Metadata features; a NULL has a column of its own."""
    x = np.zeros((len(langs), 2 * (BUCKETS + 1) + 2))
    for i, values in enumerate(zip(langs, sources)):
        for part, value in enumerate(values):
            at = BUCKETS if value is None else zlib.crc32(value.encode()) % BUCKETS
            x[i, part * (BUCKETS + 1) + at] = 1
    stated = np.array([-1 if n is None else n for n in lengths], float)
    x[:, -2], x[:, -1] = np.log1p(np.maximum(stated, 0)), stated < 0
    return x


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights and bias (last) by Newton steps; a constant where one label is missing."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + l2 * w)
    return w


@dataclass(frozen=True)
class CoTrained:
    content: trees.Trees
    meta: trees.Trees
    calibration: np.ndarray  # per view: slope and offset
    combination: np.ndarray  # weights of both views and the bias

    def views(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views."""
        raw = np.stack([self.content.margin(content), self.meta.margin(meta)], axis=1)
        return raw * self.calibration[:, 0] + self.calibration[:, 1]

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        odds = self.views(content, meta) @ self.combination[:2] + self.combination[2]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrates: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """``y``: 1, 0, or -1 for unlabelled; labelled rows in ``calibrates`` are kept out of the fits."""
    fits = [(x, dict(depth=3, rounds=40, monotone=m)) for x, m in ((content, MONOTONE), (meta, None))]
    own = [np.where(calibrates, -1, y).astype(float) for _ in fits]
    pool = np.flatnonzero(y < 0)
    most = max(1, int(len(pool) * SHARE))

    def models() -> list[trees.Trees]:
        return [trees.fit(x[t >= 0], t[t >= 0], **kw) for (x, kw), t in zip(fits, own)]

    for _ in range(rounds):
        for view, model in enumerate(models()):
            other = own[1 - view]
            open_rows = pool[other[pool] < 0]
            if not len(open_rows):
                continue
            p = model.probability(fits[view][0][open_rows])
            order = np.argsort(p, kind="stable")
            good, bad = order[::-1][:most], order[:most]
            other[open_rows[good[p[good] >= CONFIDENT]]] = 1
            other[open_rows[bad[p[bad] <= 1 - CONFIDENT]]] = 0
    last = models()
    marked = calibrates & (y >= 0) if (calibrates & (y >= 0)).any() else y >= 0
    margins = [m.margin(x[marked]) for (x, _), m in zip(fits, last)]
    calibration = np.stack([logistic(m[:, None], y[marked]) for m in margins])
    model = CoTrained(*last, calibration, np.array([1.0, 1.0, 0.0]))
    return CoTrained(*last, calibration, logistic(model.views(content[marked], meta[marked]), y[marked]))


def _features(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    meta = metadata(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    return statistics(texts_of(batch.column(text)))[1], meta


def fit_cotraining(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained:
    """The classifiers from bounded samples of ``docs`` (doc_id, text, lang, source, n_chars), chosen by a hash of the id.

    No label of a held-out document is learnt. Without usable labels every score is one half.
    """
    usable = labels.where(~held_out(F.col("doc_id")))
    chosen = sampled_labels(usable, "quality", labelled_rows)
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rest = ids.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").orderBy(F.xxhash64(F.col("doc_id"), F.lit("pool")), "doc_id")
    chosen = chosen.unionAll(rest.limit(pool_rows).select("doc_id", F.lit(-1).alias("label")))
    # a bounded number of rows of two numbers, so it may be broadcast
    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).join(F.broadcast(chosen), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            columns = [batch.column("doc_id"), batch.column("label")] + [pa.array(list(x), pa.list_(pa.float64())) for x in _features(batch, "text")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "content", "meta"])

    sample = rows.mapInArrow(measured, "doc_id bigint, label int, content array<double>, meta array<double>")
    sample = sample.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("content").alias("content"), F.min("meta").alias("meta"))
    found = sample.orderBy("doc_id").toPandas()
    if not (found["label"] >= 0).any():
        flat = trees.constant(0.5)
        return CoTrained(flat, flat, np.array([[1.0, 0.0]] * 2), np.array([0.5, 0.5, 0.0]))
    calibrates = np.array([zlib.crc32(str(i).encode()) % 4 == 3 for i in found["doc_id"]])
    return co_train(np.stack(found["content"]), np.stack(found["meta"]), found["label"].to_numpy(), calibrates)


def with_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` added: content_score, meta_score, score (0 to 1) and kept (from ``threshold`` on).

    Scores look at the whole text and at lang, source and n_chars. A NULL text is
    empty, NULL metadata counts as a value. Rows with NULL or repeated ids are
    scored by themselves; an empty table gives an empty result. Other columns pass
    unchanged; ``out`` gets underscores in front if the name is taken.
    """
    out, names = free_name(docs, out), {c: free_name(docs, f"_view_{c}") for c in ("text", "lang", "source", "n_chars")}
    source = docs
    for c, name in names.items():
        source = source.withColumn(name, F.col(c).cast("bigint") if c == "n_chars" else F.col(c))
    schema = docs.withColumn(out, F.lit(None).cast("struct<content_score: double, meta_score: double, score: double, kept: boolean>")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names["text"]):
            seen = pa.RecordBatch.from_arrays([batch.column(n) for n in names.values()], list(names))
            content, meta = _features(seen, "text")
            views = 1 / (1 + np.exp(-np.clip(model.views(content, meta), -40, 40)))
            score = model.score(content, meta)
            columns = [pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(score), pa.array(score >= threshold)]
            result = pa.StructArray.from_arrays(columns, ["content_score", "meta_score", "score", "kept"])
            others = docs_columns(batch, names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), result], [*others, out])

    return source.mapInArrow(scored, schema)


def docs_columns(batch: pa.RecordBatch, added: dict[str, str]) -> list[str]:
    return [c for c in batch.schema.names if c not in added.values()]
