"""Centred cross-product blocks of row vectors, and correlations read off them.

A self-join of cells would emit n·F² rows. Here each task multiplies its own
rows block by block and emits F² numbers in all; the blocks of all tasks are
merged as a stream, so no task holds more than one block pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from featwright.functions.ranks import average_ascending, with_ranks
from featwright.sources.tables import vectors_of

BLOCK = 256
_HELD_BYTES = 256 << 20  # products a task holds before it emits them
_BLOCK_FIELDS = (
    "bi int, bj int, n double, mean_i array<double>, mean_j array<double>, "
    "squares_i array<double>, squares_j array<double>, products array<double>"
)


def _merge(a: tuple, b: tuple) -> tuple:
    """Add one block ``(n, mean_i, mean_j, squares_i, squares_j, products)`` to another (pairwise update of co-moments)."""
    n_a, mi_a, mj_a, si_a, sj_a, p_a = a
    n, mean_i, mean_j, squares_i, squares_j, products = b
    total = n_a + n
    di, dj = mean_i - mi_a, mean_j - mj_a
    part = n_a * n / total
    return (
        total,
        mi_a + di * (n / total),
        mj_a + dj * (n / total),
        si_a + squares_i + di * di * part,
        sj_a + squares_j + dj * dj * part,
        p_a + products + np.outer(di, dj) * part,
    )


def _partial_blocks(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        size = 0

        def emit():
            columns: list[list] = [[] for _ in schema]
            for (key, bi, bj), (n, *parts, p) in held.items():
                row = [*key, bi, bj, float(n), *parts, p.ravel()]
                for column, cell in zip(columns, row):
                    column.append(cell)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            rows = values.reshape(batch.num_rows, -1)
            if keys:
                frame = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
                groups = frame.groupby(keys, dropna=False, sort=False).indices.items()
            else:
                groups = [((), slice(None))]
            for key, index in groups:
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else (int(k) if isinstance(k, (float, np.floating, np.integer)) else k) for k in key)
                x = rows[index]
                mean = x.mean(axis=0)
                x = x - mean
                squares = (x * x).sum(axis=0)
                for bi in range(0, x.shape[1], BLOCK):
                    for bj in range(bi, x.shape[1], BLOCK):
                        p = x[:, bi : bi + BLOCK].T @ x[:, bj : bj + BLOCK]
                        i, j = slice(bi, bi + BLOCK), slice(bj, bj + BLOCK)
                        block = (len(x), mean[i], mean[j], squares[i], squares[j], p)
                        name = (key, bi // BLOCK, bj // BLOCK)
                        if name in held:
                            held[name] = _merge(held[name], block)
                        else:
                            held[name] = block
                            size += p.nbytes
            if size > _HELD_BYTES:
                yield emit()
                held, size = {}, 0
        if held:
            yield emit()

    return run


def _merge_stream(columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merged = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                sides = [np.asarray(x) for x in (row.mean_i, row.mean_j, row.squares_i, row.squares_j)]
                block = (row.n, *sides, np.asarray(row.products).reshape(len(sides[0]), len(sides[1])))
                if merged is None:
                    merged, head = block, [getattr(row, c) for c in columns]
                else:
                    merged = _merge(merged, block)
        if merged is not None:
            names = ["n", "mean_i", "mean_j", "squares_i", "squares_j", "products"]
            out = dict(zip(columns, head)) | dict(zip(names, merged))
            yield pd.DataFrame([out | {"products": merged[-1].ravel()}])

    return run


def _typed(frames_fn):
    """Keys that are NULL come to pandas as NaN; hand them back as NULL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames_fn(frames):
            yield frame.astype(object).where(frame.map(lambda c: not (isinstance(c, float) and np.isnan(c))), None)

    return run


def gram_blocks(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Upper-triangle blocks per key: ``(keys…, bi, bj, n, mean_i, mean_j, squares_i, squares_j, products)``.

    ``products`` are sums of ``(x_i - mean_i)(x_j - mean_j)``, row by row; ``squares`` those of ``(x - mean)²``.
    """
    keys = list(keys)
    fields = [vectors.schema[k] for k in keys] + list(T._parse_datatype_string(_BLOCK_FIELDS).fields)
    schema = T.StructType(fields)
    partial = vectors.select(*keys, "features").mapInArrow(_partial_blocks(keys, to_arrow_schema(schema)), schema)
    by = [*keys, "bi", "bj"]
    # with many tasks, merge in two steps so that no merge reads from all of them
    salts = vectors.sparkSession.sparkContext.defaultParallelism // 32
    if salts > 1:
        salted = partial.withColumn("_salt", F.spark_partition_id() % salts)
        wide = T.StructType([*fields, T.StructField("_salt", T.IntegerType())])
        partial = salted.groupBy(*by, "_salt").applyInPandas(_typed(_merge_stream([*by, "_salt"])), wide).drop("_salt")
    return partial.groupBy(*by).applyInPandas(_typed(_merge_stream(by)), schema)


def correlations(vectors: DataFrame, keys: Sequence[str] = (), prefix: str = "f_", at_most: float | None = None) -> DataFrame:
    """Pearson's r for every pair of features of every split; NULL where one is constant.

    With ``at_most``, only pairs with |r| up to it leave the task that holds their block.
    """
    keys = list(keys)
    blocks = gram_blocks(vectors, keys).select(*keys, "bi", "bj", "squares_i", "squares_j", "products")
    fields = [vectors.schema[k] for k in keys] + list(T._parse_datatype_string("ord_i int, ord_j int, r double").fields)
    schema = T.StructType(fields)
    names = schema.names

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                si, sj, p = (row.column(c).flatten().to_numpy() for c in ("squares_i", "squares_j", "products"))
                bi, bj = row.column("bi")[0].as_py(), row.column("bj")[0].as_py()
                size = np.outer(np.sqrt(si), np.sqrt(sj))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where(size > 0, p.reshape(size.shape) / size, np.nan)
                wanted = np.ones(r.shape, bool) if at_most is None else np.abs(r) <= at_most
                i, j = np.nonzero(np.triu(wanted, 1) if bi == bj else wanted)
                cells = r[i, j]
                own = [pa.array([row.column(c)[0].as_py()] * len(i), f.type) for c, f in zip(keys, to_arrow_schema(schema))]
                found = [pa.array(i + bi * BLOCK, pa.int32()), pa.array(j + bj * BLOCK, pa.int32()), pa.array(cells, mask=np.isnan(cells))]
                yield pa.RecordBatch.from_arrays([*own, *found], names)

    def name(ord_column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(ord_column).cast("string"))

    return blocks.mapInArrow(pairs, schema).select(*keys, name("ord_i").alias("feature_i"), name("ord_j").alias("feature_j"), "r")


def spearman_correlations(cells: DataFrame, keys: Sequence[str] = (), prefix: str = "f_") -> DataFrame:
    """Spearman's rho: Pearson's r of the average ranks inside each split. ``cells`` must be stored."""
    keys = list(keys)
    ranked = with_ranks(cells, [*keys, "feature", "feature_ord"], "value")
    return correlations(vectors_of(ranked, [*keys, "sample_id"], average_ascending()), keys, prefix)
