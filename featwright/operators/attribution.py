"""Attributions of linear and tree models, summed over the validation rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.storage import shared_dir, stage


def linear_attribution(
    valid_cells: DataFrame, weights: DataFrame, keys: Sequence[str] = ("outer_fold",)
) -> DataFrame:
    """Sum over validation rows of ``|weight * (x - train mean)|`` per feature.

    ``weights(keys…, feature, weight, mean)`` should be stored: then Spark
    broadcasts them when they are small.
    """
    return (
        valid_cells.join(weights.select(*keys, "feature", "weight", "mean"), [*keys, "feature"])
        .groupBy(*keys, "feature")
        .agg(F.sum(F.abs(F.col("weight") * (F.col("value") - F.col("mean")))).alias("value"))
    )


# ---- trees -------------------------------------------------------------------

ROWS_PER_TASK = 4096
LEAVES_PER_TASK = 16384
LEAVES = "tree int, leaf int, value double, path array<struct<feature:int,low:double,high:double,share:double>>"


def _paths(nodes: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one tree; a feature met several times on a path has one interval and one share."""
    of = {row.id: row for row in nodes.itertuples(index=False)}
    stack, found = [(0, {})], []
    while stack:
        node_id, path = stack.pop()
        node = of[node_id]
        if node.left < 0:
            path = [{"feature": f, "low": lo, "high": hi, "share": share} for f, (lo, hi, share) in path.items()]
            found.append((node.tree, node_id, node.value, path))
            continue
        for child, is_left in ((node.left, True), (node.right, False)):
            lo, hi, share = path.get(node.feature, (-math.inf, math.inf, 1.0))
            share *= of[child].rows / node.rows
            lo, hi = (lo, min(hi, node.threshold)) if is_left else (max(lo, node.threshold), hi)
            stack.append((child, path | {node.feature: (lo, hi, share)}))
    return pd.DataFrame(found, columns=["tree", "leaf", "value", "path"])


def leaves_of(model, spark, cuts: Sequence[tuple[int, float]] | None = None) -> DataFrame:
    """The leaves of a tree model as a stored table, walked tree by tree: ``(tree, leaf, value, path)``.

    The value is a leaf's part of the prediction: the probability of class 0 in a forest of classifiers, the
    weighted prediction in a forest of regressors, the weighted margin for class 0 in boosted trees. With ``cuts``
    the model's features are the 0/1 columns ``x[j] > t``, and paths are given back in terms of ``x``.
    """
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    flat = saved.select("treeID", "nodeData.*") if "treeID" in saved.columns else saved.select(F.lit(0).alias("treeID"), "*")
    weights = [float(w) for w in getattr(model, "treeWeights", [1.0])]
    weight = F.get(F.lit(weights), F.col("treeID"))
    kind = type(model).__name__
    if kind.startswith("GBT"):
        value = -weight * F.col("prediction") if "Classification" in kind else weight * F.col("prediction")
    elif "Classification" in kind:
        total = F.aggregate("impurityStats", F.lit(0.0), lambda sum_, n: sum_ + n)
        value = F.try_divide(F.get("impurityStats", F.lit(0)), total) / len(weights)
    else:
        value = F.col("prediction") / len(weights)
    nodes = flat.select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("id").alias("id"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
        F.col("rawCount").cast("double").alias("rows"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    if cuts is not None:
        named = [(column, j, float(t)) for column, (j, t) in enumerate(cuts)]
        names = spark.createDataFrame(named, "feature int, _j int, _t double")
        inner = nodes.join(names, "feature", "left")
        nodes = inner.select("tree", "id", "value", "rows", "left", "right", F.col("_j").alias("feature"), F.col("_t").alias("threshold"))
    return stage(nodes.groupBy("tree").applyInPandas(_paths, LEAVES))


def base_value(leaves: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, base)``: the prediction when no feature is known."""
    reached = F.aggregate("path", F.lit(1.0), lambda share, step: share * step["share"])
    return leaves.groupBy(*keys).agg(F.sum(F.col("value") * reached).alias("base"))


def shapley_of_leaves(x: np.ndarray, leaves: list) -> np.ndarray:
    """Path-dependent Shapley values of every row of ``x``, in closed form leaf by leaf.

    Without feature f a leaf is reached with its cover share, with f either
    surely or not at all; so a leaf is a product game over the features of its path.
    """
    phi = np.zeros_like(x)
    for value, path in leaves:
        k = len(path)
        if not k:
            continue
        known = np.stack([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi, _ in path]).astype(float)
        share = np.array([p[3] for p in path])
        for i, (feature, *_) in enumerate(path):
            # coefficients of prod over the others of (share + known·z)
            sizes = np.zeros((k, len(x)))
            sizes[0] = 1.0
            for j in range(k):
                if j != i:
                    sizes[1:] = sizes[1:] * share[j] + sizes[:-1] * known[j]
                    sizes[0] *= share[j]
            weights = [math.factorial(t) * math.factorial(k - 1 - t) / math.factorial(k) for t in range(k)]
            phi[:, feature] += value * (known[i] - share[i]) * (np.array(weights) @ sizes)
    return phi


def tree_contributions(
    rows: DataFrame,
    leaves: DataFrame,
    keys: Sequence[str] = ("outer_fold",),
    rows_per_task: int = ROWS_PER_TASK,
    leaves_per_task: int = LEAVES_PER_TASK,
) -> DataFrame:
    """Shapley values ``(keys…, sample_id, feature_ord, value)`` of the features on the paths of a row's model.

    The Shapley values of a model are the sums of those of its leaves, so parts of about ``rows_per_task`` rows meet
    parts of about ``leaves_per_task`` leaves; contributions are then added up per row. ``keys`` must not be NULL;
    ``leaves`` must be stored, ``sample_id`` unique per key.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "sample_id"]) + ", feature_ord int, value double"

    def parts(table: DataFrame, size: int, out: str) -> DataFrame:
        return stage(table.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias(out)))

    n_rows, n_leaves = parts(rows, rows_per_task, "_n_rows"), parts(leaves, leaves_per_task, "_n_leaves")
    both = stage(n_rows.join(n_leaves, keys))

    def dealt(table: DataFrame, by: list[str], own: str, other: str, at: str, copies: str) -> DataFrame:
        met = table.join(both, keys).withColumn(at, F.pmod(F.xxhash64(*by), F.col(own)))
        return met.withColumn(copies, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop(own, other)

    left = dealt(rows.select(*keys, "sample_id", "features"), ["sample_id"], "_n_rows", "_n_leaves", "_row_part", "_leaf_part")
    right = dealt(leaves.select(*keys, "tree", "leaf", "value", "path"), ["tree", "leaf"], "_n_leaves", "_n_rows", "_leaf_part", "_row_part")

    def run(some_rows: pd.DataFrame, some_leaves: pd.DataFrame) -> pd.DataFrame:
        if some_rows.empty or some_leaves.empty:
            return pd.DataFrame(columns=[*keys, "sample_id", "feature_ord", "value"])
        met = [(v, [(p["feature"], p["low"], p["high"], p["share"]) for p in path]) for v, path in zip(some_leaves.value, some_leaves.path)]
        phi = shapley_of_leaves(np.stack(some_rows.features), met)
        used = np.array(sorted({f for _, path in met for f, *_ in path}), dtype=int)
        many = some_rows[[*keys, "sample_id"]].loc[some_rows.index.repeat(len(used))].reset_index(drop=True)
        return many.assign(feature_ord=np.tile(used, len(some_rows)), value=phi[:, used].ravel())

    by = [*keys, "_row_part", "_leaf_part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)
    return found.groupBy(*keys, "sample_id", "feature_ord").agg(F.sum("value").alias("value"))


def tree_attribution(rows: DataFrame, leaves: DataFrame, keys: Sequence[str] = ("outer_fold",), **sizes) -> DataFrame:
    """Sum over the rows of |Shapley value|, for every feature; 0 for one that no tree uses."""
    keys = list(keys)
    sums = (
        tree_contributions(rows, leaves, keys, **sizes)
        .groupBy(*keys, "feature_ord")
        .agg(F.sum(F.abs("value")).alias("value"))
    )
    every = rows.groupBy(*keys).agg(F.max(F.size("features")).alias("_n")).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("feature_ord")
    )
    return every.join(sums, [*keys, "feature_ord"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
