"""From raw importances to one scaled score per (method, outer fold, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.functions.expressions import clean, scaled
from featwright.model import KIND_LABELS
from featwright.storage import stage

_FOLD_KEYS = ["method", "outer_fold", "feature"]


def _sum_of_sizes(importances: DataFrame, kind: str) -> DataFrame:
    return (
        importances.where(F.col("kind") == kind)
        .groupBy(*_FOLD_KEYS)
        .agg(F.sum(F.abs(clean(F.col("value")))).alias("score"))
    )


def cumulated_macro(importances: DataFrame) -> DataFrame:
    """Sum over the inner folds of |importance|."""
    return _sum_of_sizes(importances, "macro")


def micro_scores(importances: DataFrame, *, absolute: bool = False) -> DataFrame:
    """Importance of the refit on the outer train part, with its sign unless ``absolute``."""
    value = clean(F.col("value"))
    return importances.where(F.col("kind") == "micro").select(
        *_FOLD_KEYS, (F.abs(value) if absolute else value).alias("score")
    )


def cumulated_shap(importances: DataFrame) -> DataFrame:
    """Sum over the inner folds of |attribution|; left out where inner fold 0 has none."""
    shap = importances.where(F.col("kind") == "shap")
    present = shap.where(F.col("inner_fold") == 0).groupBy("method", "outer_fold").agg(F.count("*").alias("n"))
    return _sum_of_sizes(importances, "shap").join(present, ["method", "outer_fold"], "left_semi")


def reverse_weight(raw_reverse: DataFrame) -> DataFrame:
    """How much the label improves the prediction of a feature; never below 0."""
    gain = F.col("labeled") - F.col("unlabeled")
    return raw_reverse.select(*_FOLD_KEYS, F.greatest(clean(gain), F.lit(0.0)).alias("score"))


def minmax_scores(scores: DataFrame, group: Sequence[str], value: str = "score") -> DataFrame:
    """Scale ``value`` to [0, 1] inside each group; a constant group scales to 0.

    The limits are an aggregate (one row per group), not a window, so one large
    group is never in one task. They are staged: Spark broadcasts them when
    their file is small.
    """
    group = list(group)
    limits = stage(scores.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high")))
    columns = [
        scaled(F.col(c), F.col("_low"), F.col("_high")).alias(c) if c == value else F.col(c)
        for c in scores.columns
    ]
    return scores.join(limits, group).select(*columns)


def unscaled_fold_scores(importances: DataFrame, raw_reverse: DataFrame) -> DataFrame:
    """All kinds of score stacked; the method name carries the kind, reverse methods keep theirs."""

    def labelled(scores: DataFrame, kind: str) -> DataFrame:
        return scores.withColumn("method", F.concat_ws(" ", "method", F.lit(KIND_LABELS[kind])))

    return (
        labelled(cumulated_macro(importances), "macro")
        .unionByName(labelled(micro_scores(importances), "micro"))
        .unionByName(labelled(cumulated_shap(importances), "shap"))
        .unionByName(reverse_weight(raw_reverse))
    )


def fold_scores(importances: DataFrame, raw_reverse: DataFrame) -> DataFrame:
    """Scaled scores of every method and kind, one row per (method, outer fold, feature)."""
    return minmax_scores(stage(unscaled_fold_scores(importances, raw_reverse)), ["method", "outer_fold"])


def wide_folds(scores: DataFrame, n_outer_folds: int) -> DataFrame:
    """Export form: one column per outer fold."""
    return (
        scores.groupBy("method", "feature")
        .pivot("outer_fold", list(range(n_outer_folds)))
        .agg(F.first("score"))
    )


def selected_subsets(scores: DataFrame) -> DataFrame:
    """The features each method selects in each outer fold: score above 0."""
    return scores.where(F.col("score") > 0).select("method", "outer_fold", "feature")


def robust_features(scores: DataFrame, n_outer_folds: int, marker: str = "bm") -> DataFrame:
    """Features a method selects in every outer fold; known markers are flagged by their name."""
    return (
        selected_subsets(scores)
        .groupBy("method", "feature")
        .agg(F.countDistinct("outer_fold").alias("n_folds"))
        .where(F.col("n_folds") == n_outer_folds)
        .select("method", "feature", F.col("feature").contains(marker).alias("is_marker"))
    )
