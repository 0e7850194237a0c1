"""Scoring of reverse selection: does the label help predict a feature?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled_r2(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One R² over the pooled validation rows of all inner folds.

    The total is taken around the pooled mean; it is a variance, so large values
    do not cancel.
    """
    rest = F.col("y") - F.col("prediction")
    return (
        predictions.groupBy(*keys)
        .agg(
            F.sum(rest * rest).alias("_sse"),
            (F.var_pop("y") * F.count("y")).alias("_sst"),
        )
        .select(*keys, F.when(F.col("_sst") > 0, 1.0 - F.col("_sse") / F.col("_sst")).alias("r2"))
    )


def label_weight_filter(label_weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials in which the label has a non-zero weight in every inner fold."""
    return (
        label_weights.groupBy(*keys)
        .agg(F.min(F.abs(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)))).alias("_least"))
        .where("_least > 0")
        .drop("_least")
    )


def reverse_best(
    trials: DataFrame, refits: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Best surviving trial per key if its R² is above 0 and the refit weighs the label too.

    ``trials(keys…, trial_id, labeled, unlabeled)`` are the surviving trials,
    ``refits(keys…, trial_id, label_weight)`` the fits on the outer train part.
    Keys without such a trial are absent; they count as ``(0, 0)``.
    """
    top = trials.groupBy(*keys).agg(
        F.max_by(F.struct("trial_id", "labeled", "unlabeled"), F.struct("labeled", -F.col("trial_id"))).alias("_b")
    ).select(*keys, "_b.*")
    weighed = refits.where(F.col("label_weight") != 0).select(*keys, "trial_id")
    return top.where("labeled > 0").join(weighed, [*keys, "trial_id"], "left_semi")
