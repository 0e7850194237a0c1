"""Data-quality expectations: each returns what violates it, so an empty table is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = ["experiment_id", "method", "outer_fold"]


def _bad(column: str):
    return F.col(column).isNull() | F.isnan(column)


def check_standard(importances: DataFrame, n_inner_folds: int) -> DataFrame:
    """Runs without all three parts, without every inner fold, or with missing values."""
    inner = F.col("inner_fold")

    def folds(kind: str):
        return F.countDistinct(F.when(F.col("kind") == kind, inner))

    return (
        importances.groupBy(*_RUN)
        .agg(
            folds("macro").alias("macro_folds"),
            folds("shap").alias("shap_folds"),
            F.count_if(F.col("kind") == "micro").alias("micro_values"),
            F.count_if(_bad("value")).alias("missing_values"),
        )
        .where(
            (F.col("macro_folds") != n_inner_folds)
            | ~F.col("shap_folds").isin(0, n_inner_folds)
            | (F.col("micro_values") == 0)
            | (F.col("missing_values") > 0)
        )
    )


def check_complete(importances: DataFrame, fits: DataFrame) -> DataFrame:
    """Runs that lack their metric or parameters, have them twice, or have them without importances."""
    known = fits.groupBy(*_RUN).agg(
        F.count("*").alias("n_fits"),
        F.count_if(_bad("validation_metric")).alias("missing_metrics"),
        F.count_if(F.coalesce(F.size("best_params") < 1, F.lit(True))).alias("missing_parameters"),
    )
    runs = importances.groupBy(*_RUN).agg(F.count("*").alias("n_importances"))
    both = runs.join(known, _RUN, "full").fillna(0, ["n_importances", "n_fits", "missing_metrics", "missing_parameters"])
    return both.where("n_fits <> 1 OR n_importances = 0 OR missing_metrics > 0 OR missing_parameters > 0")


def check_names(results: DataFrame) -> DataFrame:
    """Methods with values whose feature has no name."""
    unnamed = F.col("feature").isNull() | (F.col("feature") == "")
    return results.where(unnamed).groupBy("experiment_id", "method").agg(F.count("*").alias("n_unnamed"))


def check_reverse(raw_reverse: DataFrame) -> DataFrame:
    """Runs with a missing quality. Columns of another type are an error at once."""
    for name in ("unlabeled", "labeled"):
        if not isinstance(raw_reverse.schema[name].dataType, (T.DoubleType, T.FloatType)):
            raise TypeError(f"{name} must be a float column")
    return (
        raw_reverse.groupBy(*_RUN)
        .agg(F.count_if(_bad("unlabeled") | _bad("labeled")).alias("missing_values"))
        .where("missing_values > 0")
    )


def check_outer_folds(results: DataFrame, n_outer_folds: int, n_features: int) -> DataFrame:
    """Methods without a result in every outer fold, or with folds that lack features."""
    return (
        results.groupBy("experiment_id", "method", "outer_fold")
        .agg(F.countDistinct("feature").alias("_features"))
        .groupBy("experiment_id", "method")
        .agg(
            F.count("*").alias("n_folds"),
            F.min("_features").alias("fewest_features"),
        )
        .where((F.col("n_folds") != n_outer_folds) | (F.col("fewest_features") != n_features))
    )


def check_methods(results: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected methods without any result."""
    wanted = results.sparkSession.createDataFrame([(m,) for m in expected], "method string")
    return wanted.join(results.select("method").distinct(), "method", "left_anti")


def check_non_negative(scores: DataFrame) -> DataFrame:
    """Groups with a negative score."""
    return (
        scores.groupBy("method", "outer_fold")
        .agg(F.count_if(F.col("score") < 0).alias("n_negative"))
        .where("n_negative > 0")
    )


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[row.asDict() for row in found]}")
