"""Checks and filters on labelled cells before any split is made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.operators.gram import correlations
from featwright.storage import stage


def null_report(cells: DataFrame) -> DataFrame:
    """Missing values (NULL or NaN) per feature; a usable table has none."""
    missing = F.col("value").isNull() | F.isnan("value")
    return cells.groupBy("feature").agg(
        F.count("*").alias("n_cells"), F.count_if(missing).alias("n_missing")
    )


def require_no_missing(cells: DataFrame) -> DataFrame:
    bad = null_report(cells).where("n_missing > 0").limit(5).collect()
    if bad:
        raise ValueError(f"missing values in {[row.feature for row in bad]}")
    return cells


def limit_features(cells: DataFrame, number_of_features: int) -> DataFrame:
    """The first columns of the table; the label counts as one of ``number_of_features``."""
    return cells.where(F.col("feature_ord") < number_of_features - 1)


def separating_features(cells: DataFrame, pos_label: int = 1) -> DataFrame:
    """Features whose values in one class all lie strictly above those in the other."""
    positive = F.col("label") == pos_label
    return (
        cells.groupBy("feature")
        .agg(
            F.min(F.when(positive, F.col("value"))).alias("pos_low"),
            F.max(F.when(positive, F.col("value"))).alias("pos_high"),
            F.min(F.when(~positive, F.col("value"))).alias("neg_low"),
            F.max(F.when(~positive, F.col("value"))).alias("neg_high"),
        )
        .where((F.col("neg_low") > F.col("pos_high")) | (F.col("pos_low") > F.col("neg_high")))
        .select("feature")
    )


def drop_separating_features(cells: DataFrame, pos_label: int = 1) -> DataFrame:
    """Cells of all other features. Both classes must occur."""
    classes = cells.agg(
        F.max(F.col("label") == pos_label).alias("pos"), F.max(F.col("label") != pos_label).alias("neg")
    ).first()
    if not (classes.pos and classes.neg):
        raise ValueError("both classes must occur")
    return cells.join(stage(separating_features(cells, pos_label)), "feature", "left_anti")


def uncorrelated_features(vectors: DataFrame, keys: Sequence[str] = (), threshold: float = 0.3, prefix: str = "f_") -> DataFrame:
    """For every target feature of every split, the features with |r| at most ``threshold``.

    Pairs above the threshold never leave the task that holds their block; the target itself has r = 1 and
    so never appears, nor does a constant feature.
    """
    weak = correlations(vectors, keys, prefix, at_most=threshold)
    both = F.array(
        F.struct(F.col("feature_i").alias("target"), F.col("feature_j").alias("feature")),
        F.struct(F.col("feature_j").alias("target"), F.col("feature_i").alias("feature")),
    )
    return weak.select(*keys, F.inline(both))
