"""Stratified, nested cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featwright.settings import Settings


def stratified_folds(
    samples: DataFrame,
    k: int,
    *,
    seed: int = 42,
    strata: Sequence[str] = ("label",),
    salt: Sequence[str] = (),
    out: str = "outer_fold",
    hash_digits: int = 3,
) -> DataFrame:
    """Deal the samples of each stratum to ``k`` folds in the order of a seeded hash.

    A stratum may be most of the table, so its rows are numbered by hash prefix:
    a window per (stratum, prefix), plus the count of all lower prefixes. Other
    columns ride along, so that no join has to bring them back.
    """
    strata = list(strata)
    keyed = samples.withColumn(
        "_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in salt], F.col("sample_id").cast("string")))
    ).withColumn("_prefix", F.substring("_hash", 1, hash_digits))
    before = Window.partitionBy(*strata).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*strata, "_prefix")
        .agg(F.count("*").alias("_n"))
        .select(*strata, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*strata, "_prefix").orderBy("_hash", "sample_id")
    return (
        keyed.withColumn("_position", F.row_number().over(inside))
        .join(offsets, [*strata, "_prefix"])
        .withColumn(out, ((F.col("_offset") + F.col("_position") - 1) % k).cast("int"))
        .select(*samples.columns, out)
    )


def expand_folds(assigned: DataFrame, fold: str, k: int) -> DataFrame:
    """Every sample once per split: ``valid`` in its own fold, ``train`` in all others."""
    others = [c for c in assigned.columns if c != fold]
    return assigned.select(
        *others, F.col(fold).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold)
    ).select(
        *others, fold, F.when(F.col("_own") == F.col(fold), "valid").otherwise("train").alias("role")
    )


def nested_folds(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Outer splits (``inner_fold`` NULL) and the inner splits of each outer train part."""
    outer = expand_folds(
        stratified_folds(samples, settings.n_outer_folds, seed=settings.seed),
        "outer_fold",
        settings.n_outer_folds,
    )
    dealt = stratified_folds(
        outer.where(F.col("role") == "train").drop("role"),
        settings.n_inner_folds,
        seed=settings.seed,
        strata=("outer_fold", "label"),
        salt=("outer_fold",),
        out="inner_fold",
    )
    inner = expand_folds(dealt, "inner_fold", settings.n_inner_folds)
    return outer.withColumn("inner_fold", F.lit(None).cast("int")).unionByName(inner)


def check_splits(splits: DataFrame) -> DataFrame:
    """Sizes per split, and whether the train part is the larger one and both classes occur in it."""
    train, valid = F.col("role") == "train", F.col("role") == "valid"
    return splits.groupBy("outer_fold", "inner_fold").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(valid).alias("n_valid"),
        (F.count_if(train) > F.count_if(valid)).alias("train_larger"),
        (F.countDistinct(F.when(train, F.col("label"))) == 2).alias("both_classes"),
    )
