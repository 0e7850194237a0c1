"""Nested splits with their fitted transform, kept small.

Stored are one row per sample (vector, outer fold, inner fold inside every
outer train part) and one fitted model per split. The rows of a split are a
filter and a transform over the stored samples, made when they are read: with
6 × 5 folds, stored split rows would be 31 copies of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.operators.folds import expand_folds, stratified_folds
from featwright.operators.prepare import require_no_missing
from featwright.operators.transform import fitted_vectors, transform_vectors, yeojohnson_lambda
from featwright.settings import Settings
from featwright.sources.tables import cells_of_vectors
from featwright.sources.versions import fingerprint, latest, publish, write_version
from featwright.storage import stage

SPLIT = ["outer_fold", "inner_fold"]
#: Stands for the whole table where an outer fold names the train part that is dealt to inner folds.
WHOLE = -1


def deal_nested(samples: DataFrame, settings: Settings) -> DataFrame:
    """``samples`` with ``outer_fold`` and ``inner_folds[o]``: the inner fold in the train part of outer split o.

    Folds are dealt on ids and labels alone; the vectors are shuffled once, by the join. Copies of an id that meet in
    an outer train part stay together, in the lowest inner fold that one of them was dealt to.
    """
    k = settings.n_outer_folds
    dealt = stage(stratified_folds(samples.select("sample_id", "label"), k, seed=settings.seed))
    train = expand_folds(dealt, "outer_fold", k).where(F.col("role") == "train").drop("role")
    inner = stratified_folds(
        train,
        settings.n_inner_folds,
        seed=settings.seed,
        strata=("outer_fold", "label"),
        salt=("outer_fold",),
        out="inner_fold",
    )
    lowest = [F.min(F.when(F.col("outer_fold") == o, F.col("inner_fold"))) for o in range(k)]
    per_sample = inner.groupBy("sample_id").agg(
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(o) for o in range(k)]), F.array(*lowest)), lambda _, fold: fold.isNotNull()).alias("inner_folds")
    )
    return samples.join(dealt.select("sample_id", "outer_fold"), "sample_id").join(per_sample, "sample_id")


@dataclass(frozen=True)
class Splits:
    """Stored samples with their folds, and the stored transform of every split."""

    samples: DataFrame
    fitted: DataFrame
    settings: Settings

    def rows(self, outer_fold: int | None = None, inner: bool = True) -> DataFrame:
        """Transformed rows of all splits (or of one outer split): ``(outer_fold, inner_fold, role, …)``."""
        k, m = self.settings.n_outer_folds, self.settings.n_inner_folds
        wanted = range(k) if outer_fold is None else [outer_fold]
        levels = [None, *range(m)] if inner else [None]
        keys = F.array(
            *[
                F.struct(F.lit(o).alias("outer_fold"), F.lit(i).cast("int").alias("inner_fold"))
                for o in wanted
                for i in levels
            ]
        )
        expanded = self.samples.select(
            "sample_id", "label", "features", F.col("outer_fold").alias("_own"), "inner_folds", F.inline(keys)
        )
        outside = F.col("_own") == F.col("outer_fold")
        at_inner = F.col("inner_fold").isNotNull()
        role = (
            F.when(at_inner & outside, None)
            .when(at_inner, F.when(F.col("inner_folds")[F.col("outer_fold")] == F.col("inner_fold"), "valid").otherwise("train"))
            .otherwise(F.when(outside, "valid").otherwise("train"))
        )
        rows = expanded.withColumn("role", role).where("role is not null")
        return transform_vectors(rows.select(*SPLIT, "role", "sample_id", "label", "features"), self.fitted, SPLIT)


def prepared_splits(samples: DataFrame, folder: str, settings: Settings = Settings(), name: str = "") -> tuple[Splits, bool]:
    """The splits of ``samples``, and whether they were there: prepared once for the same input files, settings and ``name``.

    ``name`` stands for what was done to the files to get ``samples``. What was prepared is published whole or not at all.
    """
    spark = samples.sparkSession
    key = fingerprint(samples, settings, name)
    version = latest(spark, folder, [key]).get(key)
    if version is not None:
        stored = {part: spark.read.parquet(f"{folder}/{part}/{version}") for part in ("samples", "fitted")}
        return Splits(stored["samples"], stored["fitted"], settings), True
    splits = fit_splits(samples, settings)
    version, stored = write_version(folder, {"samples": splits.samples, "fitted": splits.fitted})
    publish(spark, folder, key, version, stored)
    return Splits(stored["samples"], stored["fitted"], settings), False


def _fold_rows(dealt: DataFrame) -> DataFrame:
    """Every sample once per dealing it takes part in: that of the whole table, and that of each outer train part.

    With both levels in one table all splits are fitted in the same steps. Rows are copied, not cells, so that
    the folds are taken from the map once a row.
    """
    whole = F.struct(F.lit(WHOLE).alias("outer_fold"), F.col("outer_fold").alias("inner_fold"))
    parts = F.transform(
        F.map_entries("inner_folds"), lambda e: F.struct(e["key"].alias("outer_fold"), e["value"].alias("inner_fold"))
    )
    return dealt.select("features", F.inline(F.concat(F.array(whole), parts)))


def fit_splits(samples: DataFrame, settings: Settings = Settings()) -> Splits:
    """Deal the folds and fit the transform of every split on its train part; missing values are an error."""
    dealt = stage(deal_nested(samples, settings), spread="sample_id")
    require_no_missing(cells_of_vectors(dealt))
    model = yeojohnson_lambda(cells_of_vectors(_fold_rows(dealt)), "inner_fold", ["outer_fold"])
    outer = F.col("outer_fold") == WHOLE
    model = model.select(
        F.when(outer, F.col("inner_fold")).otherwise(F.col("outer_fold")).alias("outer_fold"),
        F.when(~outer, F.col("inner_fold")).alias("inner_fold"),
        F.regexp_extract("feature", r"(\d+)$", 1).cast("int").alias("feature_ord"),
        "lambda",
        "mean",
        "std",
    )
    return Splits(dealt, stage(fitted_vectors(model, SPLIT)), settings)
