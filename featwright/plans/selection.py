"""Selection runs: trials over the inner folds → best trial → raw importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featwright.operators.attribution import leaves_of, tree_attribution
from featwright.operators.lasso import lasso_trials, reverse_lasso
from featwright.operators.models import Scorer, Search, search_trials
from featwright.operators.trials import best_trial
from featwright.plans.splits import SPLIT, Splits
from featwright.storage import stage


@dataclass(frozen=True)
class Selection:
    """Raw results of one method: the best trial per outer fold and its importances."""

    best: DataFrame  # outer_fold, trial_id, score
    importances: DataFrame  # outer_fold, inner_fold, kind, feature_ord, value


def choose_trial(fits: DataFrame, maximize: bool = True) -> DataFrame:
    """Best mean score over the inner folds; a trial without any weight in some fold is out."""
    sized = fits.where("inner_fold is not null").withColumn(
        "_size", F.aggregate("weights", F.lit(0.0), lambda total, w: total + F.abs(w))
    )
    means = sized.groupBy("outer_fold", "trial_id").agg(F.avg("score").alias("score"), F.min("_size").alias("_least"))
    return best_trial(means.where("_least > 0").drop("_least"), ["outer_fold"], maximize)


def importances_of(fits: DataFrame, best: DataFrame) -> DataFrame:
    """Macro importances (inner folds) and micro importances (outer refit) of the best trials."""
    chosen = fits.join(best.select("outer_fold", "trial_id"), ["outer_fold", "trial_id"], "left_semi")
    return chosen.select(
        *SPLIT,
        F.when(F.col("inner_fold").isNull(), "micro").otherwise("macro").alias("kind"),
        F.posexplode("weights").alias("feature_ord", "value"),
    )


def linear_shap(splits: Splits, fits: DataFrame, best: DataFrame) -> DataFrame:
    """Sum over the inner validation rows of |weight · x|; x has train mean 0 after the transform."""
    chosen = (
        fits.where("inner_fold is not null")
        .join(best.select("outer_fold", "trial_id"), ["outer_fold", "trial_id"], "left_semi")
        .select(*SPLIT, "weights")
    )
    valid = splits.rows().where("inner_fold is not null and role = 'valid'")
    return (
        valid.join(stage(chosen), SPLIT)
        .select(*SPLIT, F.posexplode(F.zip_with("features", "weights", lambda x, w: F.abs(x * w))).alias("feature_ord", "_size"))
        .groupBy(*SPLIT, "feature_ord")
        .agg(F.sum("_size").alias("value"))
        .select(*SPLIT, F.lit("shap").alias("kind"), "feature_ord", "value")
    )


def select_lasso(splits: Splits, blocks: DataFrame, alphas: Sequence[float]) -> Selection:
    fits = stage(lasso_trials(blocks, alphas))
    best = stage(choose_trial(fits))
    return Selection(best, importances_of(fits, best).unionByName(linear_shap(splits, fits, best)))


def tree_shap(splits: Splits, search: Search) -> DataFrame:
    """Sum over the inner validation rows of |Shapley value| under the best trial's model of that fold."""
    spark = splits.samples.sparkSession
    tables = [
        leaves_of(fit.model, spark, fit.cuts).withColumns({"outer_fold": F.lit(outer), "inner_fold": F.lit(inner)})
        for (outer, inner), fit in search.models.items()
        if inner is not None
    ]
    valid = splits.rows().where("inner_fold is not null and role = 'valid'")
    sums = tree_attribution(valid, stage(reduce(DataFrame.unionByName, tables)), SPLIT)
    return sums.select(*SPLIT, F.lit("shap").alias("kind"), "feature_ord", "value")


def select_by_search(
    splits: Splits, scorer: Scorer, trials: Sequence[dict], maximize: bool = True, linear: bool = False, **options
) -> Selection:
    """Any method: search with early stopping, macro and micro importances and attributions of the best trial."""
    search = search_trials(splits, scorer, trials, maximize, **options)
    fits, best = stage(search.fits), stage(search.best)
    if not search.models:
        return Selection(best, importances_of(fits, best))
    shap = linear_shap(splits, fits, best) if linear else tree_shap(splits, search)
    return Selection(best, importances_of(fits, best).unionByName(shap))


def named(results: DataFrame, feature_names: Sequence[str], method: str, experiment_id: int = 1) -> DataFrame:
    """Raw results with feature names in place of column numbers."""
    name: Column = F.element_at(F.array(*[F.lit(n) for n in feature_names]), F.col("feature_ord") + 1)
    rest = [c for c in results.columns if c not in ("feature_ord", "outer_fold")]
    return results.select(
        F.lit(experiment_id).cast("bigint").alias("experiment_id"),
        F.lit(method).alias("method"),
        "outer_fold",
        name.alias("feature"),
        *rest,
    )


def select_reverse_lasso(splits: Splits, blocks: DataFrame, alphas: Sequence[float], n_features: int) -> DataFrame:
    """``(outer_fold, feature_ord, unlabeled, labeled)`` for every feature as target."""
    return reverse_lasso(blocks, alphas, n_features, splits.settings).drop("alpha")
