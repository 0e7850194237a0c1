"""Model-based importances with MLlib: forests, boosted trees, extra trees, linear SVC.

Every fit is a Spark job over the rows of one split; a few fits are submitted at
a time. The driver sees one importance vector per fit.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featwright.operators.prepare import uncorrelated_features
from featwright.plans.splits import SPLIT, Splits

FITS = "outer_fold int, inner_fold int, trial_id int, score double, weights array<double>"


@dataclass(frozen=True)
class Fit:
    score: float | None
    weights: list[float]
    model: object = None
    cuts: list[tuple[int, float]] | None = None  # of 0/1 columns the model was fitted on


def with_vectors(rows: DataFrame) -> DataFrame:
    """MLlib's columns: labels 0 and 1, dense vectors."""
    return rows.select(
        "sample_id",
        (F.col("label") - 1).cast("double").alias("label"),
        array_to_vector("features").alias("features"),
    )


@contextmanager
def split_rows(splits: Splits, outer_fold: int, inner_fold: int | None):
    """Train and validation rows of one split, cached while its models are fitted."""
    at = F.col("inner_fold").isNull() if inner_fold is None else F.col("inner_fold") == inner_fold
    rows = splits.rows(outer_fold, inner=inner_fold is not None).where(at)
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept.where("role = 'train'"), kept.where("role = 'valid'")
    finally:
        kept.unpersist()


def _accuracy(model, valid: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(valid))


def random_forest(train: DataFrame, valid: DataFrame | None, params: dict, num_trees: int = 100, seed: int = 42) -> Fit:
    """Entropy forest, scored by accuracy."""
    train = with_vectors(train)
    model = RandomForestClassifier(
        impurity="entropy",
        numTrees=num_trees,
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        seed=seed,
    ).fit(train)
    score = None if valid is None else _accuracy(model, with_vectors(valid))
    return Fit(score, model.featureImportances.toArray().tolist(), model)


def _gain_per_row(params: dict, train: DataFrame) -> float:
    """A least gain summed over the rows of a node, as MLlib's gain per row."""
    gain = float(params.get("min_gain_to_split", 0.0))
    return gain / max(train.count(), 1) if gain else 0.0


class _ForestModel(RandomForestClassificationModel):
    """A forest whose trees become Python objects when they are asked for.

    MLlib's own model makes them all when its parameters are listed, which holds up every other fit of the driver.
    """

    trees = property(RandomForestClassificationModel.trees.func)


class _Forest(RandomForestClassifier):
    def _create_model(self, java_model) -> _ForestModel:
        return _ForestModel(java_model)


def random_forest_logloss(train: DataFrame, valid: DataFrame | None, params: dict, num_trees: int | None = None, seed: int = 42) -> Fit:
    """Bagged forest, scored by log-loss (lower is better)."""
    train = with_vectors(train)
    model = _Forest(
        numTrees=num_trees or int(params["num_iterations"]),
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_data_in_leaf"]),
        minInfoGain=_gain_per_row(params, train),
        subsamplingRate=float(params["bagging_fraction"]),
        seed=seed,
    ).fit(train)
    score = None
    if valid is not None:
        score = MulticlassClassificationEvaluator(metricName="logLoss").evaluate(model.transform(with_vectors(valid)))
    return Fit(score, model.featureImportances.toArray().tolist(), model)


def boosted_trees(train: DataFrame, valid: DataFrame | None, params: dict, max_iter: int | None = None, seed: int = 42) -> Fit:
    """Boosted trees, scored by the lowest validation log-loss over the iterations.

    The L1 penalty, the bagging frequency and the leaf limit have no MLlib parameter.
    """
    train = with_vectors(train)
    model = GBTClassifier(
        maxIter=max_iter or int(params["num_iterations"]),
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_data_in_leaf"]),
        minInfoGain=_gain_per_row(params, train),
        subsamplingRate=float(params["bagging_fraction"]),
        seed=seed,
    ).fit(train)
    score = None
    if valid is not None:
        # MLlib's loss is twice the log-loss
        score = min(model.evaluateEachIteration(with_vectors(valid))) / 2
    return Fit(score, model.featureImportances.toArray().tolist(), model)


def linear_svc(train: DataFrame, valid: DataFrame | None, params: dict, max_iter: int = 50) -> Fit:
    """Linear support vectors, scored by accuracy; the importance is the coefficient."""
    train = with_vectors(train)
    n = train.count()
    model = LinearSVC(regParam=1.0 / (n * float(params["C"])), standardization=False, maxIter=max_iter).fit(train)
    score = None if valid is None else _accuracy(model, with_vectors(valid))
    return Fit(score, model.coefficients.toArray().tolist(), model)


# ---- extra trees: random thresholds ----------------------------------------


def _limits(train: DataFrame) -> list[tuple[float, float]]:
    """Lowest and highest value of every feature: one row of the model's size."""
    vectors = train.select(array_to_vector("features").alias("features"))
    row = vectors.select(Summarizer.metrics("min", "max").summary(F.col("features")).alias("s")).first().s
    return list(zip(row.min.toArray().tolist(), row.max.toArray().tolist()))


def _thresholds(train: DataFrame, per_feature: int, seed: int) -> list[tuple[int, float]]:
    rng = random.Random(seed)
    return [
        (j, lo + rng.random() * (hi - lo)) for j, (lo, hi) in enumerate(_limits(train)) for _ in range(per_feature)
    ]


def encoded(rows: DataFrame, thresholds: list[tuple[int, float]], label: Column) -> DataFrame:
    """0/1 columns ``x > threshold``; the thresholds come in the order of their features."""
    if any(j > k for (j, _), (k, _) in zip(thresholds, thresholds[1:])):
        raise ValueError("the thresholds must be in the order of their features")
    cuts: list[list[float]] = [[] for _ in range(thresholds[-1][0] + 1)]
    for j, t in thresholds:
        cuts[j].append(t)
    # the features stand outside the function: inside, Spark would make them anew for every threshold
    arrays = ", ".join(f"array({', '.join(f'{t!r}D' for t in own)})" if own else "CAST(array() AS array<double>)" for own in cuts)
    bits = F.expr(
        f"flatten(zip_with(slice(features, 1, {len(cuts)}), array({arrays}), (x, cuts) -> transform(cuts, t -> if(x > t, 1.0D, 0.0D))))"
    )
    return rows.select("sample_id", label.alias("label"), array_to_vector(bits).alias("features"))


def _by_feature(model, thresholds: list[tuple[int, float]]) -> list[float]:
    weights = [0.0] * (thresholds[-1][0] + 1)
    for (j, _), importance in zip(thresholds, model.featureImportances.toArray()):
        weights[j] += float(importance)
    return weights


# every node of a tree chooses among a random part of the random thresholds,
# and every tree sees all rows
_EXTRA = {"bootstrap": False, "featureSubsetStrategy": "sqrt", "maxBins": 2}


def extra_trees(train: DataFrame, valid: DataFrame | None, params: dict, num_trees: int = 100, seed: int = 42, per_feature: int = 8) -> Fit:
    """Trees over random thresholds (entropy), scored by accuracy."""
    thresholds = _thresholds(train, per_feature, seed)
    label = (F.col("label") - 1).cast("double")
    model = RandomForestClassifier(
        impurity="entropy",
        numTrees=num_trees,
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        seed=seed,
        **_EXTRA,
    ).fit(encoded(train, thresholds, label))
    score = None if valid is None else _accuracy(model, encoded(valid, thresholds, label))
    return Fit(score, _by_feature(model, thresholds), model, thresholds)


# ---- the runs over splits and trials ----------------------------------------

Scorer = Callable[..., Fit]
#: Splits whose rows are cached side by side.
SPLITS_AT_ONCE = 3


def score_trials(
    splits: Splits, scorer: Scorer, trials: Sequence[dict], parallelism: int = 4, **options
) -> DataFrame:
    """``scorer`` for every (split, trial): scores and importance vectors, as one small table.

    The outer level (``inner_fold`` NULL) is the refit on the outer train part. The next split is opened beside one
    whose last fits leave threads idle; where its trials leave them idle from the first, more are, ``SPLITS_AT_ONCE`` at most.
    """
    s = splits.settings
    spark = splits.samples.sparkSession
    at_once = max(2, min(SPLITS_AT_ONCE, parallelism // max(1, len(trials))))
    with ThreadPool(parallelism) as pool, ThreadPool(at_once) as opened:

        @inheritable_thread_target(spark)
        def fits_of(split):
            outer, inner = split
            with split_rows(splits, outer, inner) as (train, valid):

                @inheritable_thread_target(spark)
                def one(numbered):
                    trial_id, params = numbered
                    fit = scorer(train, None if inner is None else valid, params, **options)
                    return outer, inner, trial_id, fit.score, fit.weights

                return pool.map(one, list(enumerate(trials)), chunksize=1)

        wanted = [(outer, inner) for outer in range(s.n_outer_folds) for inner in [*range(s.n_inner_folds), None]]
        found = [fit for fits in opened.map(fits_of, wanted, chunksize=1) for fit in fits]
    return spark.createDataFrame(found, FITS)


@dataclass(frozen=True)
class Search:
    """A search that gave up poor trials early; the driver keeps a score and a weight vector per fit."""

    fits: DataFrame  # as of score_trials, for the fits that were made
    best: DataFrame  # outer_fold, trial_id, score
    models: dict[tuple, Fit]  # (outer_fold, inner_fold) -> fit of the best trial


def rungs(n_folds: int, reduction: int = 4, first: int = 1) -> set[int]:
    """Numbers of folds after which a search halves its trials: ``first``, ``first·reduction``, …"""
    found, at = set(), first
    while at < n_folds:
        found.add(at)
        at *= reduction
    return found


def promoted(scores: dict[int, list[float]], maximize: bool, reduction: int = 4) -> list[int]:
    """The best ``1/reduction`` of the trials (one at least) by mean score; lower ids first among equals."""
    sign = -1 if maximize else 1
    order = sorted(scores, key=lambda t: (sign * sum(scores[t]) / len(scores[t]), t))
    return sorted(order[: max(1, len(order) // reduction)])


def search_trials(
    splits: Splits, scorer: Scorer, trials: Sequence[dict], maximize: bool = True, reduction: int = 4, parallelism: int = 4, **options
) -> Search:
    """Successive halving over the inner folds: all trials are fitted on the first, the best go on at every rung.

    A trial without a weight, or without a score, in some fold is out at once. Only the best trial is refitted
    on the outer train part. An outer fold without a trial left has no row in ``best``.
    """
    s = splits.settings
    spark = splits.samples.sparkSession
    at_rung = rungs(s.n_inner_folds, reduction)
    found: list[tuple] = []
    best: list[tuple] = []
    models: dict[tuple, Fit] = {}
    pool = ThreadPool(parallelism)
    try:
        for outer in range(s.n_outer_folds):
            scores: dict[int, list[float]] = {t: [] for t in range(len(trials))}
            kept: dict[int, list[Fit]] = {t: [] for t in scores}
            for inner in range(s.n_inner_folds):
                with split_rows(splits, outer, inner) as (train, valid):

                    @inheritable_thread_target(spark)
                    def one(trial_id, train=train, valid=valid):
                        return trial_id, scorer(train, valid, trials[trial_id], **options)

                    done = pool.map(one, list(scores))
                for trial_id, fit in done:
                    found.append((outer, inner, trial_id, fit.score, fit.weights))
                    if fit.score is None or math.isnan(fit.score) or not any(fit.weights):
                        del scores[trial_id], kept[trial_id]
                    else:
                        scores[trial_id].append(fit.score)
                        kept[trial_id].append(fit)
                if scores and inner + 1 in at_rung:
                    alive = promoted(scores, maximize, reduction)
                    scores, kept = {t: scores[t] for t in alive}, {t: kept[t] for t in alive}
            if not scores:
                continue
            chosen = promoted(scores, maximize, max(len(scores), 1))[0]
            with split_rows(splits, outer, None) as (train, _):
                fit = scorer(train, None, trials[chosen], **options)
            found.append((outer, None, chosen, None, fit.weights))
            best.append((outer, chosen, sum(scores[chosen]) / len(scores[chosen])))
            models |= {(outer, inner): f for inner, f in enumerate(kept[chosen])} | {(outer, None): fit}
    finally:
        pool.close()
    return Search(
        spark.createDataFrame(found, FITS),
        spark.createDataFrame(best, "outer_fold int, trial_id int, score double"),
        models,
    )


# ---- reverse selection with trees -------------------------------------------


def _target_rows(rows: DataFrame, target: int, columns: list[int], labeled: bool, scale: float) -> DataFrame:
    numbers = ", ".join(map(str, columns))
    chosen = F.expr(f"transform(array({numbers}), j -> get(features, j))")
    if labeled:
        chosen = F.concat(F.array(F.col("label").cast("double")), chosen)
    return rows.select("sample_id", (F.get("features", F.lit(target)) * scale).alias("label"), chosen.alias("features"))


def _allowed_columns(splits: Splits, targets: Sequence[int]) -> dict[tuple, list[int]]:
    """Columns weakly correlated to each target on the train part of each split.

    One pass over the rows for all splits; the driver keeps at most
    targets × features numbers per split.
    """
    train = splits.rows().where("role = 'train'")
    weak = uncorrelated_features(train, SPLIT, splits.settings.train_correlation_threshold, prefix="")
    rows = (
        weak.where(F.col("target").cast("int").isin(list(targets)))
        .groupBy(*SPLIT, F.col("target").cast("int").alias("target"))
        .agg(F.array_sort(F.collect_list(F.col("feature").cast("int"))).alias("columns"))
        .toLocalIterator()
    )
    return {(x.outer_fold, x.inner_fold, x.target): x.columns for x in rows}


def forest_regression(train: DataFrame, valid: DataFrame, params: dict, num_trees: int = 100, seed: int = 42):
    """Forest on a numeric target: importances and ``(label, prediction)`` of the validation rows."""
    model = RandomForestRegressor(
        numTrees=num_trees,
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        seed=seed,
    ).fit(train.select("label", array_to_vector("features").alias("features")))
    done = model.transform(valid.select("label", array_to_vector("features").alias("features")))
    return model.featureImportances.toArray().tolist(), done.select("label", "prediction")


def extra_trees_regression(train: DataFrame, valid: DataFrame, params: dict, num_trees: int = 100, seed: int = 42, per_feature: int = 8):
    """Random-threshold trees on a numeric target."""
    thresholds = _thresholds(train, per_feature, seed)
    model = RandomForestRegressor(
        numTrees=num_trees,
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        seed=seed,
        **_EXTRA,
    ).fit(encoded(train, thresholds, F.col("label")))
    done = model.transform(encoded(valid, thresholds, F.col("label")))
    return _by_feature(model, thresholds), done.select("label", "prediction")


def reverse_trees(
    splits: Splits,
    regression: Callable,
    trials: Sequence[dict],
    targets: Sequence[int],
    parallelism: int = 4,
    **options,
) -> DataFrame:
    """Reverse selection with trees for the given targets: pooled R² without and with the label.

    With forests a trial counts only if the label has an importance in every inner
    fold; the best one only if its R² is above 0 and the outer refit weighs the label too.
    """
    s = splits.settings
    spark = splits.samples.sparkSession

    def cross_validated(target: int, params: dict, labeled: bool, inner: list) -> float | None:
        pooled = None
        for (train, valid), columns in inner:
            weights, done = regression(
                _target_rows(train, target, columns, labeled, s.target_scale),
                _target_rows(valid, target, columns, labeled, s.target_scale),
                params,
                **options,
            )
            if labeled and weights[0] == 0.0 and regression is forest_regression:
                return None
            pooled = done if pooled is None else pooled.unionByName(done)
        return RegressionEvaluator(metricName="r2").evaluate(pooled)

    allowed = _allowed_columns(splits, targets)
    found: list[tuple] = []
    pool = ThreadPool(parallelism)
    try:
        for outer in range(s.n_outer_folds):
            contexts = [split_rows(splits, outer, i) for i in [*range(s.n_inner_folds), None]]
            opened = [c.__enter__() for c in contexts]
            try:

                @inheritable_thread_target(spark)
                def one(target, outer=outer, opened=opened):
                    columns = [allowed.get((outer, i, target)) for i in [*range(s.n_inner_folds), None]]
                    if not all(columns):
                        return outer, target, 0.0, 0.0
                    inner = list(zip(opened, columns))[:-1]
                    scores = [cross_validated(target, p, True, inner) for p in trials]
                    best = max((r for r in scores if r is not None), default=0.0)
                    if best <= 0:
                        return outer, target, 0.0, 0.0
                    params = trials[scores.index(best)]
                    train, valid = opened[-1]
                    weights, _ = regression(
                        _target_rows(train, target, columns[-1], True, s.target_scale),
                        _target_rows(valid, target, columns[-1], True, s.target_scale),
                        params,
                        **options,
                    )
                    if weights[0] == 0.0:
                        return outer, target, 0.0, 0.0
                    return outer, target, cross_validated(target, params, False, inner), best

                found += pool.map(one, list(targets))
            finally:
                for c in contexts:
                    c.__exit__(None, None, None)
    finally:
        pool.close()
    return spark.createDataFrame(found, "outer_fold int, feature_ord int, unlabeled double, labeled double")
