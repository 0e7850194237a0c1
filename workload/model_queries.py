"""Queries that fit models. Most results have no SQL form; the tests check them.

The number of folds, trials and trees is kept small here, but for ``score_random_forest_logloss``; all are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.operators import attribution, models
from featwright.operators.lasso import lasso_trials, split_blocks
from featwright.operators.trials import draw_trials
from featwright.plans.selection import choose_trial, named, select_by_search, select_lasso, select_reverse_lasso
from featwright.plans.splits import SPLIT, Splits, fit_splits
from featwright.settings import Settings
from featwright.storage import stage
from workload import inputs

FEW_FOLDS = Settings(n_outer_folds=2, n_inner_folds=2)
WHOLE = Settings()  # all folds and trials of a run
SAMPLES = 30  # the sample count the search spaces are made for
NAMES = inputs.DOCUMENT_FEATURES


def _splits(spark: SparkSession, sf_dir: str, settings: Settings = FEW_FOLDS) -> Splits:
    return fit_splits(inputs.document_samples(spark, sf_dir), settings)


def _alphas(n: int) -> list[float]:
    return [t["alpha"] for t in draw_trials("lasso", n, SAMPLES)]


def _scores(scorer, space: str, n_trials: int = 1, settings: Settings = FEW_FOLDS, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        trials = draw_trials(space, n_trials, SAMPLES)
        fits = models.score_trials(_splits(spark, sf_dir, settings), scorer, trials, parallelism=8, **options)
        return fits.select(*SPLIT, "trial_id", "score", F.posexplode("weights").alias("feature_ord", "importance"))

    return run


def score_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lasso_trials(split_blocks(_splits(spark, sf_dir)), _alphas(10))
    return fits.select(*SPLIT, "trial_id", "score", F.posexplode("weights").alias("feature_ord", "importance"))


def trial_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lasso_trials(split_blocks(_splits(spark, sf_dir)), _alphas(30))
    return choose_trial(fits)


def _importances(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        splits = _splits(spark, sf_dir)
        chosen = select_lasso(splits, split_blocks(splits), _alphas(10))
        return named(chosen.importances, NAMES, "Lasso").where(F.col("kind") == kind)

    return run


def reverse_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _splits(spark, sf_dir)
    found = select_reverse_lasso(splits, split_blocks(splits), _alphas(10), len(NAMES))
    return named(found, NAMES, "ReverseLasso")


def _reverse_trees(regression, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        trials = draw_trials("forest", 1, SAMPLES)
        found = models.reverse_trees(
            _splits(spark, sf_dir), regression, trials, range(len(NAMES)), parallelism=8, **options
        )
        return named(found, NAMES, "ReverseTrees")

    return run


def _outer_models(splits: Splits, scorer, params: dict, **options):
    """A model per outer split: its fit, its stored leaves and the validation rows it was not fitted on."""
    spark = splits.samples.sparkSession
    for outer in range(FEW_FOLDS.n_outer_folds):
        with models.split_rows(splits, outer, None) as (train, _):
            fit = scorer(train, None, params, **options)
        leaves = attribution.leaves_of(fit.model, spark, fit.cuts).withColumn("outer_fold", F.lit(outer))
        yield outer, fit, leaves, splits.rows(outer, inner=False).where("role = 'valid'")


def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest per outer split, attributed on its validation rows."""
    params = {"max_depth": 4, "min_samples_leaf": 2}
    made = list(_outer_models(_splits(spark, sf_dir), models.random_forest, params, num_trees=5))
    leaves = reduce(DataFrame.unionByName, [leaves for _, _, leaves, _ in made])
    valid = reduce(DataFrame.unionByName, [valid for *_, valid in made])
    return attribution.tree_attribution(valid, leaves)


FOREST, BOOSTED = {"max_depth": 3, "min_samples_leaf": 2}, {
    "max_depth": 3, "min_data_in_leaf": 2, "bagging_fraction": 0.9, "num_iterations": 3
}
ATTRIBUTED = {
    "RandomForest": (models.random_forest, FOREST, {"num_trees": 3}),
    "ExtraTrees": (models.extra_trees, FOREST, {"num_trees": 3}),
    "BoostedTrees": (models.boosted_trees, BOOSTED, {}),
}


def attribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many validation rows the contributions add up to the model's own prediction less its base value."""
    splits = _splits(spark, sf_dir)
    tables = []
    for method, (scorer, params, options) in ATTRIBUTED.items():
        for outer, fit, leaves, valid in _outer_models(splits, scorer, params, **options):
            label = (F.col("label") - 1).cast("double")
            asked = models.with_vectors(valid) if fit.cuts is None else models.encoded(valid, fit.cuts, label)
            margin = "rawPrediction" if method == "BoostedTrees" else "probability"
            predicted = fit.model.transform(asked).select("sample_id", F.get(vector_to_array(margin), F.lit(0)).alias("_predicted"))
            sums = attribution.tree_contributions(valid, leaves).groupBy("sample_id").agg(F.sum("value").alias("_sum"))
            base = attribution.base_value(leaves, ["outer_fold"])
            met = predicted.withColumn("outer_fold", F.lit(outer)).join(sums, "sample_id", "left").join(base, "outer_fold")
            off = F.abs(F.coalesce("_sum", F.lit(0.0)) + F.col("base") - F.col("_predicted"))
            tables.append(
                met.groupBy("outer_fold")
                .agg(F.count("*").alias("n_rows"), F.count_if(off < 1e-9).alias("n_additive"))
                .select(F.lit(method).alias("method"), "outer_fold", "n_rows", "n_additive")
            )
    return reduce(DataFrame.unionByName, tables)


SEARCHED = {
    "RandomForest": (models.random_forest, "forest", True, {"num_trees": 3}),
    "ExtraTrees": (models.extra_trees, "forest", True, {"num_trees": 3}),
    "LinearSVC": (models.linear_svc, "svc", True, {"max_iter": 10, "linear": True}),
    "BoostedTrees": (models.boosted_trees, "boosting", False, {"max_iter": 3}),
}


def method_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro, micro and SHAP rows of every method that searches with early stopping."""
    splits = _splits(spark, sf_dir)
    tables = []
    for method, (scorer, space, maximize, options) in SEARCHED.items():
        chosen = select_by_search(splits, scorer, draw_trials(space, 4, SAMPLES), maximize, parallelism=8, **options)
        tables.append(named(chosen.importances, NAMES, method))
    return reduce(DataFrame.unionByName, tables)


def search_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fits a search makes fold by fold (NULL: the refit), with support vectors."""
    trials = draw_trials("svc", 8, SAMPLES)
    search = models.search_trials(_splits(spark, sf_dir), models.linear_svc, trials, parallelism=8, max_iter=10)
    return search.fits.groupBy(*SPLIT).agg(F.count("*").alias("n_fits"))


def lasso_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimality conditions of every fit, taken from the rows: how many features violate theirs."""
    splits = _splits(spark, sf_dir)
    fits = stage(lasso_trials(split_blocks(splits), _alphas(10)))
    at = [F.coalesce("inner_fold", F.lit(-1)).alias("_inner"), "outer_fold"]
    rows = splits.rows().where("role = 'train'").select(*at, "label", "features")
    guess = F.aggregate(F.zip_with("features", "weights", lambda x, w: x * w), F.lit(0.0), lambda total, part: total + part)
    cells = (
        rows.join(fits.select(*at, "trial_id", "alpha", "weights"), ["outer_fold", "_inner"])
        .select("outer_fold", "_inner", "trial_id", "alpha", (F.col("label") - guess).alias("_left"), "weights", F.posexplode("features").alias("_j", "_x"))
        .withColumn("_w", F.get("weights", F.col("_j")))
    )
    n = F.count("*")
    gradient = (F.sum(F.col("_x") * F.col("_left")) - F.sum("_x") * F.sum("_left") / n) / n
    per_feature = cells.groupBy("outer_fold", "_inner", "trial_id", "alpha", "_j").agg(gradient.alias("_g"), F.max("_w").alias("_w"), n.alias("n_train"))
    off = F.when(F.col("_w") != 0, F.abs(F.col("_g") - F.col("alpha") * F.signum("_w"))).otherwise(F.abs("_g") - F.col("alpha"))
    return (
        per_feature.groupBy("outer_fold", "_inner", "trial_id")
        .agg(F.max("n_train").alias("n_train"), F.count("*").alias("n_features"), F.count_if(off > 1e-5).alias("n_violated"))
        .withColumn("inner_fold", F.when(F.col("_inner") >= 0, F.col("_inner")))
        .drop("_inner")
    )


DEALT = """
samples AS (SELECT doc_id AS sample_id, quality + 1 AS label FROM documents JOIN labels USING (doc_id)),
dealt AS (
  SELECT sample_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(sample_id AS VARCHAR))) - 1) % 2 AS fold
  FROM samples),
train AS (SELECT sample_id, label, CAST(k AS INTEGER) AS outer_fold FROM dealt, range(2) r(k) WHERE fold <> k),
inner_dealt AS (
  SELECT outer_fold, (row_number() OVER (PARTITION BY outer_fold, label
           ORDER BY md5('42|' || CAST(outer_fold AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR))) - 1) % 2 AS fold
  FROM train)"""


def queries() -> dict:
    return {
        "score_lasso": score_lasso,
        "score_random_forest": _scores(models.random_forest, "forest", num_trees=5),
        "score_extra_trees": _scores(models.extra_trees, "forest", num_trees=3),
        "score_linear_svc": _scores(models.linear_svc, "svc", max_iter=15),
        "score_gbt": _scores(models.boosted_trees, "boosting", max_iter=5),
        "score_random_forest_logloss": _scores(models.random_forest_logloss, "boosting", WHOLE.boosting_trials, WHOLE),
        "trial_search": trial_search,
        "macro_importance": _importances("macro"),
        "micro_importance": _importances("micro"),
        "shap_importance": _importances("shap"),
        "tree_attribution": tree_attribution,
        "attribution_sums": attribution_sums,
        "method_importances": method_importances,
        "search_fits": search_fits,
        "lasso_conditions": lasso_conditions,
        "reverse_lasso": reverse_lasso,
        "reverse_random_forest": _reverse_trees(models.forest_regression, num_trees=3),
        "reverse_extra_trees": _reverse_trees(models.extra_trees_regression, num_trees=3),
    }


def oracle_sql() -> dict[str, str]:
    """Fits have no SQL form; what must hold for all of them has: no condition violated, every sum exact."""
    methods = ", ".join(f"('{m}')" for m in ATTRIBUTED)
    return {
        "lasso_conditions": f"""WITH {DEALT},
sizes AS (
  SELECT outer_fold, CAST(NULL AS INTEGER) AS inner_fold, count(*) AS n_train FROM train GROUP BY 1
  UNION ALL
  SELECT outer_fold, CAST(k AS INTEGER), count(*) FROM inner_dealt, range(2) r(k) WHERE fold <> k GROUP BY 1, 2)
SELECT outer_fold, inner_fold, trial_id, n_train, {len(NAMES)} AS n_features, 0 AS n_violated
FROM sizes, range(10) t(trial_id)""",
        "attribution_sums": f"""WITH {DEALT}
SELECT method, fold AS outer_fold, count(*) AS n_rows, count(*) AS n_additive
FROM dealt, (VALUES {methods}) m(method) GROUP BY 1, 2""",
        "search_fits": """SELECT CAST(o AS INTEGER) AS outer_fold, inner_fold, n_fits
FROM range(2) r(o), (VALUES (0, 8), (1, 2), (NULL, 1)) s(inner_fold, n_fits)""",
    }
