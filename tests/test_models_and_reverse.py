import itertools
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from featwright.operators import attribution, lasso, models
from featwright.operators.gram import gram_blocks
from featwright.operators.reverse_quality import label_weight_filter, pooled_r2, reverse_best
from featwright.operators.trials import best_trial, draw_trials, drop_empty_trials, prune_trials
from featwright.plans.selection import select_by_search, select_lasso
from featwright.plans.splits import Splits, fit_splits
from featwright.settings import Settings
from featwright.storage import stage
from workload import inputs, model_queries

SETTINGS = Settings(n_outer_folds=2, n_inner_folds=3)
ALPHAS = [0.01, 0.05, 0.2]


@pytest.fixture(scope="module")
def splits(spark):
    rng = np.random.default_rng(5)
    label = rng.choice([1, 2], 120)
    x = rng.normal(size=(120, 6))
    x[:, 1] += label * 2.0  # depends on the label
    x[:, 2] = x[:, 0] + rng.normal(size=120) * 0.2  # its twin is left out as predictor
    x[:, 4] += label * 0.8 + x[:, 5]
    frame = pd.DataFrame({"sample_id": range(120), "label": label, "features": list(x)})
    df = spark.createDataFrame(frame).select("sample_id", F.col("label").cast("int"), "features")
    return fit_splits(df, SETTINGS)


@pytest.fixture(scope="module")
def rows(splits):
    return splits.rows().toPandas()


@pytest.fixture(scope="module")
def blocks(splits):
    return lasso.split_blocks(splits)


def _part(rows, outer, inner, role):
    at = rows.inner_fold.isna() if inner is None else rows.inner_fold == inner
    part = rows[(rows.outer_fold == outer) & at & (rows.role == role)]
    return np.stack(part.features), part.label.to_numpy(float)


def _fit(x, y, alpha):
    """Plain coordinate descent on rows."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        old = w.copy()
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho, size = xc[:, j] @ r / len(y), xc[:, j] @ xc[:, j] / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / size
        if np.abs(w - old).max() < 1e-10:
            break
    return w, y.mean() - x.mean(axis=0) @ w


def test_lasso_fits_equal_fits_on_rows(blocks, rows):
    got = lasso.lasso_trials(blocks, ALPHAS).toPandas()
    assert len(got) == 2 * 4 * 3
    for r in got.itertuples():
        inner = None if pd.isna(r.inner_fold) else int(r.inner_fold)
        x, y = _part(rows, r.outer_fold, inner, "train")
        w, b = _fit(x, y, r.alpha)
        np.testing.assert_allclose(r.weights, w, atol=1e-6)
        xv, yv = _part(rows, r.outer_fold, inner, "valid")
        r2 = 1 - ((yv - xv @ w - b) ** 2).sum() / ((yv - yv.mean()) ** 2).sum()
        assert abs(r.score - r2) < 1e-5


def test_lasso_equals_mllib(spark, blocks, splits):
    got = lasso.lasso_trials(blocks, [0.05]).where("outer_fold = 0 and inner_fold is null").first()
    train = splits.rows(0, inner=False).where("role = 'train'")
    model = LinearRegression(regParam=0.05, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=500).fit(
        train.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    )
    np.testing.assert_allclose(got.weights, model.coefficients.toArray(), atol=1e-5)


def test_small_working_sets_reach_the_same_weights(blocks):
    """Four of six features move a round, so that the fits take several."""
    one = blocks.where("outer_fold = 1 and inner_fold = 0")
    want = lasso.lasso_trials(one, ALPHAS).toPandas()
    got = lasso.lasso_trials(one, ALPHAS, working=4).toPandas()
    both = got.merge(want, on=["outer_fold", "inner_fold", "trial_id"])
    assert len(both) == len(got) == 3
    np.testing.assert_allclose(np.stack(both.weights_x), np.stack(both.weights_y), atol=1e-5)
    np.testing.assert_allclose(both.score_x, both.score_y, atol=1e-5)


def test_lasso_of_more_features_than_a_task_holds(spark):
    """1,300 columns in six panels a side; a task moves 200. The weights meet the optimality conditions on the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 1300))
    x[:, 1] = 2.0  # constant
    x[:, 2] = x[:, 700]  # the same column twice
    y = x[:, [5, 300, 700, 1299]].sum(axis=1) + rng.normal(size=90) * 0.1
    frame = pd.DataFrame({"sample_id": range(90), "role": ["train"] * 60 + ["valid"] * 30, "features": list(np.column_stack([x, y]))})
    rows = spark.createDataFrame(frame).select(
        F.lit(0).alias("outer_fold"), F.lit(None).cast("int").alias("inner_fold"), "role", "features"
    )
    blocks = stage(gram_blocks(rows, ["outer_fold", "inner_fold", "role"]))
    got = lasso.lasso_trials(blocks, [0.02, 0.3, 50.0], working=200).toPandas().sort_values("trial_id")
    xc, yc = x[:60] - x[:60].mean(axis=0), y[:60] - y[:60].mean()
    for r in got.itertuples():
        w = np.asarray(r.weights)
        gradient = xc.T @ (yc - xc @ w) / 60
        assert (np.abs(gradient) <= r.alpha + 1e-5).all()
        np.testing.assert_allclose(gradient[w != 0], r.alpha * np.sign(w[w != 0]), atol=1e-5)
        left = y[60:] - y[:60].mean() - (x[60:] - x[:60].mean(axis=0)) @ w
        assert abs(r.score - (1 - (left**2).sum() / ((y[60:] - y[60:].mean()) ** 2).sum())) < 1e-8
    assert [(np.asarray(w) != 0).any() for w in got.weights] == [True, True, False]


def test_selection_has_all_parts(splits, blocks):
    chosen = select_lasso(splits, blocks, ALPHAS)
    got = chosen.importances.groupBy("outer_fold", "kind").count().toPandas()
    assert {(r.outer_fold, r.kind): r.count for r in got.itertuples(index=False)}
    sizes = got.set_index(["outer_fold", "kind"])["count"].to_dict()
    assert sizes == {(o, k): 6 * n for o in (0, 1) for k, n in (("macro", 3), ("micro", 1), ("shap", 3))}
    top = chosen.importances.where("kind = 'shap'").groupBy("feature_ord").agg(F.sum("value").alias("v")).orderBy(F.desc("v")).first()
    assert top.feature_ord == 1


def _reverse(rows, outer, target, alphas):
    def xy(inner, role, labeled):
        x, label = _part(rows, outer, inner, role)
        xt, _ = _part(rows, outer, inner, "train")
        r = np.corrcoef(xt.T)[target]
        keep = [j for j in range(x.shape[1]) if abs(r[j]) <= 0.3 and j != target]
        chosen = x[:, keep]
        return (np.column_stack([label, chosen]) if labeled else chosen), x[:, target] * 100

    def r2(alpha, labeled):
        truth, guess = [], []
        for inner in range(3):
            w, b = _fit(*xy(inner, "train", labeled), alpha)
            if labeled and w[0] == 0:
                return None
            x, y = xy(inner, "valid", labeled)
            truth.append(y), guess.append(x @ w + b)
        truth, guess = np.concatenate(truth), np.concatenate(guess)
        return 1 - ((truth - guess) ** 2).sum() / ((truth - truth.mean()) ** 2).sum()

    scores = [(r2(a, True), a) for a in alphas]
    scores = [(s, a) for s, a in scores if s is not None]
    if not scores or max(scores)[0] <= 0:
        return 0.0, 0.0
    best, alpha = max(scores, key=lambda t: t[0])
    w, _ = _fit(*xy(None, "train", True), alpha)
    return (0.0, 0.0) if w[0] == 0 else (r2(alpha, False), best)


def test_reverse_lasso_equals_fits_on_rows(blocks, rows):
    alphas = [0.1, 1.0, 20.0]
    got = lasso.reverse_lasso(blocks, alphas, 6, SETTINGS, targets_per_task=4).toPandas()
    assert len(got) == 12
    assert (got.labeled > 0).any()
    for r in got.itertuples():
        want = _reverse(rows, r.outer_fold, r.feature_ord, alphas)
        np.testing.assert_allclose([r.unlabeled, r.labeled], want, atol=1e-4)


def test_reverse_trees_find_the_label(splits):
    trials = [{"max_depth": 3, "min_samples_leaf": 2}]
    for regression in (models.forest_regression, models.extra_trees_regression):
        got = models.reverse_trees(splits, regression, trials, [1, 3], num_trees=5).toPandas().set_index("feature_ord")
        assert (got.loc[1].labeled > got.loc[1].unlabeled).all()


@pytest.mark.parametrize(
    "scorer, params, options",
    [
        (models.random_forest, {"max_depth": 3, "min_samples_leaf": 2}, {"num_trees": 5}),
        (models.extra_trees, {"max_depth": 3, "min_samples_leaf": 2}, {"num_trees": 5}),
        (models.linear_svc, {"C": 1.0}, {"max_iter": 10}),
    ],
)
def test_scorers_prefer_the_label_feature(splits, scorer, params, options):
    with models.split_rows(splits, 0, None) as (train, valid):
        fit = scorer(train, valid, params, **options)
    assert len(fit.weights) == 6
    assert np.argmax(np.abs(fit.weights)) == 1
    assert fit.score > 0.6


def test_log_loss_scorers(splits):
    params = {"max_depth": 3, "min_data_in_leaf": 2, "bagging_fraction": 0.9, "min_gain_to_split": 0.1}
    with models.split_rows(splits, 0, 1) as (train, valid):
        boosted = models.boosted_trees(train, valid, params, max_iter=3)
        forest = models.random_forest_logloss(train, valid, params, num_trees=5)
    for fit in (boosted, forest):
        assert 0 < fit.score < math.log(2)
        assert abs(sum(fit.weights) - 1) < 1e-9


def test_a_single_trial_leaves_no_thread_idle(splits):
    """Two fits wait for each other: with one trial they are of two splits. The rows keep their order."""
    met = threading.Barrier(2)

    def scorer(train, valid, params):
        met.wait(timeout=60)
        return models.Fit(None if valid is None else params["p"], [float(train.count())])

    found = models.score_trials(splits, scorer, [{"p": 0.5}], parallelism=2).collect()
    wanted = [(o, i) for o in range(2) for i in (0, 1, 2, None)]
    assert [(r.outer_fold, r.inner_fold) for r in found] == wanted
    assert all(r.score == (None if r.inner_fold is None else 0.5) for r in found)
    train = splits.rows().where("role = 'train'").groupBy("outer_fold", "inner_fold").count().collect()
    assert {(r.outer_fold, r.inner_fold): r.weights[0] for r in found} == {(r.outer_fold, r.inner_fold): r["count"] for r in train}


def test_the_logloss_query_makes_all_fits(spark, splits, monkeypatch):
    """All folds and trials of a run, and as many trees as a trial draws."""
    asked = []

    def no_splits(samples, settings):
        asked.append(settings)
        return Splits(samples, samples, settings)

    class Forest(models.RandomForestClassifier):
        def _fit(self, rows):
            asked.append(self.getNumTrees())
            raise InterruptedError

    def no_fits(splits, scorer, trials, parallelism, **options):
        for params in trials:
            with pytest.raises(InterruptedError):
                scorer(rows, None, params, **options)
        return spark.createDataFrame([(0, 0, 0, 0.5, [1.0])], models.FITS)

    with models.split_rows(splits, 0, None) as (rows, _):
        monkeypatch.setattr(model_queries, "fit_splits", no_splits)
        monkeypatch.setattr(models, "_Forest", Forest, raising=False)
        monkeypatch.setattr(models, "RandomForestClassifier", Forest)
        monkeypatch.setattr(models, "score_trials", no_fits)
        monkeypatch.setattr(inputs, "document_samples", lambda spark, sf_dir: splits.samples)
        model_queries.queries()["score_random_forest_logloss"](spark, "")
    settings, *trees = asked
    assert (settings.n_outer_folds, settings.n_inner_folds) == (6, 5)
    assert trees == [t["num_iterations"] for t in draw_trials("boosting", 100, 30)]


def test_a_logloss_forest_makes_no_objects_of_its_trees(splits, monkeypatch):
    """One object a tree, made for every fit, kept the other fits of the driver waiting."""
    made = []
    tree = classification.DecisionTreeClassificationModel
    first = tree.__init__
    monkeypatch.setattr(tree, "__init__", lambda self, *given: (made.append(1), first(self, *given))[1])
    params = {"max_depth": 3, "min_data_in_leaf": 2, "bagging_fraction": 0.9, "num_iterations": 4}
    with models.split_rows(splits, 0, 1) as (train, valid):
        fit = models.random_forest_logloss(train, valid, params)
        assert not made
        plain = classification.RandomForestClassifier(numTrees=4, maxDepth=3, minInstancesPerNode=2, subsamplingRate=0.9, seed=42)
        assert fit.weights == plain.fit(models.with_vectors(train)).featureImportances.toArray().tolist()
    assert len(fit.model.trees) == 4
    assert fit.model.getMaxDepth() == 3


def _game(x, leaves, known):
    return sum(
        value * np.prod([(float(lo < x[f] <= hi) if f in known else share) for f, lo, hi, share in path])
        for value, path in leaves
    )


def _listed(leaves):
    return [(r.value, [(p.feature, p.low, p.high, p.share) for p in r.path]) for r in leaves.collect()]


def test_tree_attribution_is_shapley(spark, splits):
    with models.split_rows(splits, 0, None) as (train, valid):
        fit = models.random_forest(train, None, {"max_depth": 3, "min_samples_leaf": 2}, num_trees=3)
        table = attribution.leaves_of(fit.model, spark).withColumn("outer_fold", F.lit(0))
        leaves = _listed(table)
        x = np.stack(valid.toPandas().features)[:6]
        # small parts: several tasks add to the same row
        total = attribution.tree_attribution(valid, table, rows_per_task=20, leaves_per_task=5)
        total = total.toPandas().set_index("feature_ord").value.sort_index()
        every = np.stack(valid.toPandas().features)
    phi = attribution.shapley_of_leaves(x, leaves)
    for row, got in zip(x, phi):
        for f in range(6):
            others = [g for g in range(6) if g != f]
            want = 0.0
            for n in range(6):
                weight = math.factorial(n) * math.factorial(5 - n) / math.factorial(6)
                for known in itertools.combinations(others, n):
                    want += weight * (_game(row, leaves, {*known, f}) - _game(row, leaves, set(known)))
            assert abs(got[f] - want) < 1e-12
    assert list(total.index) == list(range(6))
    np.testing.assert_allclose(total, np.abs(attribution.shapley_of_leaves(every, leaves)).sum(axis=0))


def test_search_gives_up_poor_trials(splits):
    """The score is the trial's own parameter: the best trial is known, and most fits are not made."""

    def scorer(train, valid, params):
        return models.Fit(None if valid is None else params["q"], [params["w"]] * 6)

    trials = [{"q": float(q % 7), "w": 1.0} for q in range(16)] + [{"q": 99.0, "w": 0.0}, {"q": float("nan"), "w": 1.0}]
    search = models.search_trials(splits, scorer, trials)
    made = search.fits.groupBy("outer_fold", "inner_fold").count().toPandas()
    counts = {(r[0], None if pd.isna(r[1]) else int(r[1])): r[2] for r in made.itertuples(index=False)}
    assert counts == {(o, k): n for o in (0, 1) for k, n in ((0, 18), (1, 4), (2, 4), (None, 1))}
    assert [tuple(r) for r in search.best.orderBy("outer_fold").collect()] == [(0, 6, 6.0), (1, 6, 6.0)]
    worst = models.search_trials(splits, scorer, trials[:16], maximize=False)
    assert {r.trial_id for r in worst.best.collect()} == {0}
    nothing = models.search_trials(splits, scorer, trials[16:])
    assert nothing.best.isEmpty() and not nothing.models


def test_rungs():
    assert models.rungs(5) == {1, 4}
    assert models.rungs(1) == set()
    assert models.promoted({3: [1.0], 1: [1.0], 2: [0.0]}, True) == [1]


def test_a_searched_method_has_all_parts(splits):
    trials = [{"max_depth": 2, "min_samples_leaf": 2}, {"max_depth": 3, "min_samples_leaf": 40}]
    chosen = select_by_search(splits, models.extra_trees, trials, num_trees=2)
    sizes = chosen.importances.groupBy("outer_fold", "kind").count().toPandas().set_index(["outer_fold", "kind"])["count"].to_dict()
    assert sizes == {(o, k): 6 * n for o in (0, 1) for k, n in (("macro", 3), ("micro", 1), ("shap", 3))}
    top = chosen.importances.where("kind = 'shap'").groupBy("feature_ord").agg(F.sum("value").alias("v")).orderBy(F.desc("v")).first()
    assert top.feature_ord == 1


def test_trial_tables(spark):
    draws = draw_trials("boosting", 50, 30)
    assert draws == draw_trials("boosting", 50, 30)
    assert all(2 <= t["num_leaves"] <= 2 ** t["max_depth"] - 1 and t["min_data_in_leaf"] <= 15 for t in draws)
    assert all(0.01 <= t["alpha"] <= 1 for t in draw_trials("lasso", 50, 30))

    trials = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.9), ("m", 2, 0.9), ("m", 3, float("nan"))], "method string, trial_id int, score double")
    assert best_trial(trials, ["method"]).first().trial_id == 1
    assert best_trial(trials, ["method"], maximize=False).first().trial_id == 0

    weights = spark.createDataFrame(
        [("m", 0, 0, 0.0), ("m", 0, 1, 1.0), ("m", 1, 0, 1.0), ("m", 1, 0, -1.0)], "method string, trial_id int, inner_fold int, value double"
    )
    kept = drop_empty_trials(trials, weights, ["method"])
    assert {r.trial_id for r in kept.collect()} == {1, 2, 3}

    folds = spark.createDataFrame([("m", t, i, float(t)) for t in range(5) for i in range(2)], "method string, trial_id int, inner_fold int, score double")
    assert {r.trial_id for r in prune_trials(folds, ["method"], keep=0.25).collect()} == {3, 4}


def test_reverse_quality(spark):
    p = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 4.0, 3.0), ("b", 1.0, 1.0)], "k string, y double, prediction double")
    got = {r.k: r.r2 for r in pooled_r2(p, ["k"]).collect()}
    y, g = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    assert abs(got["a"] - (1 - ((y - g) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12
    assert got["b"] is None
    w = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", -1.0), ("c", None)], "k string, weight double")
    assert [r.k for r in label_weight_filter(w, ["k"]).collect()] == ["b"]
    trials = spark.createDataFrame([("a", 0, 0.5, 0.1), ("a", 1, 0.7, 0.2), ("b", 0, -0.1, 0.0)], "k string, trial_id int, labeled double, unlabeled double")
    refits = spark.createDataFrame([("a", 1, 0.3), ("b", 0, 1.0)], "k string, trial_id int, label_weight double")
    assert [tuple(r) for r in reverse_best(trials, refits, ["k"]).select("k", "labeled").collect()] == [("a", 0.7)]


def test_thresholds_make_the_features_once(spark):
    """Made inside the function, the features of a target would be computed anew for every threshold."""
    rows = spark.createDataFrame([(1, 1.0, [0.5, None, 3.0]), (2, 2.0, [-1.0, float("nan"), 0.0]), (3, 1.0, [7.0])], "sample_id bigint, label double, x array<double>")
    rows = rows.select("sample_id", "label", F.expr("transform(array(2, 0, 1), j -> get(x, j))").alias("features"))
    cuts = [(0, 0.0), (0, 2.5), (2, -3.0), (2, 1.0)]
    found = models.encoded(rows, cuts, F.col("label"))
    assert "get(transform" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["sample_id"]: (r["label"], r["features"].toArray().tolist()) for r in found.collect()}
    assert got == {1: (1.0, [1, 1, 0, 0]), 2: (2.0, [0, 0, 1, 1]), 3: (1.0, [0, 0, 0, 0])}
    with pytest.raises(ValueError):
        models.encoded(rows, cuts[::-1], F.col("label"))


def test_letters_are_not_matched_one_by_one(spark, tmp_path):
    texts = ["Ab c1\n dé_Z", "", None, "123 .,", "x" * 50, "ÀBC ß"]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    samples = inputs.document_samples(spark, str(tmp_path))
    assert "[A-Za-z], 0" not in samples._jdf.queryExecution().optimizedPlan().toString()
    at = inputs.DOCUMENT_FEATURES.index("n_letters")
    found = {r["sample_id"]: r["features"][at] for r in samples.collect()}
    assert found == {i: None if t is None else sum(c.isascii() and c.isalpha() for c in t) for i, t in enumerate(texts)}


def test_text_measures_are_those_of_the_patterns(spark):
    texts = ["", None, "\n\n", "  a b", "A.\x0bB\x1c9 é ß１　x;", "\x85a\xa0 ", "One, two!\r\nThree? 42", "z" * 300_000 + " 1\n", "\t"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id bigint, text string").coalesce(1)
    text = F.col("text")
    patterns = {"n_words": r"\S+", "n_digits": "[0-9]", "n_upper": "[A-Z]", "n_punctuation": "[.,;:!?]", "n_letters": "[A-Za-z]", "n_breaks": "\n"}
    wanted = docs.select("doc_id", *[F.regexp_count(text, F.lit(p)).cast("double").alias(name) for name, p in patterns.items()])
    counted = docs.select("doc_id", inputs.text_counts("text").alias("c")).select("doc_id", *[f"c.{name}" for name in patterns])
    assert counted.orderBy("doc_id").collect() == wanted.orderBy("doc_id").collect()
    empty = docs.limit(0).select(inputs.text_counts("text").alias("c"))
    assert empty.collect() == []


def test_text_measures_run_no_pattern_and_not_for_labels_alone(spark, tmp_path):
    docs = [(k, "Some text, 1\n" * k, 13 * k) for k in range(8)]
    spark.createDataFrame(docs, "doc_id bigint, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    samples = inputs.document_samples(spark, str(tmp_path))
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
    assert "ArrowEvalPython" not in samples.select("sample_id", "label")._jdf.queryExecution().executedPlan().toString()
    features = {r.sample_id: r.features for r in samples.collect()}
    assert features[2] == [26.0, 6.0, 3.0, 2.0, 2.0, 2.0, 16.0, 26 / 6, 2.0, 2 / 26, 2 / 26, 2 / 26]
