import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featwright.functions.expressions import yeo_johnson
from featwright.operators import folds, gram, prepare, transform
from featwright.plans import splits as plan
from featwright.plans.splits import fit_splits
from featwright.settings import Settings
from featwright.sources import tables


def _yj(x, lam):
    x = np.asarray(x, float)
    up = np.log1p(x.clip(0)) if lam == 0 else ((x.clip(0) + 1) ** lam - 1) / lam
    down = -np.log1p((-x).clip(0)) if lam == 2 else -(((-x).clip(0) + 1) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    x[:, 1] = np.exp(x[:, 1])
    x[:, 2] = 7.0  # constant
    x[:, 3] = x[:, 0] * 0.8 + rng.normal(size=90) * 0.3
    x[:, 4] = np.round(x[:, 4])  # ties
    frame = pd.DataFrame({"sample_id": range(90), "label": rng.choice([1, 2], 90, p=[0.7, 0.3]), "features": list(x)})
    df = spark.createDataFrame(frame).select("sample_id", F.col("label").cast("int"), "features")
    return frame, x, df


def test_csv_source(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("label,a,b\n1,0.5,2\n2,-1,3\n")
    names = tables.header_of(spark, str(path))
    assert names == ["label", "a", "b"]
    df = tables.read_labelled_csv(spark, str(path), names[1:])
    assert [tuple(r) for r in df.orderBy("label").collect()] == [(1, 0.5, 2.0), (2, -1.0, 3.0)]
    with pytest.raises(Exception):
        tables.read_labelled_csv(spark, str(path), ["b", "a"]).collect()
    assert tables.feature_catalog(names, spark, 2).collect() == [("a", 0)]


def test_filters(spark):
    wide = spark.createDataFrame(
        [(1, 1, 1.0, 1.0, 5.0), (2, 1, 2.0, 2.0, float("nan")), (3, 2, 3.0, 2.0, 5.0), (4, 2, 4.0, 3.0, 6.0)],
        "id int, label int, apart double, touching double, hole double",
    )
    cells = tables.cells_of(wide, "id", "label", ["apart", "touching", "hole"])
    assert {r.feature: r.n_missing for r in prepare.null_report(cells).collect()} == {"apart": 0, "touching": 0, "hole": 1}
    with pytest.raises(ValueError):
        prepare.require_no_missing(cells)
    kept = {r.feature for r in prepare.drop_separating_features(cells).select("feature").distinct().collect()}
    assert kept == {"touching", "hole"}
    assert {r.feature for r in prepare.limit_features(cells, 3).collect()} == {"apart", "touching"}
    with pytest.raises(ValueError):
        prepare.drop_separating_features(cells.where("label = 1"))


def test_folds_part_the_samples(samples):
    frame, _, df = samples
    got = folds.nested_folds(df, Settings(n_outer_folds=4, n_inner_folds=3)).toPandas()
    outer = got[got.inner_fold.isna()]
    valid = outer[outer.role == "valid"]
    assert sorted(valid.sample_id) == list(range(90))
    counts = valid.groupby(["outer_fold", "label"]).size().unstack()
    assert (counts.max() - counts.min()).max() <= 1
    for o in range(4):
        train = set(outer[(outer.outer_fold == o) & (outer.role == "train")].sample_id)
        inner = got[(got.outer_fold == o) & got.inner_fold.notna()]
        assert set(inner.sample_id) == train
        assert sorted(inner[inner.role == "valid"].sample_id) == sorted(train)
        sizes = inner[inner.role == "valid"].groupby(["inner_fold", "label"]).size().unstack()
        assert (sizes.max() - sizes.min()).max() <= 1


def test_copies_of_an_id_are_dealt_to_many_folds(spark):
    """With two outer folds, two copies of an id never met in a train part; with six they do."""
    twice = [(i, 1 + i % 2, [float(i + copy)]) for i in range(24) for copy in range(1 + (i % 5 == 0))]
    df = spark.createDataFrame(twice, "sample_id bigint, label int, features array<double>")
    dealt = plan.deal_nested(df, Settings()).collect()
    assert {r.sample_id for r in dealt} == set(range(24))
    for r in dealt:
        assert set(r.inner_folds) >= set(range(6)) - {r.outer_fold}
        assert set(r.inner_folds.values()) <= set(range(5))
    alone = [r for r in dealt if r.sample_id % 5]
    assert len(alone) == 19 and all(len(r.inner_folds) == 5 for r in alone)
    for i in range(0, 24, 5):
        assert {r.features[0] for r in dealt if r.sample_id == i} == {float(i), float(i + 1)}
        assert len({tuple(sorted(r.inner_folds.items())) for r in dealt if r.sample_id == i}) == 1


def test_transform_is_yeo_johnson(spark):
    x = [-2.5, -0.1, 0.0, 0.3, 4.0]
    for lam in (-1.0, 0.0, 0.5, 2.0, 3.0):
        df = spark.createDataFrame([(v,) for v in x], "x double")
        got = [r[0] for r in df.select(yeo_johnson(F.col("x"), F.lit(lam))).collect()]
        np.testing.assert_allclose(got, _yj(x, lam), atol=1e-12)


def test_lambda_is_the_most_likely(samples):
    frame, x, df = samples
    dealt = folds.stratified_folds(df, 3)
    fold = dealt.select("sample_id", "outer_fold").toPandas().set_index("sample_id").outer_fold.sort_index().to_numpy()
    cells = tables.cells_of_vectors(dealt)
    got = transform.yeojohnson_lambda(cells).toPandas()
    for row in got.itertuples():
        j = int(row.feature[2:])
        v = x[fold != row.outer_fold, j]
        if j == 2:
            assert (row[3], row.status) == (1.0, "constant")
            continue
        ll = lambda lam: -len(v) / 2 * np.log(_yj(v, lam).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()
        assert row.status == "optimum" and ll(row[3]) >= max(map(ll, np.arange(-2000, 2001) / 100))
        assert ll(row[3]) >= max(ll(row[3] - 1e-4), ll(row[3] + 1e-4))
        np.testing.assert_allclose([row.mean, row.std], [_yj(v, row[3]).mean(), _yj(v, row[3]).std()], rtol=1e-9)


def test_lambda_has_no_edge(spark):
    """Small values ask for exponents in the hundreds; a narrow column far out has none in the range of doubles."""
    rng = np.random.default_rng(3)
    x = np.stack([1e-3 * rng.exponential(size=60), 1e6 + rng.normal(size=60), rng.integers(0, 2, 60)], axis=1)
    cells = spark.createDataFrame([(i % 2, f"f_{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "outer_fold int, feature string, value double")
    found = {(r.feature, r.outer_fold): r for r in transform.yeojohnson_lambda(cells).collect()}
    assert len(found) == 6
    for fold in (0, 1):
        v = x[1 - fold :: 2, 0]
        size, side = np.log1p(np.abs(v)), np.sign(v)

        def ll(lam):
            p = np.where(v < 0, 2 - lam, lam)
            return -len(v) / 2 * np.log((side * np.expm1(p * size) / p).var()) + (lam - 1) * (side * size).sum()

        best = found["f_0", fold]
        assert best.status == "optimum" and abs(best["lambda"]) > 10
        assert ll(best["lambda"]) > max(ll(best["lambda"] - 1), ll(best["lambda"] + 1))
        assert found["f_1", fold].status == "unbounded" and np.isfinite(found["f_1", fold].std)
        assert found["f_2", fold].status == "optimum"


def test_correlations_equal_numpy(samples, monkeypatch):
    _, x, df = samples
    for block in (256, 2):
        monkeypatch.setattr(gram, "BLOCK", block)
        got = gram.correlations(df.repartition(4)).toPandas()
        want = pd.DataFrame(x).corr()
        for r in got.itertuples():
            i, j = int(r.feature_i[2:]), int(r.feature_j[2:])
            assert (np.isnan(r.r) and np.isnan(want.iloc[i, j])) or abs(r.r - want.iloc[i, j]) < 1e-12
        assert len(got) == 10


def test_uncorrelated_features_of_every_split(samples, monkeypatch):
    """Blocks of two features: pairs above the threshold stay inside, in diagonal blocks and others."""
    _, x, df = samples
    monkeypatch.setattr(gram, "BLOCK", 2)
    keyed = df.withColumn("part", F.col("sample_id") % 2)
    found = {(r.part, r.target, r.feature) for r in prepare.uncorrelated_features(keyed, ["part"], 0.1).collect()}
    want = set()
    for part in (0, 1):
        r = pd.DataFrame(x[part::2]).corr().abs()
        want |= {(part, f"f_{i}", f"f_{j}") for i in r for j in r if i != j and r.loc[i, j] <= 0.1}
    assert found == want and want


def test_spearman_equals_pandas(samples):
    _, x, df = samples
    got = gram.spearman_correlations(tables.cells_of_vectors(df)).toPandas()
    want = pd.DataFrame(x).corr(method="spearman")
    for r in got.itertuples():
        w = want.loc[int(r.feature_i[2:]), int(r.feature_j[2:])]
        assert (np.isnan(r.r) and np.isnan(w)) or abs(r.r - w) < 1e-12


def test_blocks_merge_large_offsets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(7)
    got = gram.correlations(df).toPandas()
    want = pd.DataFrame(x - 1e6).corr()
    for r in got.itertuples():
        assert abs(r.r - want.loc[int(r.feature_i[2:]), int(r.feature_j[2:])]) < 1e-8


def test_split_rows_are_standard(samples):
    _, _, df = samples
    splits = fit_splits(df, Settings(n_outer_folds=3, n_inner_folds=2))
    rows = splits.rows().toPandas()
    assert len(rows.groupby(["outer_fold", "inner_fold"], dropna=False)) == 9
    for _, part in rows[rows.role == "train"].groupby(["outer_fold", "inner_fold"], dropna=False):
        x = np.stack(part.features)
        np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
        np.testing.assert_allclose(np.delete(x.std(axis=0), 2), 1, atol=1e-9)
    checked = folds.check_splits(splits.rows().select("outer_fold", "inner_fold", "role", "label"))
    assert all(r.both_classes for r in checked.collect())


def test_first_look_at_exponents_does_not_shuffle_cells(spark, monkeypatch):
    """The points of the first look are few and stored, so that they go to the cells."""
    cells = spark.range(40_000).select(
        (F.col("id") % 3).cast("int").alias("outer_fold"), (F.col("id") % 2).cast("int").alias("inner_fold"),
        F.concat(F.lit("f_"), (F.col("id") % 4).cast("string")).alias("feature"), F.rand(3).alias("value"),
    )
    cells = transform.stage(cells)
    plans = []

    def staged(df, *args, **options):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stage(df, *args, **options)

    stage = transform.stage
    monkeypatch.setattr(transform, "stage", staged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = transform.yeojohnson_lambda(cells, "inner_fold", ["outer_fold"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 3 * 2 * 4
    first = next(p for p in plans if "log1p" in p.lower())
    assert "SortMergeJoin" not in first[first.lower().index("log1p") :]


def test_all_splits_are_fitted_in_the_same_steps(samples, monkeypatch):
    """Outer and inner splits share the passes over the cells, and get what fits of their own give."""
    _, _, df = samples
    calls = []

    def fitted(*args, **options):
        calls.append(args)
        return transform.yeojohnson_lambda(*args, **options)

    monkeypatch.setattr(plan, "yeojohnson_lambda", fitted)
    splits = fit_splits(df, Settings(n_outer_folds=3, n_inner_folds=2))
    assert len(calls) == 1
    cells = tables.cells_of_vectors(splits.samples)
    inner = cells.select(F.explode("inner_folds").alias("outer_fold", "inner_fold"), "feature", "value")
    expected = {(r.outer_fold, None, r.feature): r for r in transform.yeojohnson_lambda(cells).collect()}
    for r in transform.yeojohnson_lambda(inner, "inner_fold", ["outer_fold"]).collect():
        expected[r.outer_fold, r.inner_fold, r.feature] = r
    found = splits.fitted.select("outer_fold", "inner_fold", F.explode("_fit").alias("p")).select("*", "p.*").collect()
    assert len(found) == len(expected) == (3 + 3 * 2) * 5
    for r in found:
        e = expected[r.outer_fold, r.inner_fold, f"f_{r.feature_ord}"]
        np.testing.assert_allclose((r["lambda"], r.mean, r.std), (e["lambda"], e.mean, e.std), rtol=1e-9, atol=1e-12)
