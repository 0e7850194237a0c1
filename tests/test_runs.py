"""Stored results, expectations, meters and the stream."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from featwright.model import IMPORTANCES, POWER_SAMPLES
from featwright.operators import expectations as Q
from featwright.operators import metering as M
from featwright.operators import scores as S
from featwright.plans.ensemble import cv_aggregate, ensemble_aggregate
from featwright.plans.splits import prepared_splits
from featwright.settings import Settings
from featwright.sources import results_store as R
from featwright.sources import versions as V
from featwright.streaming.power import sample_stream, write_power_windows

T0 = dt.datetime(2024, 1, 1)


def _importances(spark, drop=()):
    rows = []
    for method in ("a", "b"):
        for outer in range(2):
            for f, sign in (("f1", 1), ("f2", -1), ("bm_3", 0)):
                for inner in range(2):
                    rows.append((1, method, outer, inner, "macro", f, sign * (outer + inner + 1.0)))
                    if method == "a":
                        rows.append((1, method, outer, inner, "shap", f, abs(sign) * 0.5))
                rows.append((1, method, outer, None, "micro", f, sign * 2.0))
    return spark.createDataFrame([r for i, r in enumerate(rows) if i not in drop], IMPORTANCES)


def _reverse(spark):
    return spark.createDataFrame(
        [(1, "Reverse", o, f, 0.2, l) for o in range(2) for f, l in (("f1", 0.1), ("f2", 0.4), ("bm_3", 0.6))],
        "experiment_id long, method string, outer_fold int, feature string, unlabeled double, labeled double",
    )


def test_fold_scores(spark):
    got = {(r.method, r.outer_fold, r.feature): r.score for r in S.fold_scores(_importances(spark), _reverse(spark)).collect()}
    assert len(got) == 2 * 3 * (2 * 2 + 1 + 1)  # macro and micro twice, shap once, reverse once
    assert got["a cumulated_macro_importance", 0, "f2"] == 1.0  # |negative|
    assert got["a cumulated_macro_importance", 0, "bm_3"] == 0.0
    # the sign of micro values is kept, so a zero lies in the middle
    assert [got["b cumulated_micro_importance", 1, f] for f in ("f1", "bm_3", "f2")] == [1.0, 0.5, 0.0]
    assert got["Reverse", 0, "f1"] == 0.0 and got["Reverse", 0, "bm_3"] == 1.0
    assert not any(m == "b cumulated_shap_values" for m, _, _ in got)


def test_constant_scores_scale_to_zero(spark):
    df = spark.createDataFrame([("m", 0, "f1", 3.0), ("m", 0, "f2", 3.0)], "method string, outer_fold int, feature string, score double")
    assert [r.score for r in S.minmax_scores(df, ["method", "outer_fold"]).collect()] == [0.0, 0.0]


def test_robust_features_and_ensemble(spark):
    scores = S.fold_scores(_importances(spark), _reverse(spark))
    robust = {(r.method, r.feature): r.is_marker for r in S.robust_features(scores, 2).collect()}
    assert robust["Reverse", "bm_3"] is True and ("Reverse", "f1") not in robust
    table = ensemble_aggregate(scores, Settings(cv_aggregators=("ArithmeticMean", "Max")))
    rows = table.collect()
    assert len(rows) == 6 and {r.cv_aggregator for r in rows} == {"ArithmeticMean", "Max"}
    only = cv_aggregate(scores, methods=["Reverse"]).collect()
    assert {r.method for r in only} == {"Reverse"} and max(r.score for r in only) == 1.0


def test_wide_export(spark, tmp_path):
    scores = S.fold_scores(_importances(spark), _reverse(spark))
    wide = S.wide_folds(scores, 2)
    assert wide.columns == ["method", "feature", "0", "1"] and wide.count() == 18
    R.export_csv(cv_aggregate(scores).withColumn("cv_aggregator", F.lit("x")), str(tmp_path / "csv"), ["Reverse"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["feature", "Reverse", "cv_aggregator"] and back.count() == 3


def test_store(spark, tmp_path):
    folder = str(tmp_path / "results")
    imp = _importances(spark)
    assert R.store_results(imp, folder, 2).count() == imp.count()
    other = imp.withColumn("experiment_id", F.lit(2).cast("long"))
    R.store_results(other, folder, 2)
    R.store_results(other, folder, 2)  # again: replaced, not doubled
    loaded = R.load_results(spark, folder, 2, ["a"])
    assert loaded.count() == imp.where("method = 'a'").count()
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment_id" in plan
    key = ["experiment_id", "method", "outer_fold", "inner_fold", "kind", "feature", "value"]
    flat = R.flatten_results(R.nest_results(imp)).select(*key)
    assert flat.exceptAll(imp.select(*key)).isEmpty() and flat.count() == imp.count()
    with pytest.raises(ValueError):
        R.store_results(_importances(spark, drop={0, 4, 8}).where("not (kind = 'macro' and inner_fold = 0)"), str(tmp_path / "bad"), 2)


def test_runs_are_stored_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "runs")
    imp = _importances(spark)
    rows = [(1, m, o, 0.5, {"alpha": 0.1}) for m, o in {(r.method, r.outer_fold) for r in imp.select("method", "outer_fold").distinct().collect()}]
    fits = spark.createDataFrame(rows, "experiment_id bigint, method string, outer_fold int, validation_metric double, best_params map<string,double>")
    run = R.Run(imp, fits, _reverse(spark))
    assert R.load_run(spark, folder).importances.isEmpty()
    first = R.store_run(run, folder, 1, 2)
    assert R.load_run(spark, folder).importances.count() == imp.where("experiment_id = 1").count()
    better = R.Run(imp, fits.withColumn("validation_metric", F.lit(0.75)), run.reverse)
    second = R.store_run(better, folder, 1, 2)
    hole = F.when(F.col("outer_fold") == 1, float("nan")).otherwise(F.col("validation_metric"))
    broken = (
        R.Run(imp, fits.where("outer_fold = 0"), run.reverse),
        R.Run(imp, fits.withColumn("validation_metric", hole), run.reverse),
        R.Run(imp, fits.withColumn("best_params", F.lit(None)), run.reverse),
        R.Run(imp, fits.unionAll(fits), run.reverse),
        R.Run(imp.where("kind <> 'micro'"), fits, run.reverse),
        R.Run(imp.withColumn("feature", F.lit("")), fits, run.reverse),
        R.Run(imp, fits, run.reverse.withColumn("labeled", F.lit(None).cast("double"))),
    )
    for bad in broken:
        with pytest.raises(ValueError):
            R.store_run(bad, folder, 1, 2)
    loaded = R.load_run(spark, folder, [1])
    assert {r.validation_metric for r in loaded.fits.collect()} == {0.75}
    assert loaded.reverse.count() == run.reverse.where("experiment_id = 1").count()
    seen = {r.version: (r["seq"], r.parts["fits"]) for r in V.manifest(spark, folder).collect()}
    assert seen == {first: (1, len(rows)), second: (2, len(rows))}
    assert R.load_run(spark, folder, [7]).fits.isEmpty()


def test_log_entries_are_appended(spark, tmp_path):
    folder = str(tmp_path / "log")
    entries = spark.createDataFrame([(1, "a", 2.0)], "experiment_id bigint, element string, seconds double")
    R.append_log(entries, folder)
    log = R.append_log(entries.withColumn("seconds", F.lit(3.0)), folder)
    assert sorted((r["seq"], r.seconds) for r in log.collect()) == [(1, 2.0), (2, 3.0)]


def test_prepared_splits_are_read_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, 1 + i % 2, rng.normal(size=3).tolist()) for i in range(40)]
    path, folder = str(tmp_path / "samples"), str(tmp_path / "splits")
    spark.createDataFrame(rows, "sample_id bigint, label int, features array<double>").write.parquet(path)
    settings = Settings(n_outer_folds=2, n_inner_folds=2)
    first, there = prepared_splits(spark.read.parquet(path), folder, settings)
    assert not there
    again, there = prepared_splits(spark.read.parquet(path), folder, settings)
    assert there and again.rows().exceptAll(first.rows()).isEmpty() and again.rows().count() == first.rows().count()
    assert not prepared_splits(spark.read.parquet(path), folder, Settings(n_outer_folds=2, n_inner_folds=2, seed=1))[1]
    spark.createDataFrame(rows[:1], "sample_id bigint, label int, features array<double>").write.mode("append").parquet(path)
    assert V.fingerprint(spark.read.parquet(path), settings) not in V.latest(spark, folder)
    with pytest.raises(ValueError):
        V.fingerprint(spark.range(3), settings)


def test_experiments(spark, tmp_path):
    empty = spark.createDataFrame([], "experiment_id long, created timestamp, settings map<string,string>")
    assert R.next_experiment_id(empty).first()[0] == 1
    catalog = R.register_experiment(spark, str(tmp_path / "e"), empty, {"n": "1"})
    catalog = R.register_experiment(spark, str(tmp_path / "e"), catalog, {"n": "2"})
    assert sorted(r.experiment_id for r in catalog.collect()) == [1, 2]
    assert R.find_experiments(catalog, F.col("settings")["n"] == "2").first().experiment_id == 2


def test_expectations(spark):
    imp = _importances(spark)
    assert Q.check_standard(imp, 2).isEmpty()
    assert Q.check_standard(imp, 3).count() == 4
    assert Q.check_standard(imp.withColumn("value", F.when(F.col("feature") == "f1", float("nan")).otherwise(F.col("value"))), 2).count() == 4
    assert Q.check_standard(imp.where("kind <> 'micro'"), 2).count() == 4
    assert Q.check_reverse(_reverse(spark)).isEmpty()
    with pytest.raises(TypeError):
        Q.check_reverse(_reverse(spark).withColumn("labeled", F.lit("x")))
    assert Q.check_outer_folds(imp, 2, 3).isEmpty() and Q.check_outer_folds(imp, 3, 3).count() == 2
    assert [r.method for r in Q.check_methods(imp, ["a", "c"]).collect()] == ["c"]
    assert Q.check_non_negative(S.micro_scores(imp)).count() == 4
    assert Q.check_non_negative(S.micro_scores(imp, absolute=True)).isEmpty()
    with pytest.raises(ValueError):
        Q.require_empty(Q.check_methods(imp, ["c"]), "methods")


def _sample(minute, node="node1", watts=10.0, ok=True, element="preprocessing"):
    return (T0 + dt.timedelta(minutes=minute), node, element, watts, watts / 2, watts / 4, ok)


def test_meters(spark):
    rows = [_sample(0), _sample(1, ok=False), _sample(2, element="feature_selection"), _sample(3, node="node9")]
    samples = spark.createDataFrame(rows, POWER_SAMPLES)
    totals = {(r.workflow_element, r.node_id): (r.total_w, r.number_of_measurements, r.error) for r in M.power_totals(samples, ["node1"]).collect()}
    assert totals == {("preprocessing", "node1"): (10.0, 1, 1), ("feature_selection", "node1"): (10.0, 1, 0)}
    window = M.power_windows(samples, M.sampling_seconds(), node_ids=["node1"]).first()
    assert (window.joules, window.n_samples) == (10.0 + 600.0, 2)
    base = M.power_baseline(samples, F.col("workflow_element") == "preprocessing")
    assert M.net_power(samples, base).where("node_id = 'node1'").agg(F.max("net_w")).first()[0] == 0.0
    marks = samples.select(F.lit(1).alias("experiment_id"), F.col("workflow_element").alias("element"), "ts")
    assert {r.element: r.seconds for r in M.element_durations(marks).collect()} == {"preprocessing": 180.0, "feature_selection": 0.0}
    assert M.workflow_durations(marks).first().seconds == 180.0


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, POWER_SAMPLES).coalesce(1).write.mode("append").parquet(source)
        write_power_windows(sample_stream(spark, source), M.sampling_seconds(), out, state).awaitTermination()

    first = [_sample(m) for m in (0, 30, 61, 150)]
    run(first)
    run([_sample(5, watts=99.0), _sample(400)])  # minute 5 is behind the watermark
    got = {(r.window_start, r.joules) for r in spark.read.parquet(out).collect()}
    kept = spark.createDataFrame(first, POWER_SAMPLES)
    want = {(r.window_start, r.joules) for r in M.power_windows(kept, M.sampling_seconds()).collect()}
    assert got == want
