"""Queries over stored results, quality checks, trials, meters and linear attributions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.functions.expressions import rounded
from featwright.operators import expectations as Q
from featwright.operators import metering as M
from featwright.operators import scores as S
from featwright.operators import trials as D
from featwright.operators.attribution import linear_attribution
from featwright.operators.reverse_quality import label_weight_filter, pooled_r2, reverse_best
from featwright.plans.ensemble import cv_aggregate
from featwright.settings import Settings
from featwright.sources import results_store as R
from featwright.storage import shared_dir, stage
from featwright.streaming.power import sample_stream, write_power_windows
from workload import inputs, table_queries
from workload.score_queries import CV_SCORES, LINE_SCORES, RAW_RESULTS, pct, q6

NODES = Settings().node_ids
_IMPORTANCE_COLUMNS = ["experiment_id", "method", "outer_fold", "inner_fold", "kind", "feature", "value"]


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _value(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns or ("value",)})


# ---- stored results ----------------------------------------------------------


def store_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.store_results(inputs.importances(spark, sf_dir), _new_folder(spark, "results")).select(*_IMPORTANCE_COLUMNS)


def load_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "results")
    R.store_results(inputs.importances(spark, sf_dir), folder)
    return R.load_results(spark, folder, 2, ["m_A", "m_N"]).select(*_IMPORTANCE_COLUMNS)


def store_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both experiments stored whole; the first again with other metrics, and once more with a hole, which readers never see."""
    folder = _new_folder(spark, "runs")
    run = R.Run(*[stage(f(spark, sf_dir)) for f in (inputs.importances, inputs.fits, inputs.raw_reverse)])
    doubled = R.Run(run.importances, run.fits.withColumn("validation_metric", F.col("validation_metric") * 2), run.reverse)
    broken = R.Run(run.importances, run.fits.where("outer_fold <> 3"), run.reverse)
    for experiment, what in ((1, run), (2, run), (1, doubled)):
        R.store_run(what, folder, experiment, 3)
    try:
        R.store_run(broken, folder, 2, 3)
    except ValueError:
        pass
    else:
        raise RuntimeError("a run without metrics was stored")
    loaded = R.load_run(spark, folder)
    keys = ["experiment_id", "method", "outer_fold"]
    values = loaded.importances.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("value").alias("total"))
    reverse = loaded.reverse.groupBy("experiment_id").agg(F.count("*").alias("n_reverse"), F.sum("labeled").alias("labeled"))
    rows = values.join(loaded.fits, keys).join(reverse, "experiment_id")
    params = {c: F.col("best_params")[c] for c in ("alpha", "depth")}
    return _value(rows.withColumns(params).drop("best_params"), "total", "labeled", "validation_metric", "alpha", "depth")


def flatten_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = R.nest_results(inputs.importances(spark, sf_dir))
    return R.flatten_results(nested).select(*_IMPORTANCE_COLUMNS)


def experiment_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    experiments = inputs.experiments(spark, sf_dir)
    following = R.next_experiment_id(experiments).scalar()
    return experiments.select(
        "experiment_id", F.col("created").cast("timestamp_ntz").alias("created"), F.col("settings")["orders"].alias("orders"), following.alias("next_id")
    )


def export_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide CSV of the single-method table, read back."""
    scores = cv_aggregate(inputs.line_fold_scores(spark, sf_dir).drop("feature_ord"))
    folder = _new_folder(spark, "export")
    R.export_csv(_value(scores, "score").withColumn("cv_aggregator", F.lit("ArithmeticMean")), folder, inputs.MEASURES)
    columns = ", ".join(f"{m} double" for m in inputs.MEASURES)
    return spark.read.schema(f"feature string, {columns}, cv_aggregator string").csv(folder, header=True)


def benchmark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = inputs.marks(spark, sf_dir)
    energy = marks.groupBy("experiment_id", "element", "node_id").agg(F.sum("value").alias("joules"))
    return _value(R.log_benchmark(M.element_durations(marks), energy), "seconds", "joules")


# ---- expectations ------------------------------------------------------------


def _damaged_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inner fold left out, one value not a number."""
    gone = (F.col("method") == "m_A") & (F.col("outer_fold") == 2) & (F.col("inner_fold") == 1)
    odd = (F.col("feature") == "p_1") & (F.col("kind") == "macro")
    return (
        inputs.importances(spark, sf_dir)
        .where(~F.coalesce(gone, F.lit(False)))
        .withColumn("value", F.when(odd, float("nan")).otherwise(F.col("value")))
    )


def check_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = (F.col("outer_fold") == 3) & (F.col("feature") == "p_2")
    raw = inputs.raw_reverse(spark, sf_dir)
    return Q.check_reverse(raw.withColumn("labeled", F.when(~hole, F.col("labeled"))))


def check_outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = inputs.unscaled_line_scores(spark, sf_dir).withColumn("experiment_id", F.lit(1).cast("bigint"))
    gone = (F.col("method") == "max_tax") & (F.col("outer_fold") == 6)
    n_features = inputs.table(spark, sf_dir, "part").count()
    return Q.check_outer_folds(scores.where(~gone), len(inputs.LINE_FOLDS), n_features)


def check_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_methods(inputs.importances(spark, sf_dir), ["m_A", "m_N", "m_R", "m_X"])


# ---- trials ------------------------------------------------------------------

_KEYS = ["method", "outer_fold"]


def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = D.trial_scores(inputs.fold_trials(spark, sf_dir), _KEYS)
    return _value(D.best_trial(mean, _KEYS), "score")


def prune_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.prune_trials(inputs.fold_trials(spark, sf_dir), _KEYS, keep=0.5)
    return _value(kept.select(*_KEYS, "trial_id", "score"), "score")


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = (
        inputs.predictions(spark, sf_dir)
        .groupBy("outer_fold", "target", "trial_id", "inner_fold")
        .agg((F.sum("_label_part") / 64.0).alias("weight"))
    )
    # small weights count as none, so that some trials drop out
    weights = weights.withColumn("weight", F.when(F.abs("weight") >= 0.5, F.col("weight")).otherwise(0.0))
    return label_weight_filter(weights, ["outer_fold", "target", "trial_id"])


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(pooled_r2(inputs.predictions(spark, sf_dir), ["outer_fold", "target", "trial_id"]), "r2")


def reverse_best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction half right and one from the quantity alone stand for the fits with and without the label."""
    keys = ["outer_fold", "target"]
    rows = inputs.predictions(spark, sf_dir)
    unlabeled = pooled_r2(rows, [*keys, "trial_id"]).withColumnRenamed("r2", "unlabeled")
    labeled = pooled_r2(rows.withColumn("prediction", F.col("y") / 2 + F.col("prediction") / 1.5), [*keys, "trial_id"])
    trials = labeled.withColumnRenamed("r2", "labeled").join(unlabeled, [*keys, "trial_id"])
    refits = rows.groupBy(*keys, "trial_id").agg((F.sum("_label_part") / 64.0).alias("label_weight"))
    return _value(reverse_best(trials, refits, keys), "labeled", "unlabeled")


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of a feature is the distance of the two class means on the train part."""
    cells = table_queries._split_cells(spark, sf_dir)
    train = cells.where(F.col("role") == "train")
    weights = train.groupBy("outer_fold", "feature").agg(
        (F.avg(F.when(F.col("label") == 2, F.col("value"))) - F.avg(F.when(F.col("label") == 1, F.col("value")))).alias("weight"),
        F.avg("value").alias("mean"),
    )
    return _value(linear_attribution(cells.where(F.col("role") == "valid"), stage(weights)))


# ---- meters ------------------------------------------------------------------


def power_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(M.power_totals(inputs.power_samples(spark, sf_dir), NODES), "total_w", "cpu_w", "peg_w")


def _window_rows(windows: DataFrame) -> DataFrame:
    # the tables hold times without a zone
    return _value(windows, "joules").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def power_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inputs.power_samples(spark, sf_dir)
    return _window_rows(M.power_windows(samples, M.sampling_seconds(), node_ids=NODES))


def power_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream; the windows still open at its end are not out yet."""
    source, out, state = (_new_folder(spark, n) for n in ("samples", "windows", "state"))
    inputs.power_samples(spark, sf_dir).write.parquet(source)
    write_power_windows(
        sample_stream(spark, source), M.sampling_seconds(), out, state, node_ids=NODES
    ).awaitTermination()
    return _window_rows(spark.read.parquet(out))


def power_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inputs.power_samples(spark, sf_dir)
    return _value(M.power_baseline(samples, F.col("total_w") < 20, NODES), "baseline_w")


def benchmark_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.element_durations(inputs.marks(spark, sf_dir))


# ---- the same in SQL -------------------------------------------------------

SAMPLES = """
samples AS (
  SELECT ts, 'node' || CAST(user_id % 5 AS VARCHAR) AS node_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'preprocessing' ELSE 'feature_selection' END AS workflow_element,
         value AS total_w, value / 2 AS cpu_w, value / 4 AS peg_w, event_type <> 'error' AS ok
  FROM events),
wanted AS (SELECT * FROM samples WHERE node_id IN ('node4', 'node3', 'node1')),
windows AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, node_id,
         sum(total_w * CASE workflow_element WHEN 'preprocessing' THEN 1 ELSE 60 END) AS joules, count(*) AS n_samples
  FROM wanted WHERE ok GROUP BY 1, 2)"""

TRIALS = f"""
trials AS (
  SELECT o_orderpriority AS method, CAST(o_custkey % 6 AS INTEGER) AS outer_fold,
         CAST(o_orderkey % 30 AS INTEGER) AS trial_id, CAST((o_orderkey // 30) % 5 AS INTEGER) AS inner_fold,
         CAST(sum({pct('o_totalprice')}) AS DOUBLE) / count(*) AS score
  FROM orders GROUP BY 1, 2, 3, 4)"""


def queries() -> dict:
    return {
        "store_results": store_results,
        "load_results": load_results,
        "store_run": store_run,
        "flatten_results": flatten_results,
        "experiment_catalog": experiment_catalog,
        "export_results": export_results,
        "benchmark_log": benchmark_log,
        "check_standard": lambda s, d: Q.check_standard(_damaged_importances(s, d), 3),
        "check_reverse": check_reverse,
        "check_outer_folds": check_outer_folds,
        "check_methods": check_methods,
        "check_non_negative": lambda s, d: Q.check_non_negative(S.micro_scores(inputs.importances(s, d))),
        "best_trial": best_trial,
        "prune_trials": prune_trials,
        "pooled_r2": pooled,
        "label_weight_filter": label_weights,
        "reverse_best_trial": reverse_best_trial,
        "linear_attribution": linear,
        "power_totals": power_totals,
        "power_windows": power_windows,
        "power_windows_stream": power_windows_stream,
        "power_baseline": power_baseline,
        "benchmark_durations": benchmark_durations,
    }


def oracle_sql() -> dict[str, str]:
    columns = ", ".join(_IMPORTANCE_COLUMNS)
    everything = f"WITH {RAW_RESULTS} SELECT {columns} FROM importances"
    wide = ", ".join(f"max(CASE WHEN method = '{m}' THEN {q6('score')} END) AS {m}" for m in inputs.MEASURES)
    seconds = "epoch_us(max(ts)) - epoch_us(min(ts))"
    return {
        "store_results": everything,
        "flatten_results": everything,
        "store_run": f"WITH {RAW_RESULTS}, v AS (SELECT experiment_id, method, outer_fold, count(*) AS n_values, sum(value) AS total"
        " FROM importances GROUP BY 1, 2, 3), f AS (SELECT 1 + l_partkey % 2 AS experiment_id, 'm_' || l_returnflag AS method,"
        f" l_linenumber - 1 AS outer_fold, sum({pct('l_discount')}) / count(*) AS metric, sum({pct('l_tax')}) / count(*) AS alpha,"
        " max(l_quantity) AS depth FROM lineitem GROUP BY 1, 2, 3),"
        " r AS (SELECT experiment_id, count(*) AS n_reverse, sum(labeled) AS labeled FROM raw_reverse GROUP BY 1)"
        f" SELECT experiment_id, method, outer_fold, n_values, {q6('total')} AS total, n_reverse, {q6('labeled')} AS labeled,"
        f" {q6('metric * CASE WHEN experiment_id = 1 THEN 2 ELSE 1 END')} AS validation_metric, {q6('alpha')} AS alpha,"
        f" {q6('CAST(depth AS DOUBLE)')} AS depth FROM v JOIN f USING (experiment_id, method, outer_fold) JOIN r USING (experiment_id)",
        "load_results": everything + " WHERE experiment_id = 2 AND method <> 'm_R'",
        "experiment_catalog": "SELECT o_custkey AS experiment_id, min(o_orderdate) AS created,"
        " CAST(count(*) AS VARCHAR) AS orders, max(o_custkey) OVER () + 1 AS next_id FROM orders GROUP BY o_custkey",
        "export_results": f"WITH {CV_SCORES} SELECT feature, {wide}, 'ArithmeticMean' AS cv_aggregator FROM cv_scores GROUP BY 1",
        "benchmark_log": "WITH m AS (SELECT user_id % 50 AS experiment_id, event_type AS element,"
        " 'node' || CAST(user_id % 5 AS VARCHAR) AS node_id, ts, value FROM events),"
        f" d AS (SELECT experiment_id, element, ({seconds}) / 1e6::DOUBLE AS seconds FROM m GROUP BY 1, 2),"
        " e AS (SELECT experiment_id, element, node_id, sum(value) AS joules FROM m GROUP BY 1, 2, 3)"
        f" SELECT experiment_id, element, {q6('seconds')} AS seconds, node_id, {q6('joules')} AS joules"
        " FROM d LEFT JOIN e USING (experiment_id, element)",
        "check_standard": f"WITH {RAW_RESULTS}, damaged AS (SELECT experiment_id, method, outer_fold, inner_fold, kind,"
        " CASE WHEN feature = 'p_1' AND kind = 'macro' THEN 'nan'::DOUBLE ELSE value END AS value FROM importances"
        " WHERE NOT coalesce(method = 'm_A' AND outer_fold = 2 AND inner_fold = 1, false)),"
        " report AS (SELECT experiment_id, method, outer_fold,"
        " count(DISTINCT inner_fold) FILTER (WHERE kind = 'macro') AS macro_folds,"
        " count(DISTINCT inner_fold) FILTER (WHERE kind = 'shap') AS shap_folds,"
        " count(*) FILTER (WHERE kind = 'micro') AS micro_values,"
        " count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS missing_values FROM damaged GROUP BY 1, 2, 3)"
        " SELECT * FROM report WHERE macro_folds <> 3 OR shap_folds NOT IN (0, 3) OR micro_values = 0 OR missing_values > 0",
        "check_reverse": f"WITH {RAW_RESULTS} SELECT experiment_id, method, outer_fold, count(*) AS missing_values"
        " FROM raw_reverse WHERE outer_fold = 3 AND feature = 'p_2' GROUP BY 1, 2, 3",
        "check_outer_folds": f"WITH {LINE_SCORES}, f AS (SELECT method, outer_fold, count(DISTINCT feature) AS n FROM line_scores"
        " WHERE NOT (method = 'max_tax' AND outer_fold = 6) GROUP BY 1, 2) SELECT CAST(1 AS BIGINT) AS experiment_id, method,"
        " count(*) AS n_folds, min(n) AS fewest_features FROM f GROUP BY 2"
        " HAVING count(*) <> 7 OR min(n) <> (SELECT count(*) FROM part)",
        "check_methods": f"WITH {RAW_RESULTS} SELECT m AS method FROM (VALUES ('m_A'), ('m_N'), ('m_R'), ('m_X')) v(m)"
        " WHERE m NOT IN (SELECT method FROM importances)",
        "check_non_negative": f"WITH {RAW_RESULTS} SELECT method, outer_fold, count(*) AS n_negative FROM micro"
        " WHERE score < 0 GROUP BY 1, 2",
        "best_trial": f"WITH {TRIALS}, means AS (SELECT method, outer_fold, trial_id, avg(score) AS score FROM trials GROUP BY 1, 2, 3)"
        f" SELECT method, outer_fold, trial_id, {q6('score')} AS score FROM (SELECT *, row_number() OVER"
        " (PARTITION BY method, outer_fold ORDER BY score DESC, trial_id) AS place FROM means) WHERE place = 1",
        "prune_trials": f"WITH {TRIALS}, running AS (SELECT *, avg(score) OVER (PARTITION BY method, outer_fold, trial_id"
        " ORDER BY inner_fold) AS mean FROM trials), placed AS (SELECT *, percent_rank() OVER (PARTITION BY method,"
        " outer_fold, inner_fold ORDER BY mean DESC) AS place FROM running)"
        f" SELECT method, outer_fold, trial_id, {q6('avg(score)')} AS score FROM placed GROUP BY 1, 2, 3 HAVING max(place) <= 0.5",
        "pooled_r2": "SELECT l_linenumber - 1 AS outer_fold, l_returnflag AS target, CAST(l_suppkey % 10 AS INTEGER) AS trial_id,"
        " " + q6("1 - sum(pow(l_extendedprice / 1000 - l_quantity * 1.5, 2)) / (var_pop(l_extendedprice / 1000) * count(*))")
        + " AS r2 FROM lineitem GROUP BY 1, 2, 3",
        "label_weight_filter": "WITH w AS (SELECT l_linenumber - 1 AS outer_fold, l_returnflag AS target,"
        " CAST(l_suppkey % 10 AS INTEGER) AS trial_id, l_orderkey % 3 AS inner_fold,"
        " sum(CAST(l_quantity AS BIGINT) - 25) / 64.0::DOUBLE AS weight FROM lineitem GROUP BY 1, 2, 3, 4)"
        " SELECT outer_fold, target, trial_id FROM w GROUP BY 1, 2, 3 HAVING min(abs(weight)) >= 0.5",
        "reverse_best_trial": "WITH lines AS (SELECT l_linenumber - 1 AS outer_fold, l_returnflag AS target,"
        " CAST(l_suppkey % 10 AS INTEGER) AS trial_id, l_extendedprice / 1000 AS y, l_quantity AS q FROM lineitem),"
        " trials AS (SELECT outer_fold, target, trial_id,"
        " 1 - sum(pow(y - (y / 2 + q), 2)) / (var_pop(y) * count(*)) AS labeled,"
        " 1 - sum(pow(y - q * 1.5, 2)) / (var_pop(y) * count(*)) AS unlabeled,"
        " sum(CAST(q AS BIGINT) - 25) AS weight FROM lines GROUP BY 1, 2, 3)"
        f" SELECT outer_fold, target, trial_id, {q6('labeled')} AS labeled, {q6('unlabeled')} AS unlabeled FROM"
        " (SELECT *, row_number() OVER (PARTITION BY outer_fold, target ORDER BY labeled DESC, trial_id) AS place FROM trials)"
        " WHERE place = 1 AND labeled > 0 AND weight <> 0",
        "linear_attribution": f"WITH {table_queries.SPLIT_CELLS}, labelled AS (SELECT c.*, s.label FROM split_cells c"
        " JOIN samples s USING (sample_id)), w AS (SELECT outer_fold, feature, avg(value) AS m,"
        " avg(value) FILTER (WHERE label = 2) - avg(value) FILTER (WHERE label = 1) AS weight FROM labelled"
        f" WHERE role = 'train' GROUP BY 1, 2) SELECT outer_fold, feature, {q6('sum(abs(weight * (value - m)))')} AS value"
        " FROM labelled JOIN w USING (outer_fold, feature) WHERE role = 'valid' GROUP BY 1, 2",
        "power_totals": f"WITH {SAMPLES} SELECT workflow_element, node_id,"
        + ", ".join(f" {q6(f'coalesce(sum({c}) FILTER (WHERE ok), 0)')} AS {c}" for c in ("total_w", "cpu_w", "peg_w"))
        + ", count(*) FILTER (WHERE ok) AS number_of_measurements, count(*) FILTER (WHERE NOT ok) AS error"
        " FROM wanted GROUP BY 1, 2",
        "power_windows": f"WITH {SAMPLES} SELECT window_start, node_id, {q6('joules')} AS joules, n_samples FROM windows",
        "power_windows_stream": f"WITH {SAMPLES} SELECT window_start, node_id, {q6('joules')} AS joules, n_samples FROM windows"
        " WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM wanted WHERE ok) - INTERVAL 2 MINUTE",
        "power_baseline": f"WITH {SAMPLES} SELECT node_id, {q6('avg(total_w)')} AS baseline_w, count(*) AS n_samples"
        " FROM wanted WHERE ok AND total_w < 20 GROUP BY 1",
        "benchmark_durations": f"SELECT user_id % 50 AS experiment_id, event_type AS element, ({seconds}) / 1e6::DOUBLE AS seconds"
        " FROM events GROUP BY 1, 2",
    }
