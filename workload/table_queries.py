"""Queries over labelled tables: reading, filters, folds, transforms, correlations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featwright.functions.expressions import rounded
from featwright.operators import folds, prepare, transform
from featwright.operators.gram import correlations, spearman_correlations
from featwright.plans.splits import prepared_splits
from featwright.settings import Settings
from featwright.sources import tables
from featwright.storage import shared_dir, stage
from workload import inputs
from workload.score_queries import pct, q6

SETTINGS = Settings()
K = SETTINGS.n_outer_folds


def _value(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, rounded(F.col(column)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells_of_vectors(inputs.embedding_samples(spark, sf_dir))


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells_of(
        inputs.orders_wide(spark, sf_dir), "sample_id", "label", inputs.ORDER_FEATURES
    )


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors with their outer fold; the vectors ride along."""
    return folds.stratified_folds(inputs.embedding_samples(spark, sf_dir), K)


def _fold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells_of_vectors(_dealt(spark, sf_dir))


def _split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells_of_vectors(folds.expand_folds(_dealt(spark, sf_dir), "outer_fold", K))


def scan_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("sample_id", "label", "feature", "value")


def scan_labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = prepare.limit_features(_order_cells(spark, sf_dir), SETTINGS.number_of_features)
    return cells.select("sample_id", "label", "feature", "value")


def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names and places of the labelled table, with their mean as a check of the scan."""
    wide = inputs.orders_wide(spark, sf_dir).drop("sample_id")
    catalog = tables.feature_catalog(wide.columns, spark, 8)
    seen = _order_cells(spark, sf_dir).groupBy("feature").agg(F.count("value").alias("n_values"))
    return seen.join(catalog, "feature").select("feature", "feature_ord", "n_values")


def drop_separating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-way label is put in as a feature: it separates the two classes."""
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.when(F.col("label") < 5, 1).otherwise(2).alias("label"),
        F.array_append(F.col("embedding").cast("array<double>"), F.col("label").cast("double")).alias("features"),
    )
    cells = prepare.drop_separating_features(tables.cells_of_vectors(vectors))
    return _value(cells.select("sample_id", "feature", "value"))


def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inputs.embedding_samples(spark, sf_dir).select("sample_id", "label")
    return folds.nested_folds(samples).select("sample_id", "outer_fold", "inner_fold", "role")


def check_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = inputs.embedding_samples(spark, sf_dir).select("sample_id", "label")
    return folds.check_splits(folds.nested_folds(samples))


def _exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most likely exponents, to four decimals."""
    found = transform.yeojohnson_lambda(tables.cells_of_vectors(stage(_dealt(spark, sf_dir), spread="sample_id")))
    return found.select("outer_fold", "feature", rounded(F.col("lambda"), 4).alias("lambda"), "status")


def yeojohnson_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exponents(spark, sf_dir)


def yeojohnson_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _split_cells(spark, sf_dir).where(F.col("role") == "train")
    return _value(transform.yeojohnson_grid(train).select("outer_fold", "feature", "lambda"), "lambda")


def yeojohnson_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform.yeojohnson_apply(_split_cells(spark, sf_dir), stage(_exponents(spark, sf_dir)))
    return _value(done.select("outer_fold", "role", "sample_id", "feature", "value"))


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = transform.held_out_moments(_fold_cells(spark, sf_dir), ["feature"], "outer_fold", "value")
    moments = stage(moments.withColumn("std", F.sqrt("var")))
    done = transform.standardize(_split_cells(spark, sf_dir), moments)
    return _value(done.select("outer_fold", "role", "sample_id", "feature", "value"))


def _train_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.expand_folds(_dealt(spark, sf_dir), "outer_fold", K).where(F.col("role") == "train")


def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(correlations(_train_vectors(spark, sf_dir), ["outer_fold"]), "r")


def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spearman_correlations(_cells(spark, sf_dir)), "r")


def uncorrelated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six folds; the features of the test table are all but independent, hence a low threshold."""
    return prepare.uncorrelated_features(_train_vectors(spark, sf_dir), ["outer_fold"], 0.05)


def reuse_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared twice: the second time the stored splits of the same files and settings are read. Their outer exponents."""
    folder = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    samples = inputs.embedding_samples(spark, sf_dir)
    for there in (False, True):
        splits, found = prepared_splits(samples, folder, SETTINGS, "embeddings")
        if found != there:
            raise RuntimeError("prepared splits were not stored, or read too early")
    outer = splits.fitted.where("inner_fold IS NULL").select("outer_fold", F.inline("_fit"))
    name = F.concat(F.lit("f_"), F.col("feature_ord").cast("string"))
    return outer.select("outer_fold", name.alias("feature"), rounded(F.col("lambda"), 4).alias("lambda"))


# ---- the same in SQL -------------------------------------------------------

CELLS = """
samples AS (
  SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 1 ELSE 2 END AS label, embedding FROM embeddings),
cells AS (
  SELECT sample_id, label, 'f_' || CAST(pos - 1 AS VARCHAR) AS feature, pos - 1 AS feature_ord,
         CAST(embedding[pos] AS DOUBLE) AS value
  FROM samples, (SELECT unnest(range(1, 65)) AS pos))"""

DEALT = CELLS + f""",
dealt AS (
  SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label
           ORDER BY md5('42|' || CAST(sample_id AS VARCHAR))) - 1) % {K} AS INTEGER) AS fold
  FROM samples)"""

SPLITS = DEALT + f""",
splits AS (
  SELECT sample_id, label, CAST(k AS INTEGER) AS outer_fold, CASE WHEN fold = k THEN 'valid' ELSE 'train' END AS role
  FROM dealt, range({K}) r(k))"""

NESTED = SPLITS + f""",
dealt_inner AS (
  SELECT sample_id, label, outer_fold, (row_number() OVER (PARTITION BY outer_fold, label
           ORDER BY md5('42|' || CAST(outer_fold AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR))) - 1) % 5 AS fold
  FROM splits WHERE role = 'train'),
nested AS (
  SELECT sample_id, label, outer_fold, NULL AS inner_fold, role FROM splits
  UNION ALL
  SELECT sample_id, label, outer_fold, CAST(k AS INTEGER), CASE WHEN fold = k THEN 'valid' ELSE 'train' END
  FROM dealt_inner, range(5) r(k))"""

SPLIT_CELLS = SPLITS + """,
split_cells AS (
  SELECT outer_fold, role, sample_id, feature, feature_ord, value
  FROM splits JOIN cells USING (sample_id))"""


def _yj(x: str, lam: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 THEN CASE WHEN {lam} = 0 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END "
        f"ELSE CASE WHEN {lam} = 2 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END"
    )


def _slope_of(u: str, p: str) -> tuple[str, str]:
    """The size of the transform and its derivative by the power ``p``; ``u`` is ln(1 + |x|)."""
    grown = f"CASE WHEN {p} = 0 THEN {u} ELSE (exp({p} * {u}) - 1) / {p} END"
    slope = (
        f"CASE WHEN abs({p} * {u}) < 1e-3 THEN {u} * {u} * (0.5 + {p} * {u} / 3 + {p} * {u} * {p} * {u} / 8)"
        f" ELSE ({u} * exp({p} * {u}) - (exp({p} * {u}) - 1) / {p}) / {p} END"
    )
    return grown, slope


_GROWN, _SLOPE = _slope_of("u", "p")
# the likelihood's slope falls with the exponent: halve a wide bracket 48 times
LAMBDAS = SPLIT_CELLS + f""",
train AS MATERIALIZED (
  SELECT outer_fold, feature, sign(value) AS side, ln(1 + abs(value)) AS u FROM split_cells WHERE role = 'train'),
halved AS (
  SELECT outer_fold, feature, CAST(-64 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi, 0 AS step FROM train GROUP BY 1, 2
  UNION ALL
  SELECT outer_fold, feature, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END, step + 1
  FROM (
    SELECT outer_fold, feature, lo, hi, mid, step, avg(side * u) - covar_pop(t, dt) / var_pop(t) AS slope FROM (
      SELECT *, CASE WHEN side < 0 THEN -({_GROWN}) ELSE {_GROWN} END AS t, {_SLOPE} AS dt FROM (
        SELECT h.*, (lo + hi) / 2 AS mid, side, u, CASE WHEN side < 0 THEN 2 - (lo + hi) / 2 ELSE (lo + hi) / 2 END AS p
        FROM halved h JOIN train t ON t.outer_fold = h.outer_fold AND t.feature = h.feature WHERE step < 48))
    GROUP BY ALL)),
lambdas AS MATERIALIZED (
  SELECT outer_fold, feature, floor((lo + hi) / 2 * 1e4 + 0.5001) / 1e4 AS lam FROM halved WHERE step = 48)"""

_MEASURES = (("quantity", "CAST(l_quantity AS BIGINT)"), ("price", pct("l_extendedprice")), ("discount", pct("l_discount")), ("tax", pct("l_tax")))
ORDER_CELLS = (
    "lines AS (SELECT l_orderkey, "
    + ", ".join(
        f"CAST(sum({v}) AS DOUBLE) AS sum_{n}, CAST(sum({v}) AS DOUBLE) / count(*) AS avg_{n}" for n, v in _MEASURES
    )
    + " FROM lineitem GROUP BY 1),\n"
    + "wide AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS label,"
    + f" CAST({pct('o_totalprice')} AS DOUBLE) AS total_price, lines.* EXCLUDE (l_orderkey)"
    + " FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),\n"
    + "cells AS ("
    + " UNION ALL ".join(
        f"SELECT sample_id, label, '{n}' AS feature, {i} AS feature_ord, {n} AS value FROM wide"
        for i, n in enumerate(inputs.ORDER_FEATURES)
    )
    + ")"
)


def queries() -> dict:
    return {
        "scan_labelled_cells": scan_labelled_cells,
        "scan_vector_cells": scan_vector_cells,
        "feature_catalog": feature_catalog,
        "null_report": lambda s, d: prepare.null_report(_order_cells(s, d)),
        "limit_features": lambda s, d: prepare.limit_features(_cells(s, d), 33).select("sample_id", "feature", "value"),
        "drop_separating_features": drop_separating_features,
        "uncorrelated_features": uncorrelated_features,
        "stratified_folds": lambda s, d: folds.stratified_folds(inputs.order_samples(s, d), K),
        "nested_folds": nested_folds,
        "check_splits": check_splits,
        "yeojohnson_lambda": yeojohnson_lambda,
        "yeojohnson_grid": yeojohnson_grid,
        "yeojohnson_apply": yeojohnson_apply,
        "reuse_splits": reuse_splits,
        "standardize": standardize,
        "corr_pearson": corr_pearson,
        "corr_spearman": corr_spearman,
    }


def oracle_sql() -> dict[str, str]:
    pairs = (
        "SELECT a.outer_fold, a.feature AS feature_i, b.feature AS feature_j, {r} AS r"
        " FROM split_cells a JOIN split_cells b ON a.outer_fold = b.outer_fold AND a.sample_id = b.sample_id"
        " AND a.feature_ord < b.feature_ord WHERE a.role = 'train' AND b.role = 'train' {more} GROUP BY 1, 2, 3"
    )
    r = q6("corr(a.value, b.value)")
    return {
        "scan_labelled_cells": f"WITH {ORDER_CELLS} SELECT sample_id, label, feature, value FROM cells",
        "scan_vector_cells": f"WITH {CELLS} SELECT sample_id, label, feature, value FROM cells",
        "feature_catalog": f"WITH {ORDER_CELLS} SELECT feature, feature_ord, count(value) AS n_values FROM cells"
        " WHERE feature_ord < 7 GROUP BY 1, 2",
        "null_report": f"WITH {ORDER_CELLS} SELECT feature, count(*) AS n_cells,"
        " count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n_missing FROM cells GROUP BY 1",
        "limit_features": f"WITH {CELLS} SELECT sample_id, feature, value FROM cells WHERE feature_ord < 32",
        "drop_separating_features": f"WITH {CELLS}, more AS (SELECT sample_id, label, feature, value FROM cells"
        " UNION ALL SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 2 END, 'f_64', CAST(label AS DOUBLE) FROM embeddings),"
        " bad AS (SELECT feature FROM more GROUP BY 1 HAVING"
        " min(value) FILTER (WHERE label <> 1) > max(value) FILTER (WHERE label = 1)"
        " OR min(value) FILTER (WHERE label = 1) > max(value) FILTER (WHERE label <> 1))"
        f" SELECT sample_id, feature, {q6('value')} AS value FROM more WHERE feature NOT IN (SELECT feature FROM bad)",
        "uncorrelated_features": f"WITH {SPLIT_CELLS}, pairs AS ("
        + pairs.format(r="corr(a.value, b.value)", more="")
        + "), weak AS (SELECT * FROM pairs WHERE abs(r) <= 0.05)"
        " SELECT outer_fold, feature_i AS target, feature_j AS feature FROM weak"
        " UNION ALL SELECT outer_fold, feature_j, feature_i FROM weak",
        "stratified_folds": "SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label"
        f" ORDER BY md5('42|' || CAST(sample_id AS VARCHAR))) - 1) % {K} AS INTEGER) AS outer_fold"
        " FROM (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS label FROM orders)",
        "nested_folds": f"WITH {NESTED} SELECT sample_id, outer_fold, inner_fold, role FROM nested",
        "check_splits": f"WITH {NESTED} SELECT outer_fold, inner_fold, count(*) FILTER (WHERE role = 'train') AS n_train,"
        " count(*) FILTER (WHERE role = 'valid') AS n_valid,"
        " count(*) FILTER (WHERE role = 'train') > count(*) FILTER (WHERE role = 'valid') AS train_larger,"
        " count(DISTINCT label) FILTER (WHERE role = 'train') = 2 AS both_classes FROM nested GROUP BY 1, 2",
        "yeojohnson_lambda": f"WITH RECURSIVE {LAMBDAS} SELECT outer_fold, feature, lam AS lambda, 'optimum' AS status FROM lambdas",
        "yeojohnson_grid": f"WITH {SPLIT_CELLS}, powered AS (SELECT outer_fold, feature, lam, {_yj('value', 'lam')} AS t"
        " FROM split_cells, (SELECT (-3.0::DOUBLE * (6 - i) + 3.0::DOUBLE * i) / 6 AS lam FROM range(7) g(i))"
        " WHERE role = 'train'), skews AS (SELECT outer_fold, feature, lam, abs(skewness(t)) AS s FROM powered GROUP BY 1, 2, 3)"
        f" SELECT outer_fold, feature, {q6('lam')} AS lambda FROM (SELECT *, row_number() OVER"
        " (PARTITION BY outer_fold, feature ORDER BY s, lam) AS place FROM skews) WHERE place = 1",
        "reuse_splits": f"WITH RECURSIVE {LAMBDAS} SELECT outer_fold, feature, lam AS lambda FROM lambdas",
        "yeojohnson_apply": f"WITH RECURSIVE {LAMBDAS} SELECT outer_fold, role, sample_id, feature,"
        f" {q6(_yj('value', 'lam'))} AS value FROM split_cells JOIN lambdas USING (outer_fold, feature)",
        "standardize": f"WITH {SPLIT_CELLS}, moments AS (SELECT outer_fold, feature, avg(value) AS m, stddev_pop(value) AS s"
        " FROM split_cells WHERE role = 'train' GROUP BY 1, 2) SELECT outer_fold, role, sample_id, feature,"
        f" {q6('(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END')} AS value FROM split_cells JOIN moments USING (outer_fold, feature)",
        "corr_pearson": f"WITH {SPLIT_CELLS} " + pairs.format(r=r, more=""),
        "corr_spearman": f"WITH {CELLS}, ranked AS (SELECT sample_id, feature, feature_ord, rank() OVER"
        " (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM cells)"
        f" SELECT a.feature AS feature_i, b.feature AS feature_j, {r} AS r FROM ranked a JOIN ranked b"
        " ON a.sample_id = b.sample_id AND a.feature_ord < b.feature_ord GROUP BY 1, 2",
    }
