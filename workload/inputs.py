"""The driver's tables in the shapes the operators read.

All sums are over whole numbers (cents, percent points), so that they come out
the same in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featwright.functions.expressions import millionths
from featwright.functions.ranks import strict_positions
from featwright.operators.scores import minmax_scores
from featwright.plans.ensemble import cv_aggregate
from featwright.storage import stage

LINE_FOLDS = range(1, 8)  # l_linenumber


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def percent(column: str) -> Column:
    return F.floor(F.col(column) * 100 + 0.5).cast("bigint")


def feature_name(key: str = "l_partkey") -> Column:
    prefix = F.when(F.col(key) % 7 == 0, "bm_").otherwise("p_")
    return F.concat(prefix, F.col(key).cast("string"))


MEASURES = ("sum_quantity", "avg_price", "avg_discount", "line_count", "max_tax")


def unscaled_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five measures of every part in every line number; 0 where the part has no such line.

    The pivot puts all line numbers of a part side by side, so that filling the
    empty ones needs no join; the way back to long rows is a projection.
    """

    def mean(value: Column) -> Column:
        return F.sum(value) / F.count(F.lit(1))

    wide = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .pivot("l_linenumber", list(LINE_FOLDS))
        .agg(
            F.sum("l_quantity").alias("sum_quantity"),
            mean(percent("l_extendedprice")).alias("avg_price"),
            mean(percent("l_discount")).alias("avg_discount"),
            F.count(F.lit(1)).cast("double").alias("line_count"),
            F.max("l_tax").alias("max_tax"),
        )
    )
    rows = [
        F.struct(
            F.lit(name).alias("method"),
            F.lit(fold - 1).alias("outer_fold"),
            F.coalesce(F.col(f"{fold}_{name}"), F.lit(0.0)).alias("score"),
        )
        for fold in LINE_FOLDS
        for name in MEASURES
    ]
    return wide.select(
        feature_name().alias("feature"), F.col("l_partkey").alias("feature_ord"), F.inline(F.array(*rows))
    )


def line_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_scores(stage(unscaled_line_scores(spark, sf_dir)), ["method", "outer_fold"])


def line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One election over all parts, scores in integer millionths; stored."""
    votes = cv_aggregate(line_fold_scores(spark, sf_dir))
    return stage(votes.select(F.lit("all").alias("election_id"), "feature", "method", millionths(F.col("score")).alias("score")))


def brand_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One election per brand, scores in integer millionths; stored."""
    brands = table(spark, sf_dir, "part").select(
        feature_name("p_partkey").alias("feature"), F.col("p_partkey").alias("feature_ord"), F.col("p_brand").alias("election_id")
    )
    votes = cv_aggregate(line_fold_scores(spark, sf_dir)).join(brands, "feature")
    return stage(votes.select("election_id", "feature", "feature_ord", "method", millionths(F.col("score")).alias("score")))


def ballots(votes: DataFrame) -> DataFrame:
    """Strict positions of every voter, best first; stored."""
    return stage(
        strict_positions(votes, ["election_id", "method"], "score", "feature_ord").drop("score")
    )


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw importances: return flag = method, line number = outer fold, supplier = inner fold."""
    lines = table(spark, sf_dir, "lineitem").select(
        (1 + F.col("l_partkey") % 2).alias("experiment_id"),
        F.concat(F.lit("m_"), "l_returnflag").alias("method"),
        (F.col("l_linenumber") - 1).alias("outer_fold"),
        (F.col("l_suppkey") % 3).cast("int").alias("inner_fold"),
        feature_name().alias("feature"),
        (F.col("l_quantity").cast("bigint") - 25).alias("quantity"),
        (percent("l_discount") - 5).alias("discount"),
        (percent("l_tax") - 4).alias("tax"),
    )
    keys = ["experiment_id", "method", "outer_fold"]
    per_inner = lines.groupBy(*keys, "inner_fold", "feature").agg(
        (F.sum("quantity") / 64.0).alias("macro"),
        (F.sum("discount") / 64.0).alias("micro_part"),
        (F.sum("tax") / 64.0).alias("shap"),
    )
    kinds = per_inner.select(
        *keys,
        "inner_fold",
        "feature",
        F.inline(
            F.array(
                F.struct(F.lit("macro").alias("kind"), F.col("macro").alias("value")),
                F.struct(F.lit("shap").alias("kind"), F.col("shap").alias("value")),
            )
        ),
    ).where(~((F.col("kind") == "shap") & (F.col("method") == "m_R")))
    micro = per_inner.groupBy(*keys, "feature").agg(F.sum("micro_part").alias("value")).select(
        *keys, F.lit(None).cast("int").alias("inner_fold"), "feature", F.lit("micro").alias("kind"), "value"
    )
    return kinds.unionByName(micro).select(*keys, "inner_fold", "kind", "feature", "value")


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation metric and best parameters of every run: mean discount, mean tax and largest quantity of its lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (1 + F.col("l_partkey") % 2).alias("experiment_id"),
            F.concat(F.lit("m_"), "l_returnflag").alias("method"),
            (F.col("l_linenumber") - 1).alias("outer_fold"),
        )
        .agg(
            (F.sum(percent("l_discount")) / F.count("*")).alias("validation_metric"),
            F.create_map(
                F.lit("alpha"), F.sum(percent("l_tax")) / F.count("*"), F.lit("depth"), F.max("l_quantity").cast("double")
            ).alias("best_params"),
        )
    )


def raw_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse results: line status = method, discount and tax = the two qualities."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (1 + F.col("l_partkey") % 2).alias("experiment_id"),
            F.concat(F.lit("Reverse_"), "l_linestatus").alias("method"),
            (F.col("l_linenumber") - 1).alias("outer_fold"),
            feature_name().alias("feature"),
        )
        .agg(
            (F.sum(percent("l_discount")) / 1024.0).alias("unlabeled"),
            (F.sum(percent("l_tax")) / 1024.0).alias("labeled"),
        )
    )


# ---- labelled tables ---------------------------------------------------------


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row vectors of 64 features; labels 1 and 2."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.when(F.col("label") < 5, 1).otherwise(2).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


ORDER_FEATURES = (
    "total_price",
    "sum_quantity",
    "avg_quantity",
    "sum_price",
    "avg_price",
    "sum_discount",
    "avg_discount",
    "sum_tax",
    "avg_tax",
)


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per order; NULL where the order has no lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[
            expression
            for name, value in (
                ("quantity", F.col("l_quantity").cast("bigint")),
                ("price", percent("l_extendedprice")),
                ("discount", percent("l_discount")),
                ("tax", percent("l_tax")),
            )
            for expression in (
                F.sum(value).cast("double").alias(f"sum_{name}"),
                (F.sum(value) / F.count(F.lit(1))).alias(f"avg_{name}"),
            )
        ]
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("sample_id"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("label"),
            percent("o_totalprice").cast("double").alias("total_price"),
            *[F.col(c) for c in ORDER_FEATURES[1:]],
        )
    )


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("label"),
    )


# ---- meters, trials, predictions ----------------------------------------------


def power_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as power samples of five nodes; error events are failed polls."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string")).alias("node_id"),
        F.when(F.col("event_type").isin("click", "view"), "preprocessing")
        .otherwise("feature_selection")
        .alias("workflow_element"),
        F.col("value").alias("total_w"),
        (F.col("value") / 2).alias("cpu_w"),
        (F.col("value") / 4).alias("peg_w"),
        (F.col("event_type") != "error").alias("ok"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time marks of workflow elements."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("experiment_id"),
        F.col("event_type").alias("element"),
        F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string")).alias("node_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment per customer with orders; the ids have gaps."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("experiment_id"))
        .agg(
            F.min("o_orderdate").cast("timestamp").alias("created"),
            F.create_map(F.lit("orders"), F.count("*").cast("string")).alias("settings"),
        )
    )


def fold_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 30 trials in 5 inner folds of 6 outer folds of every order priority."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("method"),
            (F.col("o_custkey") % 6).cast("int").alias("outer_fold"),
            (F.col("o_orderkey") % 30).cast("int").alias("trial_id"),
            (F.floor(F.col("o_orderkey") / 30) % 5).cast("int").alias("inner_fold"),
        )
        .agg((F.sum(percent("o_totalprice")) / F.count("*")).alias("score"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of a target: line price against what quantity says of it."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("outer_fold"),
        F.col("l_returnflag").alias("target"),
        (F.col("l_suppkey") % 10).cast("int").alias("trial_id"),
        (F.col("l_orderkey") % 3).cast("int").alias("inner_fold"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 1.5).alias("prediction"),
        (F.col("l_quantity").cast("bigint") - 25).alias("_label_part"),
    )


DOCUMENT_FEATURES = (
    "n_chars",
    "n_words",
    "n_lines",
    "n_digits",
    "n_upper",
    "n_punctuation",
    "n_letters",
    "word_length",
    "words_per_line",
    "upper_share",
    "digit_share",
    "punctuation_share",
)


#: Signs that are counted in texts, all of them single bytes of UTF-8.
COUNTED = {
    "n_digits": b"0123456789",
    "n_upper": bytes(range(65, 91)),
    "n_punctuation": b".,;:!?",
    "n_letters": bytes([*range(65, 91), *range(97, 123)]),
    "n_breaks": b"\n",
}
#: Text bytes that are counted at once, so that the steps meet in a processor's cache.
COUNT_BYTES = 250_000


def _total(mark: np.ndarray, begins: np.ndarray) -> np.ndarray:
    before = np.zeros(len(mark) + 1, np.int32)  # a string column holds less than 2**31 bytes
    np.cumsum(mark, dtype=np.int32, out=before[1:])
    return np.diff(before[begins])


def _counts(data: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Words and signs of every text; text k has the bytes from ``begins[k]`` to ``begins[k + 1]``."""
    space = (data == 32) | (data - np.uint8(9) < 5)
    first = ~space
    first[1:] &= space[:-1]
    at = begins[:-1][begins[:-1] < len(data)]
    first[at] = ~space[at]
    kinds = np.zeros(256, np.uint8)
    for k, signs in enumerate(COUNTED.values()):
        kinds[list(signs)] |= 1 << k
    kind = kinds[data]
    marks = [first, *(kind & np.uint8(1 << k) != 0 for k in range(len(COUNTED)))]
    return [_total(mark, begins) for mark in marks]


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in ("n_words", *COUNTED)]))
def text_counts(texts: pa.Array) -> pa.Array:
    """How many words (without ASCII white space) and signs each text has; NULL has none known."""
    filled = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, 8 * filled.offset)
    data = np.frombuffer(filled.buffers()[2], np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
    parts, start = [], 0
    while start < len(filled):  # one text at least
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNT_BYTES, side="right")) - 1)
        parts.append(_counts(data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]))
        start = stop
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    columns = [pa.array(np.concatenate(found).astype(np.float64), mask=missing) for found in zip(*parts)]
    return pa.StructArray.from_arrays(columns or [pa.array([], pa.float64())] * (1 + len(COUNTED)), ["n_words", *COUNTED])


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as vectors of text measures over the whole text; labels 1 and 2."""
    counted = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), text_counts("text").alias("_c"))
    measured = counted.select(
        "doc_id",
        "n_chars",
        "_c.n_words",
        (F.col("_c.n_breaks") + 1).alias("n_lines"),
        "_c.n_digits",
        "_c.n_upper",
        "_c.n_punctuation",
        "_c.n_letters",
    )
    chars, words = F.greatest("n_chars", F.lit(1.0)), F.greatest("n_words", F.lit(1.0))
    features = measured.select(
        "doc_id",
        "n_chars",
        "n_words",
        "n_lines",
        "n_digits",
        "n_upper",
        "n_punctuation",
        "n_letters",
        (F.col("n_chars") / words).alias("word_length"),
        (F.col("n_words") / F.col("n_lines")).alias("words_per_line"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_punctuation") / chars).alias("punctuation_share"),
    )
    return features.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        (F.col("quality") + 1).alias("label"),
        F.array(*DOCUMENT_FEATURES).alias("features"),
    )
