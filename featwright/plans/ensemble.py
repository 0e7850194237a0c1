"""Aggregation run: fold scores → one vote per (feature, method) → ensemble table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featwright.operators.aggregate import aggregate_votes
from featwright.operators.scores import minmax_scores
from featwright.settings import Settings
from featwright.storage import stage


def cv_aggregate(
    fold_scores: DataFrame, aggregator: str = "ArithmeticMean", methods: Sequence[str] | None = None
) -> DataFrame:
    """Aggregate each method over its outer folds, then scale to [0, 1] over the features.

    Any aggregator works: the method takes the part of the election, the outer
    folds are the voters.
    """
    if methods is not None:
        fold_scores = fold_scores.where(F.col("method").isin(list(methods)))
    as_votes = fold_scores.select(
        F.col("method").alias("election_id"),
        "feature",
        F.col("outer_fold").cast("string").alias("method"),
        "score",
    )
    per_method = stage(aggregate_votes(as_votes, [aggregator]))
    return minmax_scores(
        per_method.select(F.col("election_id").alias("method"), "feature", F.col(aggregator).alias("score")),
        ["method"],
    )


def as_votes(scores: DataFrame, election_id: str = "all") -> DataFrame:
    """The scores of all methods as the votes of one election."""
    return scores.select(F.lit(election_id).alias("election_id"), "feature", "method", "score")


def ensemble_aggregate(
    fold_scores: DataFrame, settings: Settings = Settings(), methods: Sequence[str] | None = None
) -> DataFrame:
    """The ensemble table, one row per (cross-validation aggregator, feature)."""
    tables = []
    for name in settings.cv_aggregators:
        votes = stage(as_votes(cv_aggregate(fold_scores, name, methods), name))
        tables.append(
            aggregate_votes(votes, settings.ensemble_aggregators, top_n=settings.top_n, stored=True)
        )
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result.withColumnRenamed("election_id", "cv_aggregator")
