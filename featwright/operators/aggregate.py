"""Aggregators over voters: many scores per feature become one.

Input is ``votes(election_id, feature, method, score)``. Every measure of a
feature is one expression of a single ``groupBy``; the ranked variants stack
the measures of all requested aggregators and rank them in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featwright.functions.expressions import clean, rounded
from featwright.functions.ranks import (
    average_ascending,
    average_descending,
    directed,
    lowest_descending,
    value_ranks,
    with_ranks,
)
from featwright.storage import stage

_FEATURE = ["election_id", "feature"]


@dataclass(frozen=True)
class Measure:
    """One aggregator: how a feature's votes fold, and how its ranked form is directed."""

    fold: str
    ranked: str
    from_ranks: bool = False
    exact: bool = True  # the fold of integer scores has no rounding


# The ranked form of an aggregator carries the suffix "Ranked".
MEASURES: dict[str, Measure] = {
    "Sum": Measure("sum", "desc"),
    "ArithmeticMean": Measure("mean", "by_values"),
    "GeometricMean": Measure("geomean", "asc", exact=False),
    "Median": Measure("median", "by_values"),
    "Count": Measure("count", "desc"),
    "Min": Measure("min", "by_values"),
    "Max": Measure("max", "by_values"),
    "WeightedAveraging": Measure("weighted", "desc", exact=False),
    "BordaCount": Measure("borda", "asc", from_ranks=True),
    "ReciprocalRanking": Measure("reciprocal", "asc", from_ranks=True, exact=False),
    "FeatureOccurrenceFrequency": Measure("topn", "desc", from_ranks=True),
}
AGGREGATORS: tuple[str, ...] = tuple(name + suffix for name in MEASURES for suffix in ("", "Ranked"))


def _fold(kind: str, top_n: int) -> Column:
    score = F.col("score")
    if kind == "sum":
        return F.coalesce(F.sum(score), F.lit(0)).cast("double")
    if kind == "mean":
        return F.avg(score)
    if kind == "geomean":
        # defined for positive scores only
        return F.when(F.min(score) > 0, F.exp(F.avg(F.ln(score))))
    if kind == "median":
        return F.median(score)
    if kind == "count":
        return F.count_if(score != 0).cast("double")
    if kind == "min":
        return F.min(score).cast("double")
    if kind == "max":
        return F.max(score).cast("double")
    if kind == "weighted":
        # the weights already sum to 1; the mean over the voters comes on top
        return F.sum(score * F.col("_weight")) / F.count("*")
    if kind == "borda":
        return F.sum(average_descending())
    if kind == "reciprocal":
        return 1.0 / F.sum(1.0 / average_descending())
    if kind == "topn":
        return F.count_if(lowest_descending() <= top_n).cast("double")
    raise ValueError(kind)


def _direction(name: str, unit: float) -> Column:
    ranked = MEASURES[name].ranked
    if ranked == "desc":
        return average_descending()
    if ranked == "asc":
        return average_ascending()
    return directed(unit)


def method_shares(method_weights: DataFrame) -> DataFrame:
    """``acc`` of each method as a share of the sum of all."""
    total = method_weights.agg(F.sum("acc")).scalar()
    return method_weights.select("method", (F.col("acc") / total).alias("_weight"))


def _measures(votes: DataFrame, bases: Sequence[str], top_n: int, weights: DataFrame | None) -> DataFrame:
    if any(MEASURES[b].from_ranks for b in bases):
        votes = with_ranks(votes, ["election_id", "method"], "score")
    if "WeightedAveraging" in bases:
        if weights is None:
            raise ValueError("WeightedAveraging needs method_weights(method, acc)")
        votes = votes.join(stage(method_shares(weights)), "method")
    return votes.groupBy(*_FEATURE).agg(*[_fold(MEASURES[b].fold, top_n).alias(b) for b in bases])


def aggregate_votes(
    votes: DataFrame,
    names: Sequence[str],
    *,
    top_n: int = 20,
    unit: float = 1,
    method_weights: DataFrame | None = None,
    decimals: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """One column per aggregator in ``names``: ``(election_id, feature, <name>…)``.

    ``unit`` is the largest value a score can take; above it values count as
    ranks (1 = best). ``decimals`` rounds the measures that are sums of fractions,
    so that two features tie even if their votes were added in another order.
    Pass ``stored=True`` when ``votes`` is a stored table;
    otherwise it is staged before it is ranked.
    """
    unknown = [n for n in names if n not in AGGREGATORS]
    if unknown:
        raise ValueError(f"no such aggregator: {unknown}")
    bases = list(dict.fromkeys(n.removesuffix("Ranked") for n in names))
    to_rank = [n.removesuffix("Ranked") for n in names if n.endswith("Ranked")]

    integral = isinstance(votes.schema["score"].dataType, (T.LongType, T.IntegerType))
    if not integral:
        votes = votes.withColumn("score", clean(F.col("score")))
    if not stored and (to_rank or any(MEASURES[b].from_ranks for b in bases)):
        votes = stage(votes)
    measured = _measures(votes, bases, top_n, method_weights)
    if decimals is not None:
        inexact = [b for b in bases if not (integral and MEASURES[b].exact)]
        measured = measured.withColumns({b: rounded(F.col(b), decimals) for b in inexact})
    if not to_rank:
        return measured.select(*_FEATURE, *names)

    # the ranks read the measures three times
    return _add_ranks(stage(measured), bases, to_rank, unit).select(*_FEATURE, *names)


def _add_ranks(measured: DataFrame, bases: list[str], to_rank: list[str], unit: float) -> DataFrame:
    stacked = measured.select(
        *_FEATURE,
        F.inline(
            F.array(*[F.struct(F.lit(b).alias("_name"), F.col(b).alias("_value")) for b in bases])
        ),
    )
    ranked_only = stacked.where(F.col("_name").isin(to_rank))
    group = ["election_id", "_name"]
    ranks = value_ranks(ranked_only, group, "_value")
    rank = F.lit(None).cast("double")
    for base in to_rank:
        rank = F.when(F.col("_name") == base, _direction(base, unit)).otherwise(rank)
    joined = stacked.join(ranks, [*group, "_value"], "left").withColumn("_rank", rank)

    def pick(column: str, base: str) -> Column:
        return F.max(F.when(F.col("_name") == base, F.col(column)))

    return joined.groupBy(*_FEATURE).agg(
        *[pick("_value", b).alias(b) for b in bases],
        *[pick("_rank", b).alias(b + "Ranked") for b in to_rank],
    )
