import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featwright.functions import ranks
from featwright.operators.aggregate import AGGREGATORS, aggregate_votes


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(
        {
            "g": rng.choice(["a", "b"], 400, p=[0.9, 0.1]),
            "i": range(400),
            # ties, a value held by a third of the rows, signs, very large and small sizes
            "x": np.where(rng.random(400) < 0.33, 0.0, rng.choice([-3.5, -1e-9, 1e-300, 0.5, 0.5001, 2, 1e12], 400)),
        }
    )
    return frame, spark.createDataFrame(frame)


def test_ranks_equal_pandas(values):
    frame, df = values
    got = (
        ranks.with_ranks(df, ["g"], "x")
        .select("i", ranks.average_ascending().alias("asc"), ranks.average_descending().alias("desc"), ranks.lowest_descending().alias("low"))
        .toPandas()
        .set_index("i")
        .sort_index()
    )
    by = frame.set_index("i").groupby("g").x
    assert (got["asc"] == by.rank()).all()
    assert (got["desc"] == by.rank(ascending=False)).all()
    assert (got["low"] == by.rank(ascending=False, method="min")).all()


def test_strict_positions(values):
    frame, df = values
    got = ranks.strict_positions(df, ["g"], "x", "i").toPandas()
    want = frame.sort_values(["x", "i"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (got.set_index("i").rk.sort_index() == want.sort_index()).all()


def test_missing_values_come_last(spark):
    rows = [("m1", 0, 0.9), ("m1", 1, None), ("m1", 2, 0.4), ("m1", 3, float("nan")), ("m2", 0, None), ("m2", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {(r.g, r.i): r.rk for r in ranks.strict_positions(df, ["g"], "x", "i").collect()}
    assert got == {("m1", 0): 1, ("m1", 2): 2, ("m1", 1): 3, ("m1", 3): 4, ("m2", 0): 1, ("m2", 1): 2}


def test_null_values_get_no_rank(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0)], "g string, i int, x double")
    got = {r.i: r.r for r in ranks.with_ranks(df, ["g"], "x").select("i", ranks.average_ascending().alias("r")).collect()}
    assert got == {1: 2.0, 2: None, 3: 1.0}
    directed = ranks.with_ranks(df, ["g"], "x").where("i = 3").select(ranks.directed(5).alias("r")).first().r
    assert directed == 1.0  # a missing value means "not all are scores": ascending


def _pandas(data: pd.DataFrame, name: str, top_n: int, acc: pd.Series) -> pd.Series:
    ranked = data.rank(ascending=False)
    n = data.shape[1]
    base = name.removesuffix("Ranked")
    value = {
        "Sum": lambda: data.sum(axis=1),
        "ArithmeticMean": lambda: data.mean(axis=1),
        "GeometricMean": lambda: np.exp(np.log(data.where(data.min(axis=1) > 0)).mean(axis=1)),
        "Median": lambda: data.median(axis=1),
        "Count": lambda: data.ne(0).sum(axis=1),
        "Min": lambda: data.min(axis=1),
        "Max": lambda: data.max(axis=1),
        "WeightedAveraging": lambda: (data * (acc / acc.sum())).sum(axis=1) / n,
        "BordaCount": lambda: ranked.sum(axis=1),
        "ReciprocalRanking": lambda: 1 / (1 / ranked).sum(axis=1),
        "FeatureOccurrenceFrequency": lambda: data.apply(lambda c: c.isin(c.nlargest(top_n))).sum(axis=1),
    }[base]()
    if name == base:
        return value
    value = value.round(9)
    if base in ("Sum", "Count", "WeightedAveraging", "FeatureOccurrenceFrequency"):
        return value.rank(ascending=False)
    if base in ("GeometricMean", "BordaCount", "ReciprocalRanking"):
        return value.rank()
    return value.rank(ascending=not value.le(1).all())


def _tables():
    rng = np.random.default_rng(7)
    index = [f"f{i}" for i in range(12)]
    scores = pd.DataFrame(rng.choice([0, 0, 0.25, 0.5, 1], (12, 5)), index=index, columns=list("abcde"))
    scores["e"] = 0.0  # fewer non-zeros than n: every feature is among the top
    positive = pd.DataFrame(rng.integers(1, 9, (12, 4)).astype(float), index=index, columns=list("abcd"))
    return {"scores": scores, "ranks": positive}


@pytest.mark.parametrize("table", ["scores", "ranks"])
def test_aggregators_equal_pandas(spark, table):
    data = _tables()[table]
    acc = pd.Series({m: 0.5 + i / 10 for i, m in enumerate(data.columns)})
    votes = data.rename_axis("feature").reset_index().melt("feature", var_name="method", value_name="score")
    both = pd.concat([votes.assign(election_id="one"), votes.assign(election_id="two")])
    weights = spark.createDataFrame(list(acc.items()), "method string, acc double")
    got = aggregate_votes(
        spark.createDataFrame(both).select("election_id", "feature", "method", "score"),
        AGGREGATORS,
        top_n=3,
        method_weights=weights,
        decimals=9,
    ).toPandas()
    assert len(got) == 24
    for election in ("one", "two"):
        one = got[got.election_id == election].set_index("feature").sort_index()
        for name in AGGREGATORS:
            want = _pandas(data, name, 3, acc).sort_index()
            np.testing.assert_allclose(one[name].astype(float), want.astype(float), atol=1e-6, err_msg=name)


def test_average_ranks_add_up(spark):
    votes = spark.range(50).select(
        F.lit("e").alias("election_id"), F.col("id").cast("string").alias("feature"), F.lit("m").alias("method"), (F.col("id") % 4).alias("score")
    )
    got = aggregate_votes(votes, ["SumRanked", "BordaCount"], unit=3)
    assert got.agg(F.sum("SumRanked")).first()[0] == 50 * 51 / 2


def test_plans_stay_in_the_jvm_and_partitioned(spark):
    votes = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("election_id"),
        F.col("id").cast("string").alias("feature"),
        F.lit("m").alias("method"),
        (F.col("id") % 4).alias("score"),
    )
    jvm = [a for a in AGGREGATORS if not a.startswith(("Weighted", "Geometric", "Reciprocal"))]
    plan = aggregate_votes(votes, jvm, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


def test_strict_positions_of_a_group_in_many_tasks(spark):
    """One sort by range for all groups, cut anywhere; equal rows share a place, rows without group or tie leave a gap."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 30_000, p=[0.8, 0.15, 0.05]), "i": rng.permutation(30_000), "x": rng.integers(0, 4, 30_000)})
    got = ranks.strict_positions(spark.createDataFrame(frame).repartition(6), ["g"], "x", "i")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5  # the rows are stored in order; only counts of the tasks' parts are shuffled
    want = frame.sort_values(["x", "i"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (got.toPandas().set_index("i").rk.sort_index() == want.rename(index=frame.i).sort_index()).all()
    odd = [("g", 1, 0.0, "u"), ("g", 1, -0.0, "v"), ("g", None, 2.0, "w"), ("g", 2, 0.0, "x"), (None, 3, 1.0, "y"), ("g", 4, float("nan"), "z")]
    odd = ranks.strict_positions(spark.createDataFrame(odd, "g string, i bigint, x double, name string"), ["g"], "x", "i")
    assert sorted((r.name, r.rk) for r in odd.collect()) == [("u", 2), ("v", 2), ("x", 4), ("z", 5)]
