"""Hyper-parameter trials as a table: drawing, pruning, choosing."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: the search spaces --------------------------------------
# name -> (low, high, kind); "half" is half the number of samples
SPACES: dict[str, dict[str, tuple]] = {
    "lasso": {"alpha": (0.01, 1.0, "log")},
    "svc": {"C": (1.0, 10.0, "float")},
    "forest": {"max_depth": (2, 6, "int"), "min_samples_leaf": (2, "half", "int")},
    "boosting": {
        "min_data_in_leaf": (2, "half", "int"),
        "lambda_l1": (0.0, 3.0, "float"),
        "min_gain_to_split": (0.0, 5.0, "float"),
        "max_depth": (2, 6, "int"),
        "bagging_fraction": (0.1, 1.0, "float"),
        "bagging_freq": (1, 10, "int"),
        "num_iterations": (1, 100, "int"),
        "num_leaves": (2, "leaves", "int"),
    },
}
MAX_LEAVES = 90


def draw_trials(space: str, n_trials: int, number_of_samples: int, seed: int = 42) -> list[dict[str, float]]:
    """Seeded random draws from a search space, one dict per trial."""
    rng = random.Random(seed)
    draws: list[dict[str, float]] = []
    for _ in range(n_trials):
        trial: dict[str, float] = {}
        for name, (low, high, kind) in SPACES[space].items():
            if high == "half":
                high = max(low, number_of_samples // 2)
            elif high == "leaves":
                high = min(MAX_LEAVES, 2 ** int(trial["max_depth"]) - 1)
            if kind == "int":
                trial[name] = rng.randint(low, high)
            elif kind == "log":
                trial[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                trial[name] = rng.uniform(low, high)
        draws.append(trial)
    return draws


def best_trial(trials: DataFrame, keys: Sequence[str], maximize: bool = True) -> DataFrame:
    """The best trial per key; the lowest ``trial_id`` among equals. All columns are kept."""
    sign = 1 if maximize else -1
    rest = [c for c in trials.columns if c not in keys]
    scored = trials.where(F.col("score").isNotNull() & ~F.isnan("score"))
    order = F.struct(F.col("score") * sign, -F.col("trial_id"))
    chosen = scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return chosen.select(*keys, "_best.*")


def trial_scores(fold_trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score of a trial over its inner folds."""
    return fold_trials.groupBy(*keys, "trial_id").agg(F.avg("score").alias("score"))


def drop_empty_trials(trials: DataFrame, importances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials that give some feature a non-zero importance in every inner fold they report."""
    per_fold = importances.groupBy(*keys, "trial_id", "inner_fold").agg(F.sum(F.abs("value")).alias("_size"))
    empty = per_fold.where("_size = 0").select(*keys, "trial_id").distinct()
    return trials.join(empty, [*keys, "trial_id"], "left_anti")


def prune_trials(
    fold_trials: DataFrame, keys: Sequence[str], maximize: bool = True, keep: float = 0.25
) -> DataFrame:
    """Trials whose running mean is in the best ``keep`` share of their step, at every step they report.

    One window holds the trials of one step; their number is set by the search, not by the data.
    """
    steps = Window.partitionBy(*keys, "trial_id").orderBy("inner_fold")
    running = fold_trials.withColumn("running_mean", F.avg("score").over(steps))
    order = F.col("running_mean").desc() if maximize else F.col("running_mean").asc()
    place = F.percent_rank().over(Window.partitionBy(*keys, "inner_fold").orderBy(order))
    return (
        running.withColumn("_place", place)
        .groupBy(*keys, "trial_id")
        .agg(F.max("_place").alias("_worst"), F.avg("score").alias("score"))
        .where(F.col("_worst") <= keep)
        .drop("_worst")
    )
