"""Yeo-Johnson transform and standardisation, fitted on the train part of each split.

Moments are computed once per (fold, feature) on disjoint folds; the train part
of a split is all folds but one, so its moments are merged from those. A cell is
read once, not once per split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featwright.functions.expressions import yeo_johnson
from featwright.functions.joins import join_null_safe
from featwright.settings import Settings
from featwright.storage import stage


def lambda_grid(start: float, end: float, points: int) -> list[float]:
    steps = points - 1
    return [(start * (steps - i) + end * i) / steps for i in range(points)]


def held_out_moments(
    df: DataFrame, group: Sequence[str], fold: str, value: str, extra: str | None = None
) -> DataFrame:
    """For every fold, ``n``, ``mean`` and ``var`` (population) of ``value`` over the other folds.

    ``extra`` names a column whose sum over the other folds is added as ``extra``.
    """
    group = list(group)
    per_fold = df.groupBy(*group, fold).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        (F.sum(extra) if extra else F.lit(0.0)).alias("extra"),
    )
    # at most one row per fold and group
    parts = per_fold.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(fold, "n", "mean", "var", "extra"))).alias("_parts")
    )
    one = parts.select(*group, "_parts", F.explode("_parts").alias("_own")).select(
        *group,
        F.col(f"_own.{fold}").alias(fold),
        F.filter("_parts", lambda p: p[fold] != F.col(f"_own.{fold}")).alias("_rest"),
    )

    def total(term) -> Column:
        return F.aggregate("_rest", F.lit(0.0), lambda acc, p: acc + term(p))

    n = one.withColumn("n", total(lambda p: p["n"])).withColumn(
        "mean", total(lambda p: p["n"] * p["mean"]) / F.nullif("n", F.lit(0.0))
    )
    return n.select(
        *group,
        fold,
        "n",
        "mean",
        (
            total(lambda p: p["n"] * (p["var"] + (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))))
            / F.nullif("n", F.lit(0.0))
        ).alias("var"),
        total(lambda p: p["extra"]).alias("extra"),
    )


#: First exponents looked at, even around 1 (no change).
START = (-7.0, -3.0, -1.0, 0.0, 1.0, 2.0, 3.0, 5.0, 9.0)
#: Beyond this size an exponent counts as without bound.
FARTHEST = 1e7


def _with_slope_terms(cells: DataFrame) -> DataFrame:
    """``_t`` and ``_dt``: the transform of ``value`` and its derivative by ``lambda``, both steady near their removable gaps.

    Step by step, so that logarithm and exponential are taken once a cell.
    """
    mirrored = F.col("value") < 0
    df = cells.withColumn("_size", F.log1p(F.abs("value")))
    df = df.withColumn("_power", F.when(mirrored, 2.0 - F.col("lambda")).otherwise(F.col("lambda")))
    size, power = F.col("_size"), F.col("_power")
    df = df.withColumn("_grown", F.expm1(power * size))
    df = df.withColumn("_h", F.when(power == 0.0, size).otherwise(F.col("_grown") / power))
    step = power * size
    series = size * size * (0.5 + step / 3 + step * step / 8)
    slope = F.when(F.abs(step) < 1e-3, series).otherwise((size * (F.col("_grown") + 1.0) - F.col("_h")) / power)
    # behind zero the power falls as the exponent grows, and the value is negative: the slope keeps its sign
    return df.withColumn("_t", F.when(mirrored, -F.col("_h")).otherwise(F.col("_h"))).withColumn("_dt", slope)


def _slopes(cells: DataFrame, wanted: DataFrame, group: list[str], fold: str) -> DataFrame:
    """For points ``(group…, fold, feature, lambda)``: ``n``, ``mean``, ``var`` after the transform, and ``slope``.

    ``slope`` is the derivative of the log-likelihood over the other folds, per value; infinite, towards 1, where
    doubles cannot hold the transform or tell its values apart. A cell is transformed once for each different exponent of its feature.
    """
    of = [*group, "feature"]
    points = wanted.groupBy(*of).agg(F.array_sort(F.collect_set("lambda")).alias("_points"))  # a few per fold
    powered = _with_slope_terms(cells.select(*of, fold, "value").join(points, of).withColumn("lambda", F.explode("_points")))
    per_fold = powered.groupBy(*of, "lambda", fold).agg(
        F.count("value").alias("n"),
        F.avg("_t").alias("t"),
        F.avg("_dt").alias("dt"),
        F.var_pop("_t").alias("var"),
        F.covar_pop("_t", "_dt").alias("cov"),
        F.avg(F.signum("value") * F.col("_size")).alias("log"),
    )
    # at most one row per fold
    parts = per_fold.groupBy(*of, "lambda").agg(
        F.array_sort(F.collect_list(F.struct(fold, "n", "t", "dt", "var", "cov", "log"))).alias("_parts")
    )
    merged = wanted.join(parts, [*of, "lambda"]).withColumn("_rest", F.filter("_parts", lambda p: p[fold] != F.col(fold)))

    def mean(term) -> Column:
        return F.aggregate("_rest", F.lit(0.0), lambda total, p: total + p["n"] * term(p)) / F.nullif("n", F.lit(0.0))

    merged = merged.withColumn("n", F.aggregate("_rest", F.lit(0.0), lambda total, p: total + p["n"]))
    merged = merged.withColumn("mean", mean(lambda p: p["t"])).withColumn("_mean_dt", mean(lambda p: p["dt"]))
    off = F.col("mean")
    merged = merged.withColumn("var", mean(lambda p: p["var"] + (p["t"] - off) * (p["t"] - off))).withColumn(
        "_cov", mean(lambda p: p["cov"] + (p["t"] - off) * (p["dt"] - F.col("_mean_dt")))
    )
    # what merging leaves of a constant column is rounding, not spread
    spread = F.when(F.col("var") > 1e-24 * off * off, F.col("var")).otherwise(F.when(F.isnan("var"), F.col("var")).otherwise(0.0))
    merged = merged.withColumn("var", spread)
    slope = mean(lambda p: p["log"]) - F.col("_cov") / F.nullif("var", F.lit(0.0))
    # with a spread near the rounding of the values the slope is noise
    lost = slope.isNull() | F.isnan(slope) | (F.abs(slope) == float("inf")) | (F.col("var") <= 1e-12 * off * off)
    towards_one = F.when(F.col("lambda") < 1, float("inf")).otherwise(float("-inf"))
    return merged.withColumn("slope", F.when(lost, towards_one).otherwise(slope)).select(*wanted.columns, "n", "mean", "var", "slope")


def _root(low: Column, low_slope: Column, high: Column, high_slope: Column) -> Column:
    """Where the line through both ends meets 0; the middle where one end has no finite slope."""
    steep = low_slope - high_slope
    line = low + (high - low) * low_slope / F.nullif(steep, F.lit(0.0))
    middle = (low + high) / 2
    return F.when(F.abs(steep) == float("inf"), middle).otherwise(F.coalesce(line, middle))


def _next_points(tolerance: float) -> Column:
    """Exponents to look at next: beyond an open end, or inside the bracket around the line's root."""
    a, b = F.col("low.lambda"), F.col("high.lambda")
    width = b - a
    root = _root(a, F.col("low.slope"), b, F.col("high.slope"))
    root = F.least(F.greatest(root, a + width / 64), b - width / 64)
    scale = F.greatest(F.lit(1.0), F.abs(a))
    near = F.least(width / 8, F.greatest(width * width / (8 * scale), tolerance / 4 * scale))
    # a root close to an end may creep: the middle keeps the bracket shrinking
    creeping = (root - a < width / 8) | (b - root < width / 8)
    inside = F.filter(F.array(root - near, root + near, F.when(creeping, (a + b) / 2)), lambda p: (p > a) & (p < b))
    left = F.array(*[b - (F.abs(b) + 1) * k for k in (1.0, 4.0, 16.0)])
    right = F.array(*[a + (F.abs(a) + 1) * k for k in (1.0, 4.0, 16.0)])
    return F.when(a.isNull(), left).when(b.isNull(), right).otherwise(inside)


def yeojohnson_lambda(
    cells: DataFrame,
    fold: str = "outer_fold",
    within: Sequence[str] = (),
    tolerance: float = 1e-4,
) -> DataFrame:
    """The exponent of greatest likelihood per (held-out fold, feature), without limits: ``lambda, mean, std, status``.

    The log-likelihood is concave in the exponent, so that the sign of its slope says on which side
    the optimum lies. All splits and features are bracketed at once: every step is one aggregate
    at a few exponents of each, and who is bracketed within ``tolerance`` leaves with the root of the line between the
    ends, whose error is of the order of its square. ``mean`` and ``std`` are those
    after the transform. ``status`` is 'optimum'; 'constant' where the train part has no spread, with exponent 1; or
    'unbounded' where no optimum lies in the range of doubles, with the last exponent inside it. ``cells`` are read once a step: pass
    them stored.
    """
    group = list(within)
    keys = [*group, fold, "feature"]
    start = F.explode(F.array(*[F.lit(v) for v in START])).alias("lambda")
    folds_of = cells.select(*group, fold).distinct()
    features_of = cells.select(*group, "feature").distinct()
    # stored, so that its size is known when the first look is planned: else all cells are shuffled to meet it
    pairs = stage(features_of.join(folds_of, group) if group else features_of.crossJoin(folds_of))
    seen = _slopes(cells, pairs.select(*keys, start), group, fold)
    # exponent 1 is in the first look only as a point of its own
    unchanged = F.coalesce(F.max(F.when(F.col("lambda") == 1.0, F.coalesce(F.col("var") == 0, F.lit(True)))), F.lit(False))

    def bracket(rows: DataFrame, constant: Column) -> DataFrame:
        end = F.struct("lambda", "slope")
        return rows.groupBy(*keys).agg(
            F.max(F.when(F.col("slope") > 0, end)).alias("low"),
            F.min(F.when(F.col("slope") <= 0, end)).alias("high"),
            constant.alias("constant"),
        )

    width = F.col("high.lambda") - F.col("low.lambda")
    narrow = width <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("low.lambda")))
    lost = F.greatest(F.abs("low.lambda"), F.abs("high.lambda")) > FARTHEST
    done = F.col("constant") | F.coalesce(narrow, F.lit(False)) | F.coalesce(lost, F.lit(False))

    def looked_at(rows: DataFrame, constant: Column = F.lit(False)) -> DataFrame:
        return stage(bracket(rows, constant).withColumn("done", done).withColumn("points", F.when(~F.col("done"), _next_points(tolerance))))

    states = looked_at(seen, unchanged)
    parts = [states.where("done")]
    open_ = states.where("NOT done")
    while not open_.isEmpty():
        wanted = open_.select(*keys, F.explode("points").alias("lambda"))
        slopes = _slopes(cells, wanted, group, fold).select(*keys, "lambda", "slope")
        ends = open_.select(*keys, F.inline(F.filter(F.array("low", "high"), lambda e: e.isNotNull())))
        states = looked_at(slopes.unionAll(ends))
        parts.append(states.where("done"))
        open_ = states.where("NOT done")
    found = reduce(DataFrame.unionByName, parts)
    finite = (F.abs("low.slope") < float("inf")) & (F.abs("high.slope") < float("inf")) & ~F.coalesce(lost, F.lit(False))
    status = F.when(F.col("constant"), "constant").when(F.coalesce(finite, F.lit(False)), "optimum").otherwise("unbounded")
    usable = F.when(F.abs("low.slope") < float("inf"), F.col("low.lambda")).when(F.abs("high.slope") < float("inf"), F.col("high.lambda"))
    root = _root(F.col("low.lambda"), F.col("low.slope"), F.col("high.lambda"), F.col("high.slope"))
    chosen = found.withColumn("status", status).select(
        *keys,
        "status",
        F.when(F.col("status") == "optimum", root).when(F.col("status") == "constant", 1.0).otherwise(F.coalesce(usable, F.lit(1.0))).alias("lambda"),
    )
    moments = _slopes(cells, stage(chosen), group, fold)
    return moments.select(*keys, "lambda", "mean", F.sqrt("var").alias("std"), "status")


def yeojohnson_grid(
    train_cells: DataFrame, keys: Sequence[str] = ("outer_fold",), settings: Settings = Settings()
) -> DataFrame:
    """The exponent of an even grid whose result is least skewed, per (split, feature)."""
    grid = lambda_grid(settings.lambda_start, settings.lambda_end, settings.interval_parameter)
    powered = train_cells.withColumn("lambda", F.explode(F.array(*[F.lit(v) for v in grid])))
    # a column of its own: inside the aggregate it would be computed once per moment
    powered = powered.withColumn("_t", yeo_johnson(F.col("value"), F.col("lambda")))
    skews = powered.groupBy(*keys, "feature", "lambda").agg(F.skewness("_t").alias("skew"))
    best = F.min(F.when(F.col("skew").isNotNull(), F.struct(F.abs("skew").alias("size"), "lambda", "skew")))
    return skews.groupBy(*keys, "feature").agg(best.alias("_best")).select(
        *keys,
        "feature",
        F.coalesce("_best.lambda", F.lit(1.0)).alias("lambda"),
        F.col("_best.skew").alias("skew"),
    )


def yeojohnson_apply(cells: DataFrame, lambdas: DataFrame, keys: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Transform every cell of a split with the exponents fitted on its train part.

    Pass stored ``lambdas``: then Spark broadcasts them when they are small.
    """
    exponents = lambdas.select(*keys, "feature", "lambda")
    return cells.join(exponents, [*keys, "feature"]).withColumn(
        "value", yeo_johnson(F.col("value"), F.col("lambda"))
    ).drop("lambda")


def standardize(cells: DataFrame, moments: DataFrame, keys: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """``(x - mean) / std`` with train moments; a std of 0 counts as 1."""
    fitted = moments.select(*keys, "feature", "mean", "std")
    return cells.join(fitted, [*keys, "feature"]).withColumn(
        "value", standard_score(F.col("value"), F.col("mean"), F.col("std"))
    ).drop("mean", "std")


def standard_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std > 0, std).otherwise(1.0)


def fitted_vectors(model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fitted exponents, means and stds of a split as one array, ordered by ``feature_ord``."""
    ordered = F.array_sort(F.collect_list(F.struct("feature_ord", "lambda", "mean", "std")))
    return model.groupBy(*keys).agg(ordered.alias("_fit"))


def transform_vectors(vectors: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Yeo-Johnson and standardisation of whole row vectors, one expression per row.

    ``fitted`` has one row per split; the keys may be NULL (outer level).
    """
    new = F.zip_with(
        "features",
        "_fit",
        lambda x, p: standard_score(yeo_johnson(x, p["lambda"]), p["mean"], p["std"]),
    )
    return join_null_safe(vectors, fitted, keys).withColumn("features", new).select(*vectors.columns)
