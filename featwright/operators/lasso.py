"""Lasso fits of any width from panels of the cross-product matrix.

A lasso fit and its R² depend on the data only through counts, means and
centred products. One pass over the rows yields these as panels of 256 × 256
features per split; no fit touches a row again, and no task holds more than a
few panels or the products of one working set.

With ``u = scale·e_target - w``, the gradient of a fit is ``P·u / n`` and its
validation error ``uᵀ·P·u`` plus a shift of the means. So all there is to do
over the panels is one product with ``u``. Fits run in rounds: a product, the
features that violate the optimality conditions most, their own products, and
an exact descent over them with all other weights fixed. A fit ends when no
feature violates its condition, so the width sets the number of rounds only.
The objective is ``1/(2n)·|y - Xw|² + alpha·|w|₁`` with an intercept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featwright.operators.gram import BLOCK, gram_blocks
from featwright.plans.splits import SPLIT, Splits
from featwright.settings import Settings
from featwright.storage import stage

WORKING = 1024  # features a round moves: their products take 8 MB
TOLERANCE = 1e-6  # a condition may be off by this, for targets of unit scale
LEVEL = ["outer_fold", "inner"]  # inner -1: the outer level
GROUP = [*LEVEL, "chunk"]  # fits that share their targets' panels
_GROUP = "outer_fold int, inner int, chunk int"


def split_blocks(splits: Splits) -> DataFrame:
    """Stored panels per (split, role); the label is the last column of the vectors."""
    rows = splits.rows().withColumn("features", F.array_append("features", F.col("label").cast("double")))
    return stage(gram_blocks(rows, [*SPLIT, "role"]))


def coordinate_descent(
    gram: np.ndarray,
    cross: np.ndarray,
    alpha: np.ndarray,
    allowed: np.ndarray,
    start: np.ndarray | None = None,
    tol: float = 1e-9,
    sweeps: int = 2000,
    jump_every: int = 20,
) -> np.ndarray:
    """Lasso weights of many problems (columns) that share one Gram matrix.

    Sweeps are slow where features are all but copies of each other, so now and then every
    problem jumps to the optimum of its present signs, or as far as these hold.
    """
    w = np.zeros_like(cross) if start is None else start.copy()
    rest = cross - gram @ w
    size = np.diag(gram)
    limit = tol * max(1.0, float(np.abs(cross).max(initial=0.0)))
    for sweep in range(1, sweeps + 1):
        largest = np.zeros(cross.shape[1])
        for j in np.flatnonzero(size > 1e-12):
            pull = rest[j] + size[j] * w[j]
            new = np.where(allowed[j], np.sign(pull) * np.maximum(np.abs(pull) - alpha, 0.0) / size[j], 0.0)
            step = new - w[j]
            if step.any():
                rest -= np.outer(gram[:, j], step)
                w[j] = new
                largest = np.maximum(largest, np.abs(step) * size[j])
        if largest.max(initial=0.0) < limit:
            break
        if sweep % jump_every == 0:
            for m in np.flatnonzero(largest >= limit):
                _jump(gram, rest[:, m], alpha[m], w[:, m])
            rest = cross - gram @ w
    return w


def _jump(gram: np.ndarray, rest: np.ndarray, alpha: float, w: np.ndarray) -> None:
    """Move the weights, in place, towards the optimum with their signs, until the first of them is 0."""
    at = np.flatnonzero(w)
    if not len(at):
        return
    step = np.linalg.lstsq(gram[np.ix_(at, at)], rest[at] - alpha * np.sign(w[at]), rcond=None)[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        until = np.where(step * w[at] < 0, -w[at] / step, np.inf)
    first = until.min()
    w[at] += min(1.0, first) * step
    if first <= 1.0:
        w[at[until.argmin()]] = 0.0


# ---- tables ------------------------------------------------------------------
# problems: GROUP, targets, alphas, sizes (of the targets), labeled: entry m of the arrays is fit m
# u:        GROUP, ord, vals: a row per feature that is a target or has a weight; vals[m] is of fit m


def _panels(blocks: DataFrame, role: str) -> DataFrame:
    return blocks.where(F.col("role") == role).withColumn("inner", F.coalesce("inner_fold", F.lit(-1))).drop(*SPLIT[1:], "role")


def _columns_of(blocks: DataFrame, role: str) -> DataFrame:
    """``(LEVEL…, n, ord, mean, size)`` of every column, read off the diagonal panels."""
    both = F.zip_with("mean_i", "squares_i", lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    arrays = F.posexplode(both).alias("_at", "_ms")
    return (
        _panels(blocks, role)
        .where("bi = bj")
        .select(*LEVEL, "n", "bi", arrays)
        .select(*LEVEL, "n", (F.col("bi") * BLOCK + F.col("_at")).alias("ord"), F.col("_ms.m").alias("mean"), F.col("_ms.s").alias("size"))
    )


def _block_of(ord_: str = "ord") -> Column:
    return F.floor(F.col(ord_) / BLOCK).cast("int")


def _by_block(u: DataFrame) -> DataFrame:
    """``u`` block by block: at most 256 features in a row."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "vals")))
    return (
        u.groupBy(*GROUP, _block_of().alias("b"))
        .agg(rows.alias("_u"))
        .select(*GROUP, "b", F.col("_u.ord").alias("ords"), F.flatten("_u.vals").alias("vals"))
    )


def _side(table: DataFrame, side: str) -> DataFrame:
    rest = [c for c in table.columns if c not in (*GROUP, "b")]
    return table.select(*GROUP, F.col("b").alias(f"b{side}"), *[F.col(c).alias(f"{c}_{side}") for c in rest])


def _matrix(values, rows: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(rows, -1)


def _products(row) -> np.ndarray:
    return _matrix(row.products, len(row.squares_i))


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One block's parts, added up as they come."""
    first = None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if first is None:
                first, total = row._asdict(), np.array(row.out, dtype=float)
            else:
                total += row.out
    if first is not None:
        yield pd.DataFrame([first | {"out": total}])


def times(panels: DataFrame, u: DataFrame) -> DataFrame:
    """``(GROUP…, b, n, sizes, out)``: the rows of block ``b`` of the centred products times ``u``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                head = {k: getattr(row, k) for k in GROUP} | {"n": row.n}
                p, found = _products(row), []
                if row.ords_j is not None:
                    at = np.asarray(row.ords_j, dtype=int) - row.bj * BLOCK
                    found.append((row.bi, row.squares_i, p[:, at] @ _matrix(row.vals_j, len(at))))
                if row.ords_i is not None and row.bi != row.bj:
                    at = np.asarray(row.ords_i, dtype=int) - row.bi * BLOCK
                    found.append((row.bj, row.squares_j, p[at].T @ _matrix(row.vals_i, len(at))))
                if found:
                    yield pd.DataFrame([head | {"b": b, "sizes": s, "out": out.ravel()} for b, s, out in found])[names]

    blocks = _by_block(u)
    schema = _GROUP + ", b int, n double, sizes array<double>, out array<double>"
    names = [*GROUP, "b", "n", "sizes", "out"]
    met = (
        panels.join(u.select(*GROUP).distinct(), LEVEL)
        .join(_side(blocks, "i"), [*GROUP, "bi"], "left")
        .join(_side(blocks, "j"), [*GROUP, "bj"], "left")
        .where("ords_i is not null or ords_j is not null")
        .select(*GROUP, "bi", "bj", "n", "squares_i", "squares_j", "products", "ords_i", "vals_i", "ords_j", "vals_j")
    )
    return met.mapInPandas(run, schema).groupBy(*GROUP, "b").applyInPandas(_added, schema)


# ---- rounds --------------------------------------------------------------------


def _first(problems: DataFrame, scale: float) -> DataFrame:
    """``u`` without weights: ``scale`` at the target of every fit."""
    return problems.select(*GROUP, "targets", F.explode(F.array_distinct("targets")).alias("ord")).select(
        *GROUP, "ord", F.transform("targets", lambda t: F.when(t == F.col("ord"), scale).otherwise(0.0)).alias("vals")
    )


def _allowed(state: DataFrame, problems: DataFrame, label: int, threshold: float | None, scale: float) -> DataFrame:
    """``(GROUP…, b, allowed)``: packed bits, which feature may have a weight in which fit.

    Never the target itself; with a threshold only features of at most that correlation to it, and
    the label just where the fit is ``labeled``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes)
                ords = np.arange(len(sizes)) + row.b * BLOCK
                bits = np.ones((len(sizes), len(row.targets)), dtype=bool)
                if threshold is not None:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r = _matrix(row.out, len(sizes)) / scale / np.sqrt(np.outer(sizes, row.target_sizes))
                    bits = np.abs(r) <= threshold
                    bits[ords == label] = row.labeled
                # sums of squares of two equal columns may differ in the last digit
                bits &= ords[:, None] != np.asarray(row.targets)[None, :]
                yield pd.DataFrame([{k: getattr(row, k) for k in (*GROUP, "b")} | {"allowed": np.packbits(bits).tobytes()}])

    met = state.join(problems, GROUP).select(*GROUP, "b", "sizes", "out", "targets", "target_sizes", "labeled")
    return met.mapInPandas(run, _GROUP + ", b int, allowed binary")


def _conditions(row, scale: float) -> tuple[np.ndarray, ...]:
    """Features, gradient, weights and allowed bits of a block of fits."""
    rows, m = len(row.sizes), len(row.targets)
    ords = np.arange(rows) + row.b * BLOCK
    w = np.zeros((rows, m))
    if row.ords is not None:
        w[np.asarray(row.ords, dtype=int) - row.b * BLOCK] = -_matrix(row.vals, len(row.ords))
        w[ords[:, None] == np.asarray(row.targets)[None, :]] = 0.0
    allowed = np.unpackbits(np.frombuffer(row.allowed, np.uint8), count=rows * m).reshape(rows, m).astype(bool)
    return ords, _matrix(row.out, rows) / row.n, w, allowed


def _violations(state: DataFrame, scale: float, tolerance: float) -> DataFrame:
    """``(GROUP…, b, ord, score, weight)`` of features with a weight or a violated condition; score 0 if not violated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ords, gradient, w, allowed = _conditions(row, scale)
                alpha = np.asarray(row.alphas)[None, :]
                off = np.where(w != 0, np.abs(gradient - alpha * np.sign(w)), np.maximum(np.abs(gradient) - alpha, 0.0))
                # a constant feature has nothing to move
                off = np.where(allowed & (np.asarray(row.sizes)[:, None] > 1e-12 * row.n), off, 0.0).max(axis=1)
                off[off <= tolerance * max(1.0, scale)] = 0.0
                weight = np.abs(w).max(axis=1)
                at = np.flatnonzero((off > 0) | (weight > 0))
                head = {k: getattr(row, k) for k in (*GROUP, "b")}
                yield pd.DataFrame(head | {"ord": ords[at], "score": off[at], "weight": weight[at]}, columns=names)

    names = [*GROUP, "b", "ord", "score", "weight"]
    return state.mapInPandas(run, _GROUP + ", b int, ord int, score double, weight double")


def _gathered(panels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Products among the chosen features: ``(GROUP…, ords_i, ords_j, part)``, panel by panel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                i, j = (np.asarray(o, dtype=int) for o in (row.ords_i, row.ords_j))
                part = _products(row)[np.ix_(i - row.bi * BLOCK, j - row.bj * BLOCK)]
                head = {k: getattr(row, k) for k in GROUP}
                yield pd.DataFrame([head | {"ords_i": i, "ords_j": j, "part": part.ravel()}])

    met = panels.join(_side(chosen, "i"), [*LEVEL, "bi"]).join(_side(chosen, "j"), [*GROUP, "bj"])
    met = met.select(*GROUP, "bi", "bj", "squares_i", "products", "ords_i", "ords_j")
    return met.mapInPandas(run, _GROUP + ", ords_i array<int>, ords_j array<int>, part array<double>")


def _descend(gathered: DataFrame, state: DataFrame, scale: float) -> DataFrame:
    """New rows of ``u`` for the chosen features of every group."""

    def run(parts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        ords, gradient, w, allowed = [], [], [], []
        for row in blocks.sort_values("b").itertuples(index=False):
            every, *rest = _conditions(row, scale)
            at = np.asarray(row.chosen, dtype=int) - row.b * BLOCK
            for held, values in zip((ords, gradient, w, allowed), (every, *rest)):
                held.append(values[at])
        ords, gradient, w, allowed = np.concatenate(ords), np.concatenate(gradient), np.concatenate(w), np.concatenate(allowed)
        gram = np.zeros((len(ords), len(ords)))
        for part in parts.itertuples(index=False):
            i, j = np.searchsorted(ords, part.ords_i), np.searchsorted(ords, part.ords_j)
            p = _matrix(part.part, len(i))
            gram[np.ix_(i, j)] = p
            gram[np.ix_(j, i)] = p.T
        gram /= blocks.n.iloc[0]
        w = coordinate_descent(gram, gradient + gram @ w, np.asarray(blocks.alphas.iloc[0]), allowed, start=w)
        u = np.where(ords[:, None] == np.asarray(blocks.targets.iloc[0])[None, :], scale, 0.0) - w
        return pd.DataFrame({k: blocks[k].iloc[0] for k in GROUP} | {"ord": ords, "vals": list(u)})

    return (
        gathered.groupBy(*GROUP)
        .cogroup(state.groupBy(*GROUP))
        .applyInPandas(run, _GROUP + ", ord int, vals array<double>")
    )


def fit_panels(
    blocks: DataFrame,
    problems: DataFrame,
    label: int,
    threshold: float | None = None,
    scale: float = 1.0,
    working: int = WORKING,
    tolerance: float = TOLERANCE,
    max_rounds: int = 1000,
) -> DataFrame:
    """``u`` of all fits, stored. A task holds the products of at most ``working`` features."""
    panels = _panels(blocks, "train")
    problems = stage(_with_sizes(problems, _columns_of(blocks, "train")))
    u, allowed = stage(_first(problems, scale)), None
    live = u
    for _ in range(max_rounds):
        out = stage(times(panels, live))
        if allowed is None:
            allowed = stage(_allowed(out, problems, label, threshold, scale))
        state = (
            out.join(allowed, [*GROUP, "b"])
            .join(problems.select(*GROUP, "targets", "alphas"), GROUP)
            .join(_by_block(live), [*GROUP, "b"], "left")
        )
        found = stage(_violations(state, scale, tolerance))
        open_groups = found.where("score > 0").select(*GROUP).distinct()
        if open_groups.isEmpty():
            return u
        place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("score"), F.desc("weight"), "ord"))
        chosen = (
            found.join(open_groups, GROUP, "left_semi")
            .withColumn("_place", place)
            .where(F.col("_place") <= working)
            .groupBy(*GROUP, "b")
            .agg(F.array_sort(F.collect_list("ord")).alias("ords"))
        )
        chosen = stage(chosen)
        moved = state.join(chosen.withColumnRenamed("ords", "chosen"), [*GROUP, "b"])
        changed = stage(_descend(_gathered(panels, chosen), moved, scale))
        kept = u.join(changed.select(*GROUP, "ord"), [*GROUP, "ord"], "left_anti")
        u = stage(kept.unionByName(changed.where(F.exists("vals", lambda v: v != 0))))
        live = u.join(open_groups, GROUP, "left_semi")
    raise RuntimeError(f"lasso fits have not settled in {max_rounds} rounds")


def _with_sizes(problems: DataFrame, columns: DataFrame) -> DataFrame:
    sizes = (
        problems.select(*GROUP, F.posexplode("targets").alias("m", "ord"))
        .join(columns.select(*LEVEL, "ord", "size"), [*LEVEL, "ord"])
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("m", "size"))).getField("size").alias("target_sizes"))
    )
    return problems.join(sizes, GROUP)


def validation_errors(blocks: DataFrame, u: DataFrame) -> DataFrame:
    """``(GROUP…, m, sse)``: squared error of every fit on the validation rows of its split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                at = np.asarray(row.ords, dtype=int) - row.b * BLOCK
                u_rows = _matrix(row.vals, len(at))
                spread = (u_rows * _matrix(row.out, len(row.sizes))[at]).sum(axis=0)
                head = {k: getattr(row, k) for k in GROUP} | {"n": row.n}
                yield pd.DataFrame(head | {"m": np.arange(len(spread)), "spread": spread, "shift": np.asarray(row.shifts)[at] @ u_rows})

    def means(role: str, name: str) -> DataFrame:
        return _panels(blocks, role).where("bi = bj").select(*LEVEL, F.col("bi").alias("b"), F.col("mean_i").alias(name))

    shifts = means("valid", "_valid").join(means("train", "_train"), [*LEVEL, "b"])
    shifts = shifts.select(*LEVEL, "b", F.zip_with("_valid", "_train", lambda v, t: v - t).alias("shifts"))
    met = times(_panels(blocks, "valid"), u).join(_by_block(u), [*GROUP, "b"]).join(shifts, [*LEVEL, "b"])
    parts = met.select(*GROUP, "b", "n", "sizes", "out", "ords", "vals", "shifts").mapInPandas(
        run, _GROUP + ", n double, m int, spread double, shift double"
    )
    total = F.sum("spread") + F.max("n") * F.sum("shift") * F.sum("shift")
    return parts.groupBy(*GROUP, "m").agg(total.alias("sse"))


def _label_of(blocks: DataFrame) -> int:
    """The number of the label's column, the last one."""
    last = blocks.where("bi = bj").select(F.max(F.col("bi") * BLOCK + F.size("mean_i")).alias("n")).first().n
    return last - 1


# ---- the runs ------------------------------------------------------------------


def lasso_trials(blocks: DataFrame, alphas: Sequence[float], working: int = WORKING) -> DataFrame:
    """Lasso on the label: score (validation R²) and weights per (split, trial).

    The outer level (``inner_fold`` NULL) is the refit on the outer train part.
    """
    alphas = [float(a) for a in alphas]
    label = _label_of(blocks)
    problems = _panels(blocks, "train").select(*LEVEL).distinct().select(
        *LEVEL,
        F.lit(0).alias("chunk"),
        F.array_repeat(F.lit(label), len(alphas)).alias("targets"),
        F.lit(alphas).alias("alphas"),
        F.lit(False).alias("labeled"),
    )
    u = fit_panels(blocks, problems, label, working=working)

    def dense(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                weights = np.zeros(label)
                weights[np.asarray(row.ords, dtype=int)] = row.values
                rows.append(row._asdict() | {"weights": weights})
            yield pd.DataFrame(rows, columns=[*frame.columns, "weights"]).drop(columns=["ords", "values"])

    weighed = (
        u.where(F.col("ord") != label)
        .select(*LEVEL, "ord", F.posexplode("vals").alias("trial_id", "_u"))
        .where("_u != 0")
        .groupBy(*LEVEL, "trial_id")
        .agg(F.collect_list("ord").alias("ords"), F.collect_list(-F.col("_u")).alias("values"))
    )
    total = _columns_of(blocks, "valid").where(F.col("ord") == label).select(*LEVEL, F.col("size").alias("_total"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    scores = validation_errors(blocks, u).join(total, LEVEL)
    fits = scores.withColumnRenamed("m", "trial_id").join(weighed, [*LEVEL, "trial_id"], "left").select(
        "outer_fold",
        F.when(F.col("inner") >= 0, F.col("inner")).alias("inner_fold"),
        "trial_id",
        F.get(F.lit(alphas), F.col("trial_id")).alias("alpha"),
        F.when(F.col("_total") > 0, 1 - F.col("sse") / F.col("_total")).alias("score"),
        F.coalesce("ords", none[0]).alias("ords"),
        F.coalesce("values", none[1]).alias("values"),
    )
    names = "outer_fold int, inner_fold int, trial_id int, alpha double, score double, weights array<double>"
    return fits.mapInPandas(_null_folds(dense), names)


def _null_folds(run):
    """Folds that are NULL come to pandas as NaN; hand them back as NULL."""

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(frames):
            yield frame.assign(inner_fold=frame.inner_fold.astype("Int32"))

    return typed


def reverse_lasso(
    blocks: DataFrame,
    alphas: Sequence[float],
    n_features: int,
    settings: Settings = Settings(),
    targets_per_task: int = 32,
    working: int = WORKING,
) -> DataFrame:
    """For every feature as target: pooled validation R² without and with the label.

    All trials are fitted with the label; only targets whose best trial has an R² above 0 are refitted
    on the outer train part and fitted without the label. ``(0, 0)`` where no trial gives the label a weight
    in every inner fold, where R² is not above 0, or where the refit gives the label no weight.
    """
    alphas = [float(a) for a in alphas]
    threshold, scale = settings.train_correlation_threshold, settings.target_scale
    n_chunks = -(-n_features // targets_per_task)
    levels = _panels(blocks, "train").select(*LEVEL).distinct()
    inner = levels.where("inner >= 0")
    options = {"label": n_features, "threshold": threshold, "scale": scale, "working": working}

    def errors(problems: DataFrame, u: DataFrame) -> DataFrame:
        """Pooled over the inner folds: ``(outer_fold, target, alpha, r2, weighed)``."""
        entries = F.posexplode(F.arrays_zip("targets", "alphas")).alias("m", "_e")
        named = problems.select(*GROUP, entries).select(*GROUP, "m", F.col("_e.targets").alias("ord"), F.col("_e.alphas").alias("alpha"))
        label_row = u.where(F.col("ord") == n_features).select(*GROUP, F.posexplode("vals").alias("m", "_label"))
        columns = _columns_of(blocks, "valid").select(*LEVEL, "ord", "n", "mean", "size")
        total = F.sum("size") + F.sum(F.col("n") * F.col("mean") ** 2) - F.sum(F.col("n") * F.col("mean")) ** 2 / F.sum("n")
        pooled = (
            validation_errors(blocks, u)
            .join(named, [*GROUP, "m"])
            .join(label_row, [*GROUP, "m"], "left")
            .join(columns, [*LEVEL, "ord"])
            .groupBy("outer_fold", F.col("ord").alias("target"), "alpha")
            .agg(F.sum("sse").alias("_sse"), (total * scale**2).alias("_sst"), F.min(F.coalesce("_label", F.lit(0.0)) != 0).alias("weighed"))
        )
        return pooled.where("_sst > 0").select("outer_fold", "target", "alpha", (1 - F.col("_sse") / F.col("_sst")).alias("r2"), "weighed")

    targets = F.expr(
        f"sequence(chunk * {targets_per_task}, least((chunk + 1) * {targets_per_task}, {n_features}) - 1)"
    )
    with_label = stage(
        inner.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
        .withColumn("_targets", targets)
        .select(
            *GROUP,
            F.flatten(F.transform("_targets", lambda t: F.array_repeat(t, len(alphas)))).alias("targets"),
            F.flatten(F.transform("_targets", lambda t: F.lit(alphas))).alias("alphas"),
            F.lit(True).alias("labeled"),
        )
    )
    tried = errors(with_label, fit_panels(blocks, with_label, **options)).where("weighed")
    order = F.struct("r2", F.negative(F.array_position(F.lit(alphas), F.col("alpha"))))
    best = stage(
        tried.groupBy("outer_fold", "target").agg(F.max_by(F.struct("alpha", "r2"), order).alias("_best"))
        .select("outer_fold", "target", "_best.alpha", F.col("_best.r2").alias("labeled"))
        .where("labeled > 0")
    )
    again = best.groupBy("outer_fold", F.floor(F.col("target") / targets_per_task).cast("int").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("target", "alpha"))).alias("_t")
    )
    again = stage(
        levels.join(again, "outer_fold").select(
            *GROUP, F.col("_t.target").alias("targets"), F.col("_t.alpha").alias("alphas"), (F.col("inner") < 0).alias("labeled")
        )
    )
    u = fit_panels(blocks, again, **options)
    refit = u.where((F.col("inner") < 0) & (F.col("ord") == n_features)).select(*GROUP, F.posexplode("vals").alias("m", "_label"))
    refit = (
        refit.where("_label != 0")
        .join(again, GROUP)
        .select("outer_fold", F.get("targets", F.col("m")).alias("target"))
    )
    plain = errors(again, u.where("inner >= 0")).select("outer_fold", "target", F.col("r2").alias("unlabeled"))
    done = best.join(refit, ["outer_fold", "target"], "left_semi").join(plain, ["outer_fold", "target"])
    every = levels.select("outer_fold").distinct().select("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("target"))
    return every.join(done, ["outer_fold", "target"], "left").select(
        "outer_fold",
        F.col("target").alias("feature_ord"),
        F.coalesce("unlabeled", F.lit(0.0)).alias("unlabeled"),
        F.coalesce("labeled", F.lit(0.0)).alias("labeled"),
        "alpha",
    )
