"""Gradient-boosted trees on bounded numpy samples, flattened into node arrays.

Growth is level by level over histograms of quantile bins. A constrained
feature only gets splits whose leaves follow its direction, and the middle of
the two leaf values bounds everything below, so that the whole ensemble is
monotone in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values (log odds) of every row of ``x``."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                goes_left = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def constant(probability: float) -> Trees:
    """A model without trees."""
    none = np.zeros(0, np.int64)
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Trees(none, none * 1.0, none, none, none * 1.0, none, 0, float(np.log(p / (1 - p))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    monotone: dict[int, int] | None = None,
    l2: float = 1.0,
    least: float = 2.0,
    bins: int = 64,
) -> Trees:
    """Logistic boosting. ``monotone``: +1 or -1 by feature; ``least``: smallest hessian sum of a leaf.

    Without rows, or with one class only, the model is a constant.
    """
    if len(y) == 0:
        return constant(0.5)
    base = (y.sum() + 0.5) / (len(y) + 1.0)
    if y.min() == y.max():
        return constant(base)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    sign = np.zeros(d)
    for j, s in (monotone or {}).items():
        sign[j] = s
    flat_bins = binned + np.arange(d) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(v)
        return at

    start = np.log(base / (1 - base))
    margin = np.full(n, start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        root = node(-g.sum() / (h.sum() + l2) * rate)
        roots.append(root)
        where = np.full(n, root)
        open_nodes = {root: (-np.inf, np.inf)}
        for _ in range(depth):
            following: dict[int, tuple[float, float]] = {}
            for at, (low, high) in open_nodes.items():
                rows = np.flatnonzero(where == at)
                if len(rows) < 2:
                    continue
                cells = flat_bins[rows].ravel()
                gs = np.bincount(cells, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl, gr, hr = gs[:, :-1], hs[:, :-1], gt - gs[:, :-1], ht - hs[:, :-1]
                vl = np.clip(-gl / (hl + l2), low, high)
                vr = np.clip(-gr / (hr + l2), low, high)
                whole = np.clip(-gt / (ht + l2), low, high)

                def loss(gg, hh, v):
                    return gg * v + 0.5 * (hh + l2) * v * v

                gain = loss(gt, ht, whole) - loss(gl, hl, vl) - loss(gr, hr, vr)
                bad = (hl < least) | (hr < least) | (sign[:, None] * (vr - vl) < 0)
                gain = np.where(bad, -np.inf, gain)
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if not gain[j, b] > 1e-6 or b >= len(edges[j]):
                    continue
                feature[at], threshold[at] = int(j), float(edges[j][b])
                middle = (vl[j, b] + vr[j, b]) / 2
                children = node(vl[j, b] * rate), node(vr[j, b] * rate)
                left[at], right[at] = children
                goes = binned[rows, j] <= b
                where[rows] = np.where(goes, children[0], children[1])
                bounds = ((low, middle), (middle, high)) if sign[j] > 0 else ((middle, high), (low, middle)) if sign[j] < 0 else ((low, high),) * 2
                following |= dict(zip(children, bounds))
            open_nodes = following
        margin += np.asarray(value)[where]
    return Trees(
        np.asarray(feature), np.asarray(threshold), np.asarray(left), np.asarray(right),
        np.asarray(value), np.asarray(roots), depth, float(start),
    )
