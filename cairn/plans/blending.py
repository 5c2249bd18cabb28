"""Constrained blends, cross-fitted routing, and splits by whole groups: Spark aggregates, then small problems on the driver.

What reaches the driver are moments (a few numbers for each arm or group) and group or unit tables; never rows of the panel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import metrics


# --- quadratic blends ----------------------------------------------------------------------------------------------------


def solve_capped_simplex(gram: np.ndarray, cross: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Minimises ``w'Gw - 2c'w + ridge |w|^2`` over ``w >= 0, sum(w) <= 1``, exactly, for a few arms: the stationary point of
    every set of positive arms, with the sum free or one, is tried."""
    n = len(cross)
    h = gram + ridge * np.eye(n)
    value = lambda w: float(w @ h @ w - 2 * cross @ w)
    best, least = np.zeros(n), 0.0
    for active in map(list, chain.from_iterable(combinations(range(n), k) for k in range(1, n + 1))):
        a, c = h[np.ix_(active, active)], cross[active]
        free = np.linalg.lstsq(a, c, rcond=None)[0]
        k = len(active)
        tied = np.linalg.lstsq(np.block([[2 * a, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]]), np.r_[2 * c, 1.0], rcond=None)[0][:k]
        for w, ok in ((free, free.sum() <= 1 + 1e-12), (tied, True)):
            if ok and w.min() >= -1e-12:
                full = np.zeros(n)
                full[active] = np.maximum(w, 0)
                full /= max(1.0, full.sum())
                if value(full) < least - 1e-15:
                    best, least = full, value(full)
    return best


def project_capped_simplex(w: np.ndarray) -> np.ndarray:
    w0 = np.maximum(w, 0)
    if w0.sum() <= 1:
        return w0
    s = np.sort(w)[::-1]
    k = np.flatnonzero(s - (np.cumsum(s) - 1) / np.arange(1, len(s) + 1) > 0)[-1]
    return np.maximum(w - (np.cumsum(s)[k] - 1) / (k + 1), 0)


@dataclass(frozen=True)
class Blend:
    parent: str
    weights: dict[str, float]

    @property
    def parent_weight(self) -> float:
        return min(1.0, max(0.0, 1.0 - sum(self.weights.values())))


def _unpack(row, arms: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, float]:
    n, g = len(arms), np.empty((len(arms), len(arms)))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return g, np.array([row[f"c_{i}"] for i in range(n)]), row["rr"], row["n"]


def fit_stack(panel: DataFrame, arms: Sequence[str], parent: str, ridge: float, group: str = "component") -> Blend:
    """Moves from the parent with groups counted alike; weights none negative and at most one together."""
    row = metrics.moments(metrics.row_weights(panel, group), arms, parent, weight="weight").first()
    g, c, _, _ = _unpack(row, arms)
    return Blend(parent, dict(zip(arms, solve_capped_simplex(g, c, ridge).tolist())))


@dataclass(frozen=True)
class Moments:
    """What a blend's error needs to know of each group: rows, and means of ``(arm - parent)`` products, of their products with
    ``truth - parent``, and of the latter's square. One small record for each group, whatever the rows."""

    groups: tuple
    n: np.ndarray
    g: np.ndarray
    c: np.ndarray
    rr: np.ndarray

    def take(self, keep: np.ndarray) -> Moments:
        return Moments(tuple(x for x, k in zip(self.groups, keep) if k), self.n[keep], self.g[keep], self.c[keep], self.rr[keep])

    def mse(self, w: np.ndarray) -> np.ndarray:
        return np.maximum(np.einsum("i,gij,j->g", w, self.g, w) - 2 * self.c @ w + self.rr, 0)


def group_moments(panel: DataFrame, arms: Sequence[str], parent: str, group: str = "component") -> Moments:
    """Collects a record for each group of a panel; groups are few next to rows, and the solvers need them all."""
    rows = metrics.moments(panel, arms, parent, [group]).orderBy(group).collect()
    g, c, rr, n = (np.array(x, dtype=float) for x in zip(*(_unpack(r, arms) for r in rows)))
    return Moments(tuple(r[group] for r in rows), n, g, c, rr)


def solve_robust(m: Moments, macro: float = 0.5, tail: float = 0.5, ridge: float = 0.02, fraction: float = 0.1, steps: int = 4000) -> np.ndarray:
    """Weights of least row, group and worst-group mean squares with a ridge: projected subgradients from several starts, the best point kept."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    worst = max(1, int(np.ceil(fraction * len(m.n))))
    scale = max(float(np.abs(m.g).max()), 1e-12)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        mse, slope = np.einsum("i,gij,j->g", w, m.g, w) - 2 * m.c @ w + m.rr, 2 * (m.g @ w - m.c)
        bad = np.argsort(mse, kind="stable")[-worst:]
        share = m.n / m.n.sum() + macro / len(m.n)
        share[bad] += tail / worst
        return float(share @ mse + ridge * w @ w), share @ slope + 2 * ridge * w

    k = m.c.shape[1]
    best, least = np.zeros(k), at(np.zeros(k))[0]
    for start in [np.zeros(k), np.full(k, 1 / (k + 1)), *np.eye(k)]:
        w = start
        for t in range(steps):
            v, d = at(w)
            if v < least - 1e-15:
                best, least = w, v
            w = project_capped_simplex(w - d / (2 * scale * (1 + macro + tail)) / np.sqrt(1 + t / 50))
    return best


def fit_robust(panel: DataFrame, arms: Sequence[str], parent: str = "incumbent", macro: float = 0.5, tail: float = 0.5, ridge: float = 0.02, fraction: float = 0.1, group: str = "component", steps: int = 4000) -> Blend:
    w = solve_robust(group_moments(panel, arms, parent, group), macro, tail, ridge, fraction, steps)
    return Blend(parent, dict(zip(arms, w.tolist())))


def solve_trust_region(m: Moments, cap: float = 0.1, macro: float = 0.25, tail: float = 0.25, l2: float = 0.01, step: float = 0.005, fraction: float = 0.1) -> float:
    """The weight of one arm, on a grid up to ``cap``: shares of row, group and tail error relative to the parent's, and the squared weight."""
    at = np.round(np.arange(0, cap + step / 2, step), 12)
    base = scores(m, np.zeros(1), fraction, squares=True)
    value = [(round((1 - macro - tail) * s[0] / base[0] + macro * s[1] / base[1] + tail * s[2] / base[2] + l2 * w * w, 14), w) for w in at for s in [scores(m, np.array([w]), fraction, squares=True)]]
    return float(min(value)[1])


def scores(m: Moments, w: np.ndarray | None = None, fraction: float = 0.1, squares: bool = False, mse: np.ndarray | None = None) -> tuple[float, float, float]:
    """Row error, mean group error and that of the worst groups; ``squares``: the tail's root of the mean square, else its mean root."""
    mse = m.mse(w) if mse is None else mse
    worst = np.sort(mse)[-max(1, int(np.ceil(fraction * len(mse)))) :]
    return float(np.sqrt(m.n @ mse / m.n.sum())), float(np.sqrt(mse).mean()), float(np.sqrt(worst.mean()) if squares else np.sqrt(worst).mean())


def fit_trust_region(panel: DataFrame, arm: str = "ridge", parent: str = "sequential_final", cap: float = 0.1, step: float = 0.005, **kw) -> Blend:
    grid = metrics.blend_grid(panel, parent, arm, cap, step, **kw)
    row = grid.orderBy(F.round("objective", 14), "w").first()
    return Blend(parent, {arm: float(row.w)})


# --- splits by whole groups -----------------------------------------------------------------------------------------------


def balanced(sizes: dict[str, int], folds: int, tie: Callable[[str], object] = lambda g: g) -> dict[str, int]:
    """Largest group first into the least loaded fold; ``tie`` orders groups of equal size."""
    if len(sizes) < folds:
        raise ValueError(f"{len(sizes)} groups cannot fill {folds} folds")
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], tie(g), str(g))):
        k = load.index(min(load))
        out[g] = k
        load[k] += sizes[g]
    return out


#: How groups of equal size are ordered: by name, by a draw for each name in order, or by a draw for each in order of size.
TIES = ("name", "draw", "draw_by_size")


def assign(sizes: dict, folds: int, rule: str = "name", seed: int = 0) -> dict:
    """``balanced`` under one of the registered tie rules."""
    names = sorted(sizes, key=str)
    if rule == "name":
        return balanced(sizes, folds, str)
    if rule == "draw_by_size":
        names = sorted(names, key=lambda g: -sizes[g])
    elif rule != "draw":
        raise ValueError(f"unknown rule {rule!r}")
    drawn = dict(zip(names, np.random.default_rng(seed).random(len(names))))
    return balanced(sizes, folds, drawn.__getitem__)


# --- weighted ridge ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ridge:
    """Ridge on standardised features, without a penalty on the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, alpha: float = 10.0) -> Ridge:
        w = np.ones(len(y)) if weight is None else weight
        share = w / w.sum()
        mean = share @ x
        scale = np.sqrt(share @ (x - mean) ** 2)
        scale = np.where(scale > 0, scale, 1.0)
        z, top = (x - mean) / scale, share @ y
        coef = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - top))
        return cls(mean, scale, coef, float(top))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.coef + self.intercept


def ridge_by_moments(rows: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0) -> Ridge:
    """The same from one pass of Spark aggregates: means and products of every pair, then a solve on the driver."""
    cols = [*features, target]
    k = len(cols)
    stats = rows.agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in cols)).alias("m")).first()
    m = np.array(stats["m"])
    d = [F.col(c) - float(v) for c, v in zip(cols, m)]
    pairs = rows.agg(F.array(*(F.sum(d[i] * d[j]) for i in range(k) for j in range(i, k))).alias("s")).first()["s"]
    s = np.zeros((k, k))
    s[np.triu_indices(k)] = pairs
    s = s + np.triu(s, 1).T
    scale = np.sqrt(np.diag(s)[:-1] / stats["n"])
    scale = np.where(scale > 0, scale, 1.0)
    coef = np.linalg.solve(s[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(k - 1), s[:-1, -1] / scale)
    return Ridge(m[:-1], scale, coef, float(m[-1]))


def ridge_column(model: Ridge, features: Sequence[str]):
    """The model as a column expression."""
    b = model.coef / model.scale
    return sum((float(v) * F.col(c) for c, v in zip(features, b)), F.lit(float(model.intercept - model.mean @ b)))
