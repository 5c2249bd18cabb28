"""Routing of units to arms by cross-fitted gain models, without a unit on the driver.

A weighted ridge needs only sums of products: one aggregate gives them for every fold, and the model that has not seen a fold comes from
the total less the fold's own. Predictions, margins and choices are columns; a margin is a weighted quantile found by ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import groups
from cairn.plans.blending import Ridge, ridge_column
from cairn.plans.staging import Stage

ALPHA = 10.0


def with_weight(units: DataFrame, group: str = "component") -> DataFrame:
    """Adds ``_w``: a unit's share of its group, so that groups weigh alike."""
    n = units.groupBy(group).agg((1 / F.count("*")).alias("_w"))
    return units.join(n, group)


@dataclass
class Sums:
    """Of rows ``v`` with weight ``w``: number, sum of ``w``, of ``w v`` and of ``w v v'``, about a common centre."""

    n: float
    w: float
    first: np.ndarray
    second: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.w - other.w, self.first - other.first, self.second - other.second)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.w + other.w, self.first + other.first, self.second + other.second)

    def ridge(self, k: int, target: int, centre: np.ndarray, alpha: float = ALPHA) -> Ridge:
        """On the first ``k`` columns for one of the others; weights are brought to mean one."""
        mean = self.first / self.w
        cov = self.second / self.w - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
        scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(centre[:k])), scale, 1.0)
        coef = np.linalg.solve(self.n * cov[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k), self.n * cov[:k, target] / scale)
        return Ridge(mean[:k] + centre[:k], scale, coef, float(mean[target] + centre[target]))


def fold_sums(units: DataFrame, columns: Sequence[str], fold: str, weight: str = "_w") -> tuple[dict[int, Sums], np.ndarray]:
    """``Sums`` of each fold, from one aggregate of units by fold, and the centre they are about."""
    centre = np.array(units.agg(F.array(*(F.avg(c) for c in columns))).first()[0], float)
    v = [F.col(c) - float(m) for c, m in zip(columns, centre)]
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col(weight)
    rows = units.groupBy(fold).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.array(*(F.sum(w * x) for x in v)).alias("a"), F.array(*(F.sum(w * v[i] * v[j]) for i, j in pairs)).alias("b")).collect()  # a row for each fold
    out = {}
    for r in rows:
        second = np.zeros((k, k))
        for (i, j), x in zip(pairs, r["b"]):
            second[i, j] = second[j, i] = x
        out[r[fold]] = Sums(float(r["n"]), float(r["w"]), np.array(r["a"]), second)
    return out, centre


def quantiles(t: DataFrame, value: str, weight: str, shares: Sequence[float]) -> list[float]:
    """For each share the smallest value whose weight, summed in order, reaches it; the largest if none does. Ranges of the values are
    summed apart; only those in which a share is reached are sorted."""
    staged = Stage(t.sparkSession, "quantiles").put(t.select(F.col(value).alias("v"), F.col(weight).alias("w")).repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    sums = sorted((r["range"], r["w"], r["top"]) for r in staged.groupBy("range").agg(F.sum("w").alias("w"), F.max("v").alias("top")).collect())  # one row for each range
    total, out = sum(s[1] for s in sums), []
    for q in shares:
        before = 0.0
        for k, own, top in sums:
            if before + own >= q * total * (1 - 1e-12) or k == sums[-1][0]:
                so_far = F.sum("w").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + before
                hit = staged.where(F.col("range") == k).withColumn("s", so_far).where(F.col("s") >= q * total * (1 - 1e-12)).agg(F.min("v")).first()[0]
                out.append(float(top if hit is None else hit))
                break
            before += own
    return out


@dataclass
class Router:
    """``models``: a gain model for each arm; ``margins``: for each quantile and arm."""

    arms: list[str]
    features: list[str]
    models: dict[str, Ridge]
    margins: dict[tuple[float, str], float]

    def gains(self) -> dict[str, Column]:
        """``_gain_<arm>``: what each model expects."""
        return {f"_gain_{a}": ridge_column(self.models[a], self.features) for a in self.arms}

    def choice(self, q: float) -> tuple[Column, Column]:
        """Of a table with ``gains``: the arm of largest lower bound, the first of several, and that bound; ``fallback`` where none is positive."""
        bounds = [F.col(f"_gain_{a}") - self.margins[q, a] for a in self.arms]
        top = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
        arm = F.when(top <= 0, F.lit("fallback"))
        for name, b in zip(self.arms, bounds):
            arm = arm.when(b == top, F.lit(name))
        return arm, F.greatest(top, F.lit(0.0))

    def route(self, units: DataFrame, q: float, keep: Sequence[str]) -> DataFrame:
        arm, bound = self.choice(q)
        return units.withColumns(self.gains()).select(*keep, arm.alias("arm"), bound.alias("bound")).withColumn("abstained", F.col("arm") == "fallback")


def with_folds(units: DataFrame, folds: int, seed: int, name: str = "_fold", group: str = "component") -> DataFrame:
    """Adds the fold of each unit's group: balanced by units, ties by draw."""
    sizes = units.groupBy(group).agg(F.count("*").alias("_n"))
    dealt = groups.balanced_folds(sizes, group, "_n", folds, groups.draw(seed, group))
    return units.join(dealt.select(group, F.col("fold").alias(name)), group)


def fit(units: DataFrame, arms: Sequence[str], features: Sequence[str], shares: Sequence[float] = (0.5, 0.7, 0.8, 0.9), folds: int = 4, seed: int = 0) -> Router:
    """``units``: a row for each, with its ``component``, features and ``gain_<arm>``. Margins are quantiles of what models that have not seen a unit's
    group miss its gain by; groups weigh alike everywhere."""
    stage = Stage(units.sparkSession, "routing")
    units = stage.put(with_weight(with_folds(stage.put(units), folds, seed)))
    k, columns = len(features), [*features, *(f"gain_{a}" for a in arms)]
    sums, centre = fold_sums(units, columns, "_fold")
    total = sum(list(sums.values())[1:], list(sums.values())[0])
    models, margins = {}, {}
    for at, arm in enumerate(arms):
        models[arm] = total.ridge(k, k + at, centre)
        unseen = [units.where(F.col("_fold") == f).select("_w", (F.col(f"gain_{arm}") - ridge_column((total - s).ridge(k, k + at, centre), features)).alias("v")) for f, s in sums.items()]
        missed = unseen[0]
        for part in unseen[1:]:
            missed = missed.unionAll(part)
        missed = missed.select(F.abs("v").alias("v"), "_w")
        for q, v in zip(shares, quantiles(missed, "v", "_w", shares)):
            margins[q, arm] = v
    return Router([*arms], [*features], models, margins)


@dataclass
class Nested:
    """``grid``: root error of development units at each quantile and blend; the least is frozen and scored on the holdout."""

    quantile: float
    blend: float
    grid: dict[tuple[float, float], float]
    holdout: float
    fallback: float
    decisions: DataFrame


def _root(arm: Column, blend: float, arms: Sequence[str]) -> Column:
    """Root mean square over units that move by ``blend`` towards their arm, from ``n``, ``rr``, ``c_<arm>`` and ``g_<arm>``."""
    mse = F.col("rr")
    for a in arms:
        mse = F.when(arm == a, F.col("rr") + blend * blend * F.col(f"g_{a}") - 2 * blend * F.col(f"c_{a}")).otherwise(mse)
    return F.sqrt(F.sum(F.col("n") * F.greatest(mse, F.lit(0.0))) / F.sum("n"))


def nested(units: DataFrame, held_out: Column, arms: Sequence[str], features: Sequence[str], shares: Sequence[float] = (0.5, 0.7, 0.8, 0.9), blends: Sequence[float] = (0.25, 0.5, 0.75, 1.0), folds: int = 3, seed: int = 0, keep: Sequence[str] = ("well", "component")) -> Nested:
    """Quantile and blend are chosen on development units routed by models that saw neither the unit's group nor its fold, then frozen for
    the holdout. ``units`` also has ``n``, ``rr``, ``c_<arm>`` and ``g_<arm>``."""
    stage = Stage(units.sparkSession, "nested")
    units = stage.put(units)
    dev, hold = stage.put(with_folds(units.where(~held_out), folds, seed, "_outer")), stage.put(units.where(held_out))
    parts = []
    for k in range(folds):
        router = fit(dev.where(F.col("_outer") != k), arms, features, shares, folds, seed + 1009 * k)
        own = dev.where(F.col("_outer") == k).withColumns(router.gains())
        parts.append(own.withColumns({f"_arm{i}": router.choice(q)[0] for i, q in enumerate(shares)}))
    routed = parts[0]
    for part in parts[1:]:
        routed = routed.unionByName(part)
    routed = stage.put(routed)
    scored = routed.agg(*(_root(F.col(f"_arm{i}"), b, arms).alias(f"r_{i}_{j}") for i in range(len(shares)) for j, b in enumerate(blends))).first()
    grid = {(q, b): float(scored[f"r_{i}_{j}"]) for i, q in enumerate(shares) for j, b in enumerate(blends)}
    q, b = min(grid, key=lambda key: (grid[key], key))
    decided = stage.put(fit(dev, arms, features, shares, folds, seed + 99991).route(hold, q, [*hold.columns]))
    new, old = decided.agg(_root(F.col("arm"), b, arms), _root(F.lit("fallback"), 0.0, arms)).first()
    return Nested(q, b, grid, float("nan") if new is None else float(new), float("nan") if old is None else float(old), decided.select(*keep, "arm", "bound", "abstained"))
