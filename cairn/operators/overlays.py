"""Bounded corrections of a base path, in window functions over each series; no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.expr import clip
from cairn.operators.ordered import ordered, whole

SMALL = 1e-12


def _rms(c: Column, key: str) -> Column:
    return F.sqrt(F.avg(c * c).over(whole(key)))


def at_least(c: Column, floor: float = SMALL) -> Column:
    return F.greatest(c, F.lit(floor))


def parent_blend(table: DataFrame, key: str, linear: str, filtered: str, nonlinear: str, name: str = "incumbent", share: float = 0.3, most: float = 0.00425, scale: float = 6.0, disable: float = 25.0) -> DataFrame:
    """``share`` of the linear arm and the rest of the filtered one; a nonlinear arm moves it a little, unless the 95th percentile of
    its distance within the series is over ``disable``."""
    t = table.withColumn("_b", share * F.col(linear) + (1 - share) * F.col(filtered)).withColumn("_d", F.col(nonlinear) - F.col("_b"))
    t = t.withColumn("_p", F.percentile(F.abs("_d"), 0.95).over(whole(key)))
    gate = most / (1 + F.pow(F.abs("_d") / scale, 2))
    return t.withColumn(name, F.col("_b") + F.when(F.col("_p") <= disable, gate * F.col("_d")).otherwise(0.0)).drop("_b", "_d", "_p")


def bridge(table: DataFrame, key: str, base: str, linear: str, filtered: str, grid: str, horizon: str, name: str = "hgrg", beta: float = 0.5, budget: float = 2.5, consensus: float = 2.0, threshold: float = 1.0, temperature: float = 2.0, floor: float = 0.25, most: float = 0.5, ramp: float = 250.0, row_cap: float = 10.0) -> DataFrame:
    """Moves the base towards the bridge of two experts, less where they disagree and the linear arm does not point the same way."""
    t = table.withColumns({"_q": F.col(filtered) + beta * (F.col(grid) - F.col(filtered)) - F.col(base), "_l": F.col(linear) - F.col(base)})
    size, w = at_least(_rms(F.col("_q"), key)), whole(key)
    along = F.sum(F.col("_q") * F.col("_l")).over(w) / at_least(F.sum(F.col("_q") * F.col("_q")).over(w))
    risk = _rms(F.col(grid) - F.col(filtered), key) / size * F.exp(-consensus * clip(along, -1.0, 1.0))
    gate = floor + (1 - floor) * F.least(F.lit(1.0), F.pow(threshold / at_least(risk), temperature))
    t = t.withColumn("_k", gate * F.least(F.lit(most), budget / size))
    move = clip(clip(F.col(horizon) / ramp, 0.0, 1.0) * F.col("_k") * F.col("_q"), -row_cap, row_cap)
    return t.withColumn(name, F.col(base) + move).drop("_q", "_l", "_k")


def radial(table: DataFrame, key: str, base: str, proposed: str, name: str, rms_cap: float, row_cap: float) -> DataFrame:
    """The move scaled as a whole within each series until its size and its largest row fit the caps."""
    t = table.withColumn("_m", F.col(proposed) - F.col(base))
    k = F.least(F.lit(1.0), rms_cap / at_least(_rms(F.col("_m"), key)), row_cap / at_least(F.max(F.abs("_m")).over(whole(key))))
    return t.withColumn(name, F.col(base) + k * F.col("_m")).drop("_m")


def prefix_tangent(table: DataFrame, key: str, base: str, position: str, level: str, elevation: str, known: str, name: str = "prefix_boundary", window: float = 256.0, tau: float = 256.0, alpha: float = 1.0, rms_cap: float = 2.5, row_cap: float = 10.0, least_rows: int = 8) -> DataFrame:
    """Hidden rows only: blends in the tangent of the visible part, fading with distance.

    The slope is that of least squares through the last visible row over the last ``window`` of ``position``; 0 for fewer
    than ``least_rows``. ``level`` is the visible coordinate; level plus elevation is what runs smoothly.
    """
    w, vis = whole(key), F.col(known)
    t = table.withColumn("_u", F.when(vis, F.col(level) + F.col(elevation)))
    at = F.when(vis, F.col("rn"))
    t = t.withColumns({"_p0": F.max_by(position, at).over(w), "_u0": F.max_by("_u", at).over(w)})
    use = vis & (F.col(position) >= F.col("_p0") - window)
    dx, dy = F.when(use, F.col(position) - F.col("_p0")), F.when(use, F.col("_u") - F.col("_u0"))
    t = t.withColumns({"_n": F.count_if(use).over(w), "_xx": F.sum(dx * dx).over(w), "_xy": F.sum(dx * dy).over(w)})
    slope = F.when((F.col("_n") >= least_rows) & (F.col("_xx") > SMALL), F.col("_xy") / F.col("_xx")).otherwise(F.lit(0.0))
    h = F.col(position) - F.col("_p0")
    gap = F.col("_u0") + slope * h - (F.col(base) + F.col(elevation))
    t = t.withColumn("_r", F.col(base) + alpha * clip(F.exp(-h / tau) * gap, -row_cap, row_cap)).where(~vis)
    return radial(t, key, base, "_r", name, rms_cap, row_cap).drop("_u", "_p0", "_u0", "_n", "_xx", "_xy", "_r")


def centered_shape(table: DataFrame, key: str, base: str, filtered: str, grid: str, name: str = "shape", alpha: float = 0.25, amplitude: float = 6.41825, slope: float = 0.0090056, rms_cap: float = 0.75, row_cap: float = 2.5) -> DataFrame:
    """Adds a part of the centered difference of two experts, more where it is small and changes fast."""
    t = table.withColumn("_d", F.col(grid) - F.col(filtered))
    t = t.withColumns({"_s": F.col("_d") - F.lag("_d").over(ordered(key)), "_a": _rms(F.col("_d"), key), "_c": F.col("_d") - F.avg("_d").over(whole(key))})
    info = F.coalesce(_rms(F.col("_s"), key), F.lit(0.0)) / at_least(F.col("_a"))
    gate = 1 / (1 + F.pow(F.col("_a") / amplitude, 2)) * info / (info + slope)
    t = t.withColumn("_r", F.col(base) + alpha * gate * F.col("_c"))
    return radial(t, key, base, "_r", name, rms_cap, row_cap).drop("_d", "_s", "_a", "_c", "_r")


def fixed_blend(table: DataFrame, parent: str, weights: dict[str, float], name: str) -> DataFrame:
    """The parent with fixed parts of each arm's move from it."""
    moved = sum((w * (F.col(a) - F.col(parent)) for a, w in weights.items()), F.lit(0.0))
    return table.withColumn(name, F.col(parent) + moved)


def routed(table: DataFrame, choice: DataFrame, key: str, fallback: str, arms: list[str], blend: float, name: str) -> DataFrame:
    """``choice``: ``(key, arm)``; each series takes ``blend`` of the way to its arm, or stays at the fallback."""
    arm = F.coalesce(*(F.when(F.col("_arm") == a, F.col(a)) for a in arms), F.col(fallback))
    t = table.join(choice.select(key, F.col("arm").alias("_arm")), key, "left")
    return t.withColumn(name, F.col(fallback) + blend * (arm - F.col(fallback))).drop("_arm")


