"""Whole studies: settings chosen by cross-fit on one panel and frozen for another, nested routing, registered panels and runs.

Every score of a blend follows from ``blending.Moments``, a record for each group, so a panel is aggregated once however many
settings, seeds and folds are tried; frozen weights are applied to the other panel as a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import experts, groups, metrics, overlays
from cairn.operators.checks import CheckFailure
from cairn.plans import blending
from cairn.plans.staging import Stage
from cairn.sources import files

#: Seeds, folds and settings of the registered studies.
SEEDS, FOLDS = (3101, 7727, 19001), 5
ROBUST = tuple((macro, tail, ridge) for macro in (0.0, 0.5, 1.0) for tail in (0.0, 0.5, 2.0) for ridge in (0.01, 0.10))
TRUST = tuple((cap, 0.25, 0.25, 0.10) for cap in (0.0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25))


@dataclass(frozen=True)
class Kind:
    """A family of blends: how weights follow from moments and a setting, how scores weigh, and which setting wins a tie."""

    settings: tuple
    solve: Callable[[blending.Moments, tuple], np.ndarray]
    shares: tuple[float, float, float]
    tie: Callable[[tuple], tuple]
    squares: bool
    rule: str


GROUP_ROBUST = Kind(ROBUST, lambda m, s: blending.solve_robust(m, *s, steps=1500), (0.5, 0.25, 0.25), lambda s: (-s[1], -s[0], s[2]), False, "draw")
TRUST_REGION = Kind(TRUST, lambda m, s: np.array([blending.solve_trust_region(m, *s)]), (0.6, 0.2, 0.2), lambda s: (s[0], s[2]), True, "draw_by_size")


@dataclass
class Transfer:
    """``grid``: ``(setting, mean, std)`` in order of choice; ``weights`` frozen for the target; scores of the parent and the frozen blend there."""

    setting: tuple
    grid: list[tuple[tuple, float, float]]
    weights: dict[str, float]
    source: tuple[float, float, float]
    parent: tuple[float, float, float]
    frozen: tuple[float, float, float]


def cross_fitted(m: blending.Moments, kind: Kind, setting: tuple, seed: int, folds: int = FOLDS) -> np.ndarray:
    """Mean squares of each group under weights that were fitted without its fold."""
    fold_of = blending.assign(dict(zip(m.groups, m.n)), folds, kind.rule, seed)
    fold, out = np.array([fold_of[g] for g in m.groups]), np.empty(len(m.n))
    for k in range(folds):
        own = fold == k
        out[own] = m.take(own).mse(kind.solve(m.take(~own), setting))
    return out


def _tried(spark: SparkSession, m: blending.Moments, kind: Kind, seeds: Sequence[int], folds: int, shares_of: tuple[float, float, float]) -> dict[tuple[int, int], float]:
    """Score of each setting and seed, by their numbers: a row each, solved in tasks from the moments, which are broadcast."""
    shared = spark.sparkContext.broadcast((m, tuple(seeds)))  # a record for each group
    cases = [(i, j) for i in range(len(kind.settings)) for j in range(len(seeds))]

    def run(parts):
        own, drawn = shared.value
        for p in parts:
            value = []
            for i, j in zip(p["i"], p["j"]):
                s = blending.scores(own, mse=cross_fitted(own, kind, kind.settings[i], drawn[j], folds), squares=kind.squares)
                value.append(sum(share * a / b for share, a, b in zip(kind.shares, s, shares_of)))
            yield p.assign(value=value)

    table = spark.createDataFrame(cases, "i int, j int").repartition(len(cases), "i", "j")
    return {(r.i, r.j): r.value for r in table.mapInPandas(run, "i int, j int, value double").collect()}


def transfer(spark: SparkSession, source: blending.Moments, target: blending.Moments, arms: Sequence[str], kind: Kind, seeds: Sequence[int] = SEEDS, folds: int = FOLDS) -> Transfer:
    """Chooses a setting by cross-fitted scores on the source, fits it there once more and scores it frozen on the target."""
    base = blending.scores(source, np.zeros(len(arms)), squares=kind.squares)
    tried = _tried(spark, source, kind, seeds, folds, base)
    each = {s: [tried[i, j] for j in range(len(seeds))] for i, s in enumerate(kind.settings)}
    grid = sorted(((s, float(np.mean(v)), float(np.std(v))) for s, v in each.items()), key=lambda row: (row[1], row[2], kind.tie(row[0])))
    setting = grid[0][0]
    w = kind.solve(source, setting)
    return Transfer(setting, grid, dict(zip(arms, w.tolist())), base, blending.scores(target, np.zeros(len(arms)), squares=kind.squares), blending.scores(target, w, squares=kind.squares))


def both_ways(a: DataFrame, b: DataFrame, arms: Sequence[str], parent: str, kind: Kind, draws: int = 0) -> dict[str, tuple[Transfer, DataFrame | None]]:
    """Each panel as source and as target; with ``draws`` also the bootstrap of the frozen gain on the target. A panel of fewer groups
    than ``FOLDS`` has a fold for each."""
    moments = {n: blending.group_moments(p, arms, parent) for n, p in (("a", a), ("b", b))}
    out = {}
    for s, t, panel in (("a", "b", b), ("b", "a", a)):
        made = transfer(a.sparkSession, moments[s], moments[t], arms, kind, folds=min(FOLDS, len(moments[s].n)))
        gain = metrics.bootstrap(overlays.fixed_blend(panel, parent, made.weights, "frozen"), "component", parent, "frozen", draws) if draws else None
        out[f"{s}_to_{t}"] = (made, gain)
    return out


def unit_moments(panel: DataFrame, arms: Sequence[str], fallback: str, unit: str = "well") -> DataFrame:
    """``(unit, n, rr, c_<arm>, g_<arm>)``: what the error of any blend of one arm needs, by unit."""
    left = F.col("truth") - F.col(fallback)
    move = {a: F.col(a) - F.col(fallback) for a in arms}
    return panel.groupBy(unit).agg(F.count("*").alias("n"), F.avg(left * left).alias("rr"), *(F.avg(m * left).alias(f"c_{a}") for a, m in move.items()), *(F.avg(m * m).alias(f"g_{a}") for a, m in move.items()))


# --- frozen arms, registered panels, resumable runs, dispatch ----------------------------------------------------------------


def frozen_arm(series: DataFrame, curves: DataFrame, truth: DataFrame, chosen: str, arm: str, seeds: Sequence[int], settings=None, draws: int = 200) -> tuple[DataFrame, DataFrame]:
    """Predictions and gain of the one arm that the development panel selected; any other is refused. Truth joins after prediction."""
    if arm != chosen:
        raise CheckFailure(f"{arm!r} is not the selected arm {chosen!r}")
    rates = experts.start_rates(series)
    own = rates.where(F.col("arm") == arm)
    if own.isEmpty():
        raise CheckFailure(f"unknown arm {arm!r}")
    more = {} if settings is None else {"settings": settings}
    made = experts.by_likelihood(experts.particle_paths(series, curves, seeds, rates=own, **more)).select("well", "row_number", F.col("tvt").alias("candidate"))
    base = experts.by_likelihood(experts.particle_paths(series, curves, seeds, **more)).select("well", "row_number", F.col("tvt").alias("reference"))
    scored = Stage(series.sparkSession, "frozen").put(made.join(base, ["well", "row_number"]).join(truth, ["well", "row_number"]))  # read for the gain and by the caller
    return scored, metrics.bootstrap(scored, "well", "reference", "candidate", draws)


def _whole_groups(units: DataFrame, most: int, seed: int, how: str) -> DataFrame:
    chosen = groups.whole_groups(units.groupBy("component").agg(F.count("*").alias("n")), "component", "n", most, seed)
    return units.join(chosen, "component", how).select(units.columns)


def register_panel(universe: DataFrame, prior: DataFrame, most: int, seed: int, root: str, data_digest: str, least_groups: int = 10) -> dict:
    """Registers, before any scoring, a panel of whole groups that hold no unit of ``prior``; ``universe``: ``(well, component)``.

    Writes universe, panel and a manifest below ``root``. Called again it verifies what is there and returns it; other data are refused.
    """
    spark = universe.sparkSession
    at = f"{root.rstrip('/')}/registration"
    known = spark.createDataFrame([(f"{at}/summary.json",)], "p string")
    if _exists(spark, known.first().p):
        return verified_registration(spark, root, data_digest)
    touched = universe.join(prior.select("well"), "well", "left_semi").select("component").distinct()
    eligible = universe.join(touched, "component", "left_anti")
    panel = Stage(spark, "register").put(_whole_groups(eligible, most, seed, "left_semi"))
    units, n = panel.agg(F.count("*"), F.count_distinct("component")).first()
    if n < least_groups:
        raise CheckFailure(f"the panel has {n} groups only")
    summary = {"status": "REGISTERED_BEFORE_SCORING", "data_sha256": data_digest, "seed": seed, "units": units, "groups": n, "selection_uses_target_columns": False}
    files.write_result({"universe": universe.select("well", "component"), "panel": panel.select("well", "component")}, summary, at)
    return summary


def verified_registration(spark: SparkSession, root: str, data_digest: str) -> dict:
    at = f"{root.rstrip('/')}/registration"
    bad = [f"{r.name} {r.problem}" for r in files.verify_result(spark, at).collect()]
    found = files.load_json(spark, f"{at}/summary.json")
    if bad or found["status"] != "REGISTERED_BEFORE_SCORING" or found["data_sha256"] != data_digest:
        raise CheckFailure("registration does not verify: " + ", ".join(bad or ["other data or status"]))
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resumable_runs(spark: SparkSession, root: str, data_digest: str, seeds: Sequence[int], run: Callable[[int], tuple[dict[str, DataFrame], dict]]) -> list[tuple[int, str]]:
    """Runs each seed once against a registered panel: a finished run is verified and kept, any other is made and written with its manifest.
    ``(seed, made or kept)``."""
    verified_registration(spark, root, data_digest)
    out = []
    for seed in seeds:
        at = f"{root.rstrip('/')}/seed-{seed}"
        if _exists(spark, f"{at}/manifest.json"):
            if files.verify_result(spark, at).count() or files.load_json(spark, f"{at}/summary.json").get("seed") != seed:
                raise CheckFailure(f"{at} does not verify")
            out.append((seed, "kept"))
            continue
        tables, summary = run(seed)
        files.remove(spark, at)  # what a lost run has left
        files.write_result(tables, {**summary, "seed": seed}, at)
        out.append((seed, "made"))
    return out


def subset(universe: DataFrame, most: int | None, role: str, seed: int) -> DataFrame:
    """The units of a full run: all, the primary sample of whole groups, or its complement. ``universe``: ``(well, component)``."""
    if role not in ("all", "primary", "complement"):
        raise ValueError(f"unknown subset {role!r}")
    if most is None or role == "all":
        return universe
    return _whole_groups(universe, most, seed, "left_semi" if role == "primary" else "left_anti")


def dispatch(spark: SparkSession, mode: str, run: Callable[[DataFrame, DataFrame, DataFrame], object], data: tuple[DataFrame, DataFrame, DataFrame] | None = None, universe: DataFrame | None = None, most: int | None = None, role: str = "all", seed: int = 0, wells: int = 18, rows: int = 180) -> object:
    """``smoke``: ``run`` on synthetic logs; ``full``: on the chosen subset of ``data`` (series, curves, truth)."""
    if mode == "smoke":
        logs, curves = files.synthetic_logs(spark, wells, rows, seed)
        truth = logs.where("TVT_input is null").select("well", "row_number", F.col("TVT").alias("truth"))
        return run(logs.drop("TVT", *files.TOPS), curves, truth)
    if mode != "full":
        raise ValueError(f"unknown mode {mode!r}")
    if data is None:
        raise ValueError("a full run needs data")
    if universe is None:
        return run(*data)
    own = subset(universe, most, role, seed).select(F.col("well").alias("_own"))
    return run(*(t.join(own, t["well"] == own["_own"], "left_semi") for t in data))
