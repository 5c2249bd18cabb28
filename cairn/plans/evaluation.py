"""Evaluation of registered contracts: panels with splits, checks, metrics at every grain, resampled ranks, one union of each.

A contract is one ``(panel, split)`` with its models; a registry is a list of them with common bins, tail and resampling.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import finite
from cairn.operators import checks, metrics


@dataclass(frozen=True)
class Contract:
    id: str
    panel: str
    split: str
    models: tuple[str, ...]
    baseline: str

    def __post_init__(self) -> None:
        if self.baseline not in self.models or len(set(self.models)) != len(self.models):
            raise ValueError(f"{self.id}: the baseline must be among the models, and each model once")
        if self.split not in ("oof", "holdout"):
            raise ValueError(f"{self.id}: unknown split {self.split!r}")


@dataclass(frozen=True)
class Registry:
    contracts: tuple[Contract, ...]
    bounds: tuple[float, ...]
    fraction: float = 0.1
    draws: int = 200

    def __post_init__(self) -> None:
        if len({c.id for c in self.contracts}) != len(self.contracts) or not self.contracts:
            raise ValueError("contracts need distinct ids")
        if list(self.bounds) != sorted(set(self.bounds)) or not 0 < self.fraction <= 1 or self.draws < 1:
            raise ValueError("bounds must increase, the fraction lie in (0, 1], and draws be positive")

    @classmethod
    def from_dict(cls, d: dict) -> Registry:
        return cls(tuple(Contract(c["id"], c["panel"], c["split"], tuple(c["models"]), c["baseline"]) for c in d["contracts"]), tuple(map(float, d["bounds"])), float(d.get("fraction", 0.1)), int(d.get("draws", 200)))


def contract_violations(contracts: DataFrame) -> DataFrame:
    """``(key, rule)`` of a table of contracts ``(key, id, models, baseline)``: ids that repeat, models that repeat or are none, and baselines that are
    no model of their contract."""
    n = F.count("*").over(Window.partitionBy("id"))
    rules = {"id_repeats": n > 1, "models_repeat": F.size(F.array_distinct("models")) < F.size("models"), "no_models": F.coalesce(F.size("models"), F.lit(0)) < 1, "baseline_is_no_model": ~F.coalesce(F.array_contains("models", F.col("baseline")), F.lit(False))}
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return contracts.withColumn("_broken", broken).select("key", F.explode("_broken").alias("rule"))


def panel_checks(panel: DataFrame, c: Contract) -> DataFrame:
    """``panel``: ``row_id, well, row_number, component, horizon, truth, <models>`` and for ``oof`` a ``fold``."""
    bad = sum((F.count_if(~finite(F.col(m))) for m in (*c.models, "truth")), F.lit(0))
    out = [
        checks.unique(panel, c.id, "row_id_unique", ["row_id"]), checks.unique(panel, c.id, "well_row_unique", ["well", "row_number"]),
        checks.one_value(panel, c.id, "one_component_for_each_well", "well", "component"), checks.check(panel, c.id, "horizon_not_negative", F.count_if(F.col("horizon") < 0)),
        checks.check(panel, c.id, "values_finite", bad), checks.check(panel.limit(1), c.id, "not_empty", 1 - F.count("*")),
    ]
    if "fold" in panel.columns:
        out.append(checks.one_value(panel, c.id, "one_fold_for_each_component", "component", "fold"))
    return checks.log(*out)


@dataclass
class Evaluation:
    checks: DataFrame
    models: DataFrame
    components: DataFrame
    wells: DataFrame
    horizons: DataFrame
    folds: DataFrame | None
    stability: DataFrame


def evaluate(panels: dict[str, DataFrame], registry: Registry, fail: bool = True) -> Evaluation:
    """All tables of all contracts; with ``fail`` nothing is computed unless every check passes."""
    own = {c.id: panels[c.id] for c in registry.contracts}
    logs = [panel_checks(own[c.id], c) for c in registry.contracts]
    for a, b in combinations(registry.contracts, 2):
        if a.panel == b.panel and a.split != b.split:
            logs.append(checks.disjoint(own[a.id], own[b.id], f"{a.id}|{b.id}", "components_disjoint", ["component"]))
    log = checks.log(*logs)
    if fail:
        checks.require(log)
    made: dict[str, list[DataFrame]] = {k: [] for k in ("models", "components", "wells", "horizons", "folds", "stability")}
    for c in registry.contracts:
        p, tag = own[c.id], lambda t, c=c: t.withColumn("contract", F.lit(c.id))
        groups = metrics.group_metrics(p, "component", c.models, c.baseline, [F.count_distinct("well").alias("wells")])
        made["models"].append(tag(metrics.model_metrics(p, c.models, c.baseline, fraction=registry.fraction)))
        made["components"].append(tag(metrics.mark_worst(groups, ["model"], "rmse", "component", registry.fraction)))
        made["wells"].append(tag(metrics.group_metrics(p, "well", c.models, c.baseline, [F.min("component").alias("component")])))
        made["horizons"].append(tag(metrics.horizon_metrics(p, c.models, c.baseline, registry.bounds)))
        if "fold" in p.columns:
            made["folds"].append(tag(metrics.fold_metrics(p, c.models, c.baseline)))
        draws = metrics.bootstrap_ranks(metrics.group_rmse_wide(p, ["component"], c.models), c.models, c.baseline, registry.draws)
        made["stability"].append(tag(metrics.rank_summary(draws)).withColumn("scope", F.lit("component_bootstrap")))
    union = lambda ts: reduce(DataFrame.unionByName, ts) if ts else None
    return Evaluation(log, *(union(made[k]) for k in ("models", "components", "wells", "horizons", "folds", "stability")))


def grouped_scores(panel: DataFrame, arms: list[str], truth: str = "truth") -> DataFrame:
    """Errors by component, by well and over all rows from one pass by ``GROUPING SETS``: ``(grain, component, well, model, n, rmse)``."""
    sums = ", ".join(f"sum(pow({truth} - `{a}`, 2)) AS `{a}`" for a in arms)
    t = panel.sparkSession.sql(f"SELECT grouping_id() AS g, component, well, count(*) AS n, {sums} FROM {{p}} GROUP BY GROUPING SETS ((component, well), (component), ())", p=panel)
    grain = F.when(F.col("g") == 0, "well").when(F.col("g") == 1, "component").otherwise("all")
    return metrics.long(t.withColumn("grain", grain).drop("g"), ["grain", "component", "well", "n"], arms, "sse").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n"))).drop("sse")


def refits(runs: dict[int, DataFrame], parent: str, candidate: str, draws: int, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For refits of one contract under different seeds: metrics of each, the crossed interval over seeds and components, and the
    decision. All runs must have the same rows and the same truth."""
    first, rest = next(iter(runs)), list(runs)[1:]
    logs = []
    for k in rest:
        both = runs[first].select("row_id", F.col("truth").alias("a")).join(runs[k].select("row_id", F.col("truth").alias("b")), "row_id", "full")
        logs.append(checks.check(both, f"refit_{k}", "rows_and_truth_agree", F.count_if(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))))
    if logs:
        checks.require(checks.log(*logs))
    each = reduce(DataFrame.unionByName, [metrics.refit_metrics(t, parent, candidate).withColumn("seed", F.lit(k)) for k, t in runs.items()])
    stats = reduce(DataFrame.unionByName, [t.groupBy("component").agg(F.count("*").alias("n"), F.sum(metrics.squared("truth", parent)).alias("ref"), F.sum(metrics.squared("truth", candidate)).alias("cand")).withColumn("seed", F.lit(k)) for k, t in runs.items()])
    return each, metrics.interval(metrics.crossed_bootstrap(stats, draws)), metrics.promotion(each)
