"""The nested experiment: experts once for each series, group-disjoint folds, arms, a stack, and scores with intervals.

Expert paths are the costly part and depend on no fold, so they are computed once and staged. Truth is a table of its own that
only fitting and scoring join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.grid import GridSettings
from cairn.functions.particles import FilterSettings
from cairn.operators import experts, joins, metrics, ordered, overlays
from cairn.operators import groups as whole
from cairn.plans import blending, boosting, features
from cairn.plans.staging import Stage

#: Arms in their order, and those the stack may mix.
ARMS = ("pf", "ridge", "nonlinear", "incumbent", "hgrg", "meta_state", "prefix_boundary", "sequential_final")
STACK = ("hgrg", "meta_state", "prefix_boundary", "sequential_final")


@dataclass(frozen=True)
class Config:
    seeds: int = 8
    particles: int = 500
    seed_offset: int = 0
    folds: int = 3
    holdout: float = 0.2
    split_seed: int = 0
    stack_ridge: float = 0.01
    draws: int = 200
    spatial_radius: float = 250.0
    similarity_radius: float = 2500.0
    similarity: float = 0.995
    trees: int = 80
    leaves: int = 31
    rate: float = 0.05
    l2: float = 1.0
    grid: GridSettings = field(default_factory=GridSettings)

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type in ("int", "float") and (isinstance(v, bool) or not isinstance(v, int if f.type == "int" else (int, float))):
                raise TypeError(f"{f.name} must be {f.type}")
        if self.seeds < 2 or self.particles < 8 or self.folds < 2 or not 0 <= self.holdout < 1 or min(self.stack_ridge, self.spatial_radius, self.similarity_radius) < 0 or not 0 <= self.seed_offset <= 0xFFFFFFFF - self.seeds:
            raise ValueError("configuration out of range")


#: The ranges that ``Config`` holds its values to, as conditions on a table of settings.
RANGES = {"seeds": "seeds >= 2", "particles": "particles >= 8", "folds": "folds >= 2", "holdout": "holdout >= 0 AND holdout < 1", "stack_ridge": "stack_ridge >= 0", "spatial_radius": "spatial_radius >= 0", "similarity_radius": "similarity_radius >= 0", "seed_offset": "seed_offset >= 0 AND seed_offset + seeds <= 4294967295"}


def config_violations(settings: DataFrame) -> DataFrame:
    """A row ``(*columns, rule)`` for each range that a row of settings is out of or has no value for; columns that are not there keep their default."""
    kinds = {f.name: f.default for f in fields(Config)}
    t = settings.withColumns({k: F.lit(v) for k, v in kinds.items() if k in RANGES and k not in settings.columns})
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in RANGES.items())))
    return t.withColumn("rule", F.explode(broken)).select(*settings.columns, "rule")


def components(series: DataFrame, curves: DataFrame, c: Config) -> DataFrame:
    """``(well, component, degree)``: series that lie close, or less close with alike signals or curves, belong together."""
    rows = series.withColumnRenamed("row_number", "rn")
    place = rows.groupBy("well").agg(F.median("X").alias("x"), F.median("Y").alias("y"), F.count("*").alias("rows"))
    own = ordered.fingerprint(rows, "well", "GR").withColumnRenamed("shape", "f1")
    other = ordered.fingerprint(curves.withColumnRenamed("row_number", "rn"), "well", "GR").withColumnRenamed("shape", "f2")
    points = place.join(own, "well").join(other, "well")
    edges = joins.similarity_edges(points, "well", "x", "y", "f1", "f2", c.spatial_radius, c.similarity_radius, c.similarity, 64)
    return joins.labelled_components(place, "well", edges).join(place.select("well", "rows"), "well")


def physics(series: DataFrame, curves: DataFrame, c: Config) -> DataFrame:
    """``(well, row_number, pf, pf_std, hmm)`` of hidden rows."""
    paths = experts.particle_paths(series, curves, range(c.seed_offset, c.seed_offset + c.seeds), FilterSettings(particles=c.particles))
    pf = experts.by_likelihood(paths, 8.0, min(c.seeds, max(2, c.seeds / 2))).select("well", "row_number", F.col("tvt").alias("pf"), F.col("spread").alias("pf_std"))
    return pf.join(experts.grid_paths(series, curves, c.grid).select("well", "row_number", F.col("tvt").alias("hmm")), ["well", "row_number"])


def prepare(series: DataFrame, curves: DataFrame, c: Config) -> DataFrame:
    """All rows of all series with experts and features on hidden ones; no truth."""
    seen = experts.observable(series)
    t = seen.join(physics(series, curves, c), ["well", "row_number"], "left").withColumnsRenamed({"row_number": "rn", "MD": "md", "X": "x", "Y": "y", "Z": "z", "GR": "gr", "TVT_input": "tvt"})
    made = features.build(t, curves.select("well", F.col("TVT").alias("tvt"), F.col("GR").alias("gr")))
    clash = {k: f"f_{k}" for k in made.columns if k not in ("well", "rn")}
    return t.join(made.withColumnsRenamed(clash), ["well", "rn"], "left")


@dataclass
class Models:
    ridge: blending.Ridge
    trees: boosting.Boosted
    names: list[str]


def fit(rows: DataFrame, truth: DataFrame, c: Config) -> Models:
    """Ridge and boosted trees on ``truth - pf``."""
    names = [k for k in rows.columns if k.startswith("f_")]
    t = rows.where("tvt is null").join(truth, ["well", "rn"]).withColumn("residual", F.col("truth") - F.col("pf")).persist()
    try:
        least = max(8, min(30, t.count() // 20))
        trees = boosting.fit(t, names, "residual", c.trees, c.leaves, c.rate, c.l2, least)
        return Models(blending.ridge_by_moments(t, names, "residual"), trees, names)
    finally:
        t.unpersist()


def predict(rows: DataFrame, models: Models, table: DataFrame) -> DataFrame:
    """``(well, rn, horizon, <arms>)`` for hidden rows. ``table``: anchors of the training series."""
    t = rows.where("tvt is null").withColumns({"ridge": F.col("pf") + blending.ridge_column(models.ridge, models.names), "nonlinear": F.col("pf") + models.trees.column(models.names)})
    t = t.select("well", "rn", "x", "y", "z", "md", F.col("f_md_since").alias("horizon"), "pf", "hmm", "ridge", "nonlinear")
    t = overlays.parent_blend(t, "well", "ridge", "pf", "nonlinear")
    t = overlays.bridge(t, "well", "incumbent", "ridge", "pf", "hmm", "horizon")
    raw = rows.select("well", F.col("rn").alias("row_number"), F.col("md").alias("MD"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("gr").alias("GR"), F.col("tvt").alias("TVT_input"))
    surface = experts.structural_paths(raw, table).withColumnRenamed("row_number", "rn")
    t = t.join(surface, ["well", "rn"])
    meta = experts.fused(t.withColumnRenamed("rn", "row_number")).select("well", F.col("row_number").alias("rn"), "meta_state")
    t = t.join(meta, ["well", "rn"])
    full = rows.select("well", "rn", "md", "z", "tvt").join(t.select("well", "rn", "meta_state"), ["well", "rn"], "left").withColumn("known", F.col("tvt").isNotNull())
    edge = overlays.prefix_tangent(full, "well", "meta_state", "md", "tvt", "z", "known").select("well", "rn", "prefix_boundary")
    return overlays.centered_shape(t.join(edge, ["well", "rn"]), "well", "prefix_boundary", "pf", "hmm", "sequential_final").select("well", "rn", "horizon", *ARMS)


@dataclass
class Result:
    predictions: DataFrame
    scoreboard: DataFrame
    interval: DataFrame
    components: DataFrame
    stacks: dict[str, blending.Blend]


def run(series: DataFrame, curves: DataFrame, truth: DataFrame, c: Config = Config()) -> Result:
    """``truth``: ``(well, row_number, truth)`` of hidden rows. Out-of-fold predictions of development groups, then one refit for the
    holdout; every stack is fitted on predictions that no model in it was trained on."""
    spark = series.sparkSession
    stage = Stage(spark, "experiment")
    groups = stage.put(components(series, curves, c))
    rows = stage.put(prepare(series, curves, c).join(groups.select("well", "component"), "well"))
    truth = truth.withColumnRenamed("row_number", "rn")
    levels = experts.anchors(series)
    sizes = groups.groupBy("component").agg(F.sum("rows").alias("rows"))
    of = stage.put(whole.holdout_and_folds(sizes, "component", "rows", c.holdout, c.folds, c.split_seed).select("component", "fold"))
    out = of.where("fold = -1").limit(1).count()
    rows = rows.join(of, "component")
    placed = levels.join(groups.select("well", "component"), "well").join(of, "component")

    def part(train, test) -> DataFrame:
        use = rows.where(train).drop("component", "fold")
        return stage.put(predict(rows.where(test).drop("component", "fold"), fit(use, truth, c), placed.where(train).select("well", "x", "y", "level")))

    parts = {k: part((F.col("fold") >= 0) & (F.col("fold") != k), F.col("fold") == k) for k in range(c.folds)}
    hold = part(F.col("fold") >= 0, F.col("fold") == -1) if out else None
    keyed = rows.select("well", "component").distinct()
    scored = lambda t: t.join(truth, ["well", "rn"]).join(keyed, "well")
    stacks, made = {}, []
    for k, t in [*parts.items(), *([("holdout", hold)] if hold is not None else [])]:
        others = [x for j, x in parts.items() if j != k]
        panel = scored(others[0])
        for x in others[1:]:
            panel = panel.unionByName(scored(x))
        stacks[str(k)] = blending.fit_stack(panel, STACK, "incumbent", c.stack_ridge)
        made.append(overlays.fixed_blend(scored(t), "incumbent", stacks[str(k)].weights, "nested_stack").withColumn("split", F.lit("holdout" if k == "holdout" else "oof")))
    predictions = made[0]
    for t in made[1:]:
        predictions = predictions.unionByName(t)
    predictions = stage.put(predictions.withColumn("row_id", F.concat_ws("_", "well", "rn")))
    oof = predictions.where("split = 'oof'")
    board = metrics.model_metrics(oof, [*ARMS, "nested_stack"], "incumbent")
    return Result(predictions, board, metrics.bootstrap(oof, "component", "incumbent", "sequential_final", c.draws), groups, stacks)


def deploy(train: tuple[DataFrame, DataFrame, DataFrame], series: DataFrame, curves: DataFrame, stack: blending.Blend, c: Config = Config()) -> DataFrame:
    """``(id, tvt)`` for hidden rows of new series from models fitted on ``train`` (series, curves, truth); input with truth is refused."""
    if "TVT" in series.columns:
        raise ValueError("input for prediction must not hold TVT")
    own, ref, truth = train
    models = fit(prepare(own, ref, c), truth.withColumnRenamed("row_number", "rn"), c)
    t = predict(prepare(series, curves, c), models, experts.anchors(own))
    t = overlays.fixed_blend(t, stack.parent, stack.weights, "tvt")
    return t.select(F.concat_ws("_", "well", "rn").alias("id"), "tvt", "well", "rn")


def arms_grid(series: DataFrame, curves: DataFrame, truth: DataFrame, seeds: Sequence[int], settings: FilterSettings, **grid) -> DataFrame:
    """Scores of every initial-rate arm: ``(arm, rmse, wells)`` in order. Arms that start alike run once."""
    paths = experts.particle_paths(series, curves, seeds, settings, experts.start_rates(series, **grid))
    t = experts.by_likelihood(paths).join(truth, ["well", "row_number"])
    return t.groupBy("arm").agg(metrics.rmse("truth", "tvt").alias("rmse"), F.count_distinct("well").alias("wells")).orderBy("rmse", "arm")
