"""Error metrics at several grains, tail risk, ranks, and resampling of whole groups.

A panel has a row for each prediction with its truth and one column for each arm (model). One aggregate takes it to sums
of squares by the finest grain asked for; every other metric follows from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import EPS, average_rank, close, interval_label, tail_size, uniform_index
from cairn.operators.joins import numbered


def squared(truth: str, arm: str) -> Column:
    return F.pow(F.col(truth) - F.col(arm), 2)


def rmse(truth: str, arm: str) -> Column:
    """Aggregate: root mean square of the difference."""
    return F.sqrt(F.avg(squared(truth, arm)))


def cells(panel: DataFrame, by: Sequence[str], arms: Sequence[str], truth: str = "truth") -> DataFrame:
    """``(*by, n, <arm> …)`` where each arm's column is its sum of squared errors."""
    return panel.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(squared(truth, a)).alias(a) for a in arms))


def long(table: DataFrame, keys: Sequence[str], arms: Sequence[str], value: str) -> DataFrame:
    return table.unpivot([*keys], [*arms], "model", value)


def group_rmse_wide(panel: DataFrame, by: Sequence[str], arms: Sequence[str], truth: str = "truth") -> DataFrame:
    return panel.groupBy(*by).agg(*(rmse(truth, a).alias(a) for a in arms))


def group_metrics(panel: DataFrame, group: str, arms: Sequence[str], baseline: str, also: Sequence[Column] = (), truth: str = "truth") -> DataFrame:
    """``(group, rows, *also, model, rmse, baseline_rmse, gain)`` by one aggregate; ``also``: named aggregates of the group."""
    wide = panel.groupBy(group).agg(F.count("*").alias("rows"), *also, rmse(truth, baseline).alias("baseline_rmse"), *(rmse(truth, a).alias(a) for a in arms))
    rest = [c for c in wide.columns if c not in arms]
    return long(wide, rest, arms, "rmse").withColumn("gain", F.col("baseline_rmse") - F.col("rmse"))


def tail_mean(table: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str, of_squares: bool = False) -> DataFrame:
    """Mean of the worst ``max(1, ceil(fraction * size))`` values of a group; ``of_squares``: the root of that mean.

    The two are different measures: the first averages root errors, the second averages squared errors.
    """
    w = Window.partitionBy(*keys)
    worst = table.select(*keys, value, F.row_number().over(w.orderBy(F.col(value).desc())).alias("_r"), F.count("*").over(w).alias("_n"))
    mean = F.avg(value)
    return worst.where(F.col("_r") <= tail_size(fraction, F.col("_n"))).groupBy(*keys).agg((F.sqrt(mean) if of_squares else mean).alias(name))


def model_metrics(panel: DataFrame, arms: Sequence[str], baseline: str, unit: str = "well", group: str = "component", fraction: float = 0.1, truth: str = "truth") -> DataFrame:
    """The scoreboard: one row for each model with pooled, macro, tail, harm and rank columns."""
    base = cells(panel, [group, unit], arms, truth)
    sums = lambda by: base.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(a).alias(a) for a in arms))

    def roots(t: DataFrame, keys: list[str]) -> DataFrame:
        wide = t.select(*keys, "n", F.sqrt(F.col(baseline) / F.col("n")).alias("base"), *(F.sqrt(F.col(a) / F.col("n")).alias(a) for a in arms))
        return long(wide, [*keys, "n", "base"], arms, "rmse").withColumn("gain", F.col("base") - F.col("rmse"))

    units, groups, whole = roots(sums([unit]), [unit]), roots(sums([group]), [group]), roots(sums([]), [])
    harmed = lambda c: F.avg((F.col(c) < -EPS).cast("double"))
    by_unit = units.groupBy("model").agg(F.count("*").alias("wells"), F.avg("rmse").alias("macro_well_rmse"), harmed("gain").alias("harmed_well_rate"), F.avg("gain").alias("mean_well_gain"), F.median("gain").alias("median_well_gain"))
    by_group = groups.groupBy("model").agg(F.count("*").alias("components"), F.avg("rmse").alias("macro_component_rmse"), harmed("gain").alias("harmed_component_rate"), F.max("rmse").alias("worst_component_rmse"))
    tail = tail_mean(groups, ["model"], "rmse", fraction, "tail_rmse")
    out = whole.select("model", F.col("n").alias("rows"), F.col("rmse").alias("pooled_rmse"), F.col("gain").alias("pooled_gain")).join(by_unit, "model").join(by_group, "model").join(tail, "model")
    for c in ("pooled_rmse", "macro_well_rmse", "macro_component_rmse", "tail_rmse"):
        out = out.withColumn(f"rank_{c}", average_rank([], c))
    return out.withColumn("tail_components", tail_size(fraction, F.col("components")).cast("bigint"))


def mark_worst(groups: DataFrame, keys: Sequence[str], value: str, name: str, fraction: float = 0.1) -> DataFrame:
    """Adds ``worst_rank``, 1 for the largest value with ties by ``name``, and ``in_tail``."""
    w = Window.partitionBy(*keys)
    ranked = groups.withColumn("worst_rank", F.row_number().over(w.orderBy(F.col(value).desc(), name)))
    return ranked.withColumn("in_tail", F.col("worst_rank") <= F.ceil(F.lit(fraction) * F.count("*").over(w)))


def horizon_metrics(panel: DataFrame, arms: Sequence[str], baseline: str, bounds: Sequence[float], horizon: str = "horizon", unit: str = "well", group: str = "component", truth: str = "truth") -> DataFrame:
    """Metrics by horizon bin and model; empty bins are left out."""
    label, order = interval_label(F.col(horizon), bounds)
    base = cells(panel.withColumn("bin", label).withColumn("bin_order", order), ["bin", "bin_order", group, unit], arms, truth)
    keys = ["bin", "bin_order"]
    units = base.groupBy(*keys, unit).agg(F.sum("n").alias("n"), *(F.sum(a).alias(a) for a in arms))
    roots = units.select(*keys, "n", F.sqrt(F.col(baseline) / F.col("n")).alias("base"), *(F.sqrt(F.col(a) / F.col("n")).alias(a) for a in arms))
    macro = long(roots, [*keys, "n", "base"], arms, "rmse").groupBy(*keys, "model").agg(F.count("*").alias("wells"), F.avg("rmse").alias("macro_well_rmse"), F.avg((F.col("rmse") > F.col("base") + EPS).cast("double")).alias("harmed_well_rate"))
    pooled = base.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count_distinct(group).alias("components"), F.sqrt(F.sum(baseline) / F.sum("n")).alias("base"), *(F.sqrt(F.sum(a) / F.sum("n")).alias(a) for a in arms))
    pooled = long(pooled, [*keys, "rows", "components", "base"], arms, "pooled_rmse")
    return pooled.join(macro, [*keys, "model"]).select(*keys, "model", "rows", "wells", "components", "pooled_rmse", "macro_well_rmse", "harmed_well_rate", (F.col("base") - F.col("pooled_rmse")).alias("gain"))


def rank_units(scores: DataFrame, keys: Sequence[str], baseline: str, score: str = "rmse") -> DataFrame:
    """Adds rank, ``is_best``, ``is_worst`` and ``gain`` over the baseline among the models of each unit (``keys``)."""
    w = Window.partitionBy(*keys)
    return (
        scores.withColumn("rank", average_rank(keys, score))
        .withColumn("is_best", close(F.col(score), F.min(score).over(w), EPS))
        .withColumn("is_worst", close(F.col(score), F.max(score).over(w), EPS))
        .withColumn("gain", F.max(F.when(F.col("model") == baseline, F.col(score))).over(w) - F.col(score))
    )


def fold_metrics(panel: DataFrame, arms: Sequence[str], baseline: str, fold: str = "fold", unit: str = "well", group: str = "component", truth: str = "truth") -> DataFrame:
    wide = panel.groupBy(fold).agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("wells"), F.count_distinct(group).alias("components"), *(rmse(truth, a).alias(a) for a in arms))
    return rank_units(long(wide, [fold, "rows", "wells", "components"], arms, "rmse"), [fold], baseline)


def rank_summary(units: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return units.groupBy(*keys).agg(
        F.count("rank").alias("units"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("rank_std"), F.avg(F.col("is_best").cast("double")).alias("best_rate"),
        F.avg((F.col("gain") > EPS).cast("double")).alias("beats_rate"), F.avg("gain").alias("mean_gain"), F.min("gain").alias("worst_gain"),
    )


def best_row(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def row_weights(panel: DataFrame, group: str = "component") -> DataFrame:
    """Adds ``weight``: every group has the same total, and all rows together one."""
    sizes = panel.groupBy(group).agg(F.count("*").alias("_n"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("_g"))))  # one row
    return panel.join(sizes, group).withColumn("weight", 1 / (F.col("_g") * F.col("_n"))).drop("_n", "_g")


def unit_weights(units: DataFrame, group: str = "component") -> DataFrame:
    """Adds ``weight``: one over the group's size, scaled to a mean of one."""
    sizes = units.groupBy(group).agg(F.count("*").alias("_n"))
    mean = units.agg(F.count("*").alias("_rows"), F.count_distinct(group).alias("_g"))
    return units.join(sizes, group).crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_rows") / (F.col("_n") * F.col("_g"))).drop("_n", "_g", "_rows")


def moments(panel: DataFrame, arms: Sequence[str], parent: str, by: Sequence[str] = (), weight: str | None = None, truth: str = "truth") -> DataFrame:
    """Second moments of the moves ``arm - parent`` and the residual ``truth - parent``, upper triangle, in one pass.

    Columns ``g_i_j``, ``c_i``, ``rr`` and ``n``: means by default, weighted sums where ``weight`` is a column.
    """
    move, rest = [F.col(a) - F.col(parent) for a in arms], F.col(truth) - F.col(parent)
    w = F.col(weight) if weight else None
    total = lambda x: F.sum(w * x) if w is not None else F.avg(x)
    cols = [total(move[i] * move[j]).alias(f"g_{i}_{j}") for i in range(len(arms)) for j in range(i, len(arms))]
    cols += [total(m * rest).alias(f"c_{i}") for i, m in enumerate(move)] + [total(rest * rest).alias("rr"), F.count("*").alias("n")]
    return panel.groupBy(*by).agg(*cols)


def group_stats(panel: DataFrame, group: str, reference: str, candidate: str, truth: str = "truth") -> DataFrame:
    """``(pos, n, ref, cand)`` for each group in order of its name: what resampling needs of the panel."""
    t = panel.groupBy(group).agg(F.count("*").alias("n"), F.sum(squared(truth, reference)).alias("ref"), F.sum(squared(truth, candidate)).alias("cand"))
    return numbered(t, [group], "pos").select("pos", "n", "ref", "cand")


def _draws(spark, draws: int, slots: DataFrame) -> DataFrame:
    """``(draw, pos)``: for every draw as many positions as there are groups, with replacement."""
    return spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(slots.agg(F.count("*").alias("g")))).select("draw", "g", F.explode(F.sequence(F.lit(0), F.col("g").cast("int") - 1)).alias("slot")).select("draw", "slot", uniform_index(F.col("draw"), F.col("slot"), F.col("g")).alias("pos"))


def _drawn(slots: DataFrame, draws: int) -> DataFrame:
    """The rows of ``slots`` that each draw takes. The draws are the larger side by far, though Spark's estimate, which knows nothing of the
    sequences in them, is a few rows: left to it they would be broadcast."""
    return _draws(slots.sparkSession, draws, slots).join(slots.hint("shuffle_hash"), "pos")


def bootstrap_draws(stats: DataFrame, draws: int) -> DataFrame:
    """``(draw, gain)``: difference of pooled root errors over resampled whole groups."""
    root = lambda c: F.sqrt(F.sum(c) / F.sum("n"))
    return _drawn(stats, draws).groupBy("draw").agg((root("ref") - root("cand")).alias("gain"))


def interval(gains: DataFrame, value: str = "gain") -> DataFrame:
    return gains.agg(F.count("*").alias("draws"), F.avg(value).alias("gain_mean"), F.percentile(value, 0.025).alias("ci95_low"), F.percentile(value, 0.975).alias("ci95_high"), F.avg((F.col(value) > 0).cast("double")).alias("probability_positive"))


def bootstrap(panel: DataFrame, group: str, reference: str, candidate: str, draws: int, truth: str = "truth") -> DataFrame:
    return interval(bootstrap_draws(group_stats(panel, group, reference, candidate, truth), draws))


def bootstrap_ranks(groups: DataFrame, arms: Sequence[str], baseline: str, draws: int, group: str = "component") -> DataFrame:
    """``(draw, model, rmse, rank, is_best, is_worst, gain)``: macro error over resampled groups, ranked in each draw.

    ``groups``: one row for each group with each arm's root error.
    """
    placed = numbered(groups.select(group, *arms), [group], "pos").select("pos", *arms)
    means = _drawn(placed, draws).groupBy("draw").agg(*(F.avg(a).alias(a) for a in arms))
    return rank_units(long(means, ["draw"], arms, "rmse"), ["draw"], baseline)


def crossed_bootstrap(stats: DataFrame, draws: int, first: str = "seed", second: str = "component") -> DataFrame:
    """``(draw, gain)`` with two crossed factors resampled independently; ``stats``: ``(first, second, n, ref, cand)``."""
    code = lambda c, name: numbered(stats.select(F.col(c).alias(f"_{name}")).distinct(), [f"_{name}"], name)
    i, j = code(first, "i"), code(second, "j")
    placed = stats.join(i, F.col(first).eqNullSafe(F.col("_i"))).join(j, F.col(second).eqNullSafe(F.col("_j"))).select("i", "j", "n", "ref", "cand")
    size = placed.agg((F.max("i") + 1).alias("a"), (F.max("j") + 1).alias("b"))
    spark = stats.sparkSession
    base = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))

    def chosen(n: str, tag: str, name: str) -> DataFrame:
        rows = base.select("draw", n, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("slot"))
        return rows.select("draw", uniform_index(F.concat(F.lit(tag), F.col("draw").cast("string")), F.col("slot"), F.col(n)).alias(name)).groupBy("draw", name).agg(F.count("*").alias(f"{name}_times"))

    both = chosen("a", "s", "i").hint("merge").join(chosen("b", "c", "j"), "draw").join(placed.hint("merge"), ["i", "j"])  # estimated as few rows, not to be broadcast
    times = F.col("i_times") * F.col("j_times")
    root = lambda c: F.sqrt(F.sum(times * F.col(c)) / F.sum(times * F.col("n")))
    return both.groupBy("draw").agg((root("ref") - root("cand")).alias("gain"))


def weighted_quantile(table: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, tie: Sequence[str] = ()) -> DataFrame:
    """The smallest value whose share of weight, summed in order, reaches ``q``; the largest if none does."""
    w = Window.partitionBy(*keys)
    share = F.try_divide(F.sum(weight).over(w.orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight).over(w))
    return table.withColumn("_share", share).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_share") >= q, F.col(value))), F.max(value)).alias("quantile"))


def refit_metrics(panel: DataFrame, parent: str, candidate: str, unit: str = "well", group: str = "component", fraction: float = 0.1, truth: str = "truth") -> DataFrame:
    """One row that compares a candidate with its parent; its tail is the root of the mean of the worst mean squares, and a unit
    is harmed by any loss at all."""
    base = cells(panel, [group, unit], [parent, candidate], truth)
    sums = lambda by: base.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(parent) / F.sum("n")).alias("p"), (F.sum(candidate) / F.sum("n")).alias("c"))
    tails = long(sums([group]), [group, "n"], ["p", "c"], "mse")
    tail = tail_mean(tails, ["model"], "mse", fraction, "tail", of_squares=True).groupBy().pivot("model", ["p", "c"]).agg(F.first("tail"))
    gain = lambda a, b: (F.col(a) - F.col(b))
    units = sums([unit]).agg(F.count("*").alias("wells"), F.avg(F.sqrt("p")).alias("parent_macro_well"), F.avg(F.sqrt("c")).alias("candidate_macro_well"), F.avg((F.sqrt("c") - F.sqrt("p") > 0).cast("double")).alias("harmed_well_rate"), F.max(F.sqrt("c") - F.sqrt("p")).alias("max_regret"))
    groups = sums([group]).agg(F.count("*").alias("components"), F.avg(F.sqrt("p")).alias("parent_macro_component"), F.avg(F.sqrt("c")).alias("candidate_macro_component"))
    rows = sums([]).select(F.col("n").alias("rows"), F.sqrt("p").alias("parent_rmse"), F.sqrt("c").alias("candidate_rmse"))
    one = rows.crossJoin(units).crossJoin(groups).crossJoin(tail.select(F.col("p").alias("parent_tail"), F.col("c").alias("candidate_tail")))  # single rows
    return one.select("*", gain("parent_rmse", "candidate_rmse").alias("row_gain"), gain("parent_macro_component", "candidate_macro_component").alias("macro_gain"), gain("parent_tail", "candidate_tail").alias("tail_gain"))


def promotion(metrics: DataFrame, max_harm: float = 0.5) -> DataFrame:
    """``decision``: PROMOTE only if every contract improves in rows, groups and tail and harms few enough units."""
    ok = (F.col("row_gain") > 0) & (F.col("macro_gain") > 0) & (F.col("tail_gain") >= 0) & (F.col("harmed_well_rate") <= max_harm)
    return metrics.agg(F.every(ok).alias("passed"), F.count("*").alias("contracts")).select("contracts", "passed", F.when(F.col("passed"), "PROMOTE").otherwise("HOLD").alias("decision"))


def unit_features(panel: DataFrame, arms: Sequence[str], fallback: str, order: Sequence[str], unit: str = "well", group: str = "component", horizon: str = "horizon", truth: str = "truth") -> DataFrame:
    """For each unit: horizon and, for each arm, size, largest value and roughness of its move from the fallback, size of its move
    from the arm before, and its gain in mean square. Features never read the truth; gains and ``fallback_mse`` do."""
    w = Window.partitionBy(unit).orderBy(*order)
    rms = lambda c: F.sqrt(F.avg(c * c))
    t, before, cols = panel, fallback, []
    for a in arms:
        move = F.col(a) - F.col(fallback)
        t = t.withColumn(f"_step_{a}", move - F.lag(move).over(w))
        cols += [rms(move).alias(f"{a}_move_rms"), F.max(F.abs(move)).alias(f"{a}_move_absmax"), rms(F.col(a) - F.col(before)).alias(f"{a}_local_rms"), F.coalesce(rms(F.col(f"_step_{a}")), F.lit(0.0)).alias(f"{a}_roughness")]
        cols.append((F.avg(squared(truth, fallback)) - F.avg(squared(truth, a))).alias(f"gain_{a}"))
        before = a
    return t.groupBy(unit).agg(F.min(group).alias(group), F.count("*").alias("rows"), F.max(horizon).alias("horizon_max"), F.avg(horizon).alias("horizon_mean"), *cols, F.avg(squared(truth, fallback)).alias("fallback_mse"))


def blend_grid(panel: DataFrame, parent: str, arm: str, cap: float = 0.1, step: float = 0.005, weights: tuple[float, float, float, float] = (0.5, 0.25, 0.25, 0.01), fraction: float = 0.1, group: str = "component", truth: str = "truth") -> DataFrame:
    """``(w, row, macro, tail, objective)`` for each weight of the grid: root errors of ``parent + w (arm - parent)``, each over the
    parent's own, added by ``weights`` with an L2 term. Only one small row for each group meets the grid."""
    q = moments(panel, [arm], parent, [group], truth=truth)
    grid = panel.sparkSession.range(int(round(cap / step)) + 1).select((F.col("id") * step).alias("w"))
    mse = F.greatest(F.lit(0.0), F.col("rr") - 2 * F.col("w") * F.col("c_0") + F.col("w") * F.col("w") * F.col("g_0_0"))
    at = q.crossJoin(F.broadcast(grid)).select("w", group, "n", mse.alias("mse"))  # the grid is a parameter
    tail = tail_mean(at, ["w"], "mse", fraction, "tail", of_squares=True)
    t = at.groupBy("w").agg(F.sqrt(F.sum(F.col("n") * F.col("mse")) / F.sum("n")).alias("row"), F.avg(F.sqrt("mse")).alias("macro")).join(tail, "w")
    zero = Window.partitionBy()
    own = lambda c: F.col(c) / F.max(F.when(F.col("w") == 0, F.col(c))).over(zero)
    a, b, c, l2 = weights
    return t.withColumn("objective", a * own("row") + b * own("macro") + c * own("tail") + l2 * F.col("w") * F.col("w"))
