"""Operators on ordered series: a table with a key, a zero-based row number ``rn`` within it, and values.

Every operator is one or two window passes over one partitioning (the key), so several of them share a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cairn.functions.expr import clip


def ordered(key: str, order: str = "rn") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def whole(key: str) -> WindowSpec:
    return Window.partitionBy(key)


def number_rows(table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rn``; ``order`` must leave no ties."""
    return table.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


# --- visible prefix and hidden suffix ---------------------------------------------------------------------------------


def prefix_length(n: Column, fraction: float, least: int = 30, rest: int = 10) -> Column:
    """Rounded half to even, at least ``least``, leaving at least ``rest`` rows."""
    return clip(F.bround(F.lit(fraction) * n), least, n - rest).cast("int")


def mask_prefix(table: DataFrame, key: str, fraction: float) -> DataFrame:
    """Adds ``cut`` and ``known`` (the row belongs to the visible prefix)."""
    t = table.withColumn("cut", prefix_length(F.count("*").over(whole(key)), fraction))
    return t.withColumn("known", F.col("rn") < F.col("cut"))


def prefix_summary(table: DataFrame, key: str, visible: str) -> DataFrame:
    """Known and hidden rows by whether ``visible`` is null, and whether the known ones are one leading run."""
    known = F.col(visible).isNotNull()
    return table.groupBy(key).agg(F.count_if(known).alias("known"), F.count_if(~known).alias("hidden"), F.coalesce(F.max(F.when(known, F.col("rn"))) + 1 == F.count_if(known), F.lit(False)).alias("contiguous"))


def horizon(table: DataFrame, key: str, position: str, known: str = "known") -> DataFrame:
    """Adds ``horizon``: distance of ``position`` from the last known row."""
    last = F.max_by(position, F.when(F.col(known), F.col("rn"))).over(whole(key))
    return table.withColumn("horizon", F.col(position) - last)


def tail_rows(table: DataFrame, key: str, n: int) -> DataFrame:
    return table.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.col("rn").desc()))).where(F.col("_back") <= n).drop("_back")


def stride(table: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th row and the last."""
    return table.withColumn("_last", F.max("rn").over(whole(key))).where((F.col("rn") % step == 0) | (F.col("rn") == F.col("_last"))).drop("_last")


# --- fills --------------------------------------------------------------------------------------------------------------


def _neighbours(value: str, key: str) -> tuple[Column, Column, Column, Column]:
    back = ordered(key).rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered(key).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("rn"))
    return F.last(value, True).over(back), F.max(at).over(back), F.first(value, True).over(ahead), F.min(at).over(ahead)


def fill_linear(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Nulls by straight lines between neighbours, by row number; the ends hold the nearest value."""
    low, i, high, j = _neighbours(value, key)
    t = table.withColumns({"_a": low, "_i": i, "_b": high, "_j": j})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("rn") - F.col("_i")) / (F.col("_j") - F.col("_i"))
    return t.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(line)).drop("_a", "_i", "_b", "_j")


def curve_inputs(curves: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """What the kernels make of reference logs, ``(key, i, at, mean_filled, line_filled, known, noise)``: knots with a finite place, numbered in order of it;
    gaps of the value set to the series' mean for the particle kernel, and to straight lines by number for the grid kernel; how
    many values are known, and their deviation, 30 if fewer than 20 are."""
    finite = lambda c: F.when((c - c) == 0, c)
    t = curves.select(key, finite(F.col(at).cast("double")).alias(at), finite(F.col(value).cast("double")).alias("_v")).where(F.col(at).isNotNull())
    t = t.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(at, "_v")) - 1)
    whole = Window.partitionBy(key)
    known = F.count("_v").over(whole)
    t = t.withColumns({"known": known, "noise": F.when(known >= 20, F.stddev_pop("_v").over(whole)).otherwise(30.0), "mean_filled": F.coalesce("_v", F.avg("_v").over(whole), F.lit(0.0))})
    return fill_linear(t, key, "_v", "line_filled").select(key, F.col("rn").alias("i"), at, "mean_filled", F.coalesce("line_filled", F.lit(0.0)).alias("line_filled"), "known", "noise")


def fill_inner(table: DataFrame, key: str, value: str, name: str, limit: int) -> DataFrame:
    """Only gaps between two values, and only their first ``limit`` rows; ``<name>_weight`` is 1 for observed, 0.5 for filled, else 0."""
    low, i, high, j = _neighbours(value, key)
    t = table.withColumns({"_a": low, "_i": i, "_b": high, "_j": j})
    near = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("rn") - F.col("_i") <= limit)
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("rn") - F.col("_i")) / (F.col("_j") - F.col("_i"))
    seen = F.col(value).isNotNull()
    return t.withColumns({name: F.when(seen, F.col(value)).when(near, line), f"{name}_weight": F.when(seen, F.lit(1.0)).when(near, F.lit(0.5)).otherwise(F.lit(0.0))}).drop("_a", "_i", "_b", "_j")


# --- windows ------------------------------------------------------------------------------------------------------------


def centered(key: str, width: int) -> WindowSpec:
    return ordered(key).rowsBetween(-(width // 2), width // 2)


def rolling(table: DataFrame, key: str, value: str, widths: Sequence[int]) -> DataFrame:
    """Adds ``<value>_mean<w>`` and ``<value>_std<w>`` (sample; 0 for a single value) over centered windows of the whole series."""
    cols = {}
    for w in widths:
        cols[f"{value}_mean{w}"] = F.avg(value).over(centered(key, w))
        cols[f"{value}_std{w}"] = F.coalesce(F.stddev_samp(value).over(centered(key, w)), F.lit(0.0))
    return table.withColumns(cols)


def envelope(table: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """Adds the rolling maximum and the rolling root mean square."""
    w = centered(key, width)
    return table.withColumns({f"{value}_max{width}": F.max(value).over(w), f"{value}_energy{width}": F.sqrt(F.avg(F.col(value) * F.col(value)).over(w))})


def shifts(table: DataFrame, key: str, value: str, steps: Sequence[int]) -> DataFrame:
    """Adds ``<value>_lag<k>`` and ``<value>_lead<k>``; beyond the ends the first or last value. ``value`` must have no nulls."""
    w, all_rows = ordered(key), ordered(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for k in steps:
        cols[f"{value}_lag{k}"] = F.coalesce(F.lag(value, k).over(w), F.first(value).over(all_rows))
        cols[f"{value}_lead{k}"] = F.coalesce(F.lead(value, k).over(w), F.last(value).over(all_rows))
    return table.withColumns(cols)


def gradient(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Half the difference of the neighbours; at the ends the difference with the one there is."""
    w = ordered(key)
    low, high = F.lag(value).over(w), F.lead(value).over(w)
    return table.withColumn(name, F.when(low.isNull(), high - F.col(value)).when(high.isNull(), F.col(value) - low).otherwise((high - low) / 2))


def differences(table: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Adds first and second difference (0 at the start) and the slope by ``position`` (null where it does not move)."""
    w = ordered(key)
    t = table.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_p", F.col(position) - F.lag(position).over(w))
    t = t.withColumns({f"{value}_d1": F.coalesce("_d", F.lit(0.0)), f"{value}_slope": F.try_divide("_d", F.nullif("_p", F.lit(0.0)))})
    return t.withColumn(f"{value}_d2", F.coalesce(F.col(f"{value}_d1") - F.lag(f"{value}_d1").over(w), F.lit(0.0))).drop("_d", "_p")


def relative_position(table: DataFrame, key: str) -> DataFrame:
    """Adds both forms: ``frac`` counts rows from 1 to n, ``frac0`` runs from 0 to 1; and square and root of the first."""
    n = F.count("*").over(whole(key))
    t = table.withColumns({"frac": (F.col("rn") + 1) / n, "frac0": F.col("rn") / F.greatest(n - 1, F.lit(1))})
    return t.withColumns({"frac2": F.col("frac") * F.col("frac"), "sqrt_frac": F.sqrt("frac")})


def chord(table: DataFrame, key: str, axes: Sequence[str], floor: float = 0.25) -> DataFrame:
    """Adds ``chord``: straight-line distance from the row before, at least ``floor``; null at the start."""
    w = ordered(key)
    total = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))
    return table.withColumn("chord", F.when(F.lag("rn").over(w).isNotNull(), F.greatest(F.sqrt(total), F.lit(floor))))


def cumulative_share(table: DataFrame, keys: Sequence[str], value: str, weight: str, tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``cdf``: share of weight up to a row in order of ``value``."""
    w = Window.partitionBy(*keys)
    return table.withColumn("cdf", F.try_divide(F.sum(weight).over(w.orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight).over(w)))


def prequential(table: DataFrame, key: str, member: str, value: str, evidence: str, temperature: float = 1.0) -> DataFrame:
    """``(key, rn, mixed)``: members' values weighted by the softmax of their evidence strictly before the row."""
    w = Window.partitionBy(key, member).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    t = table.withColumn("_l", F.coalesce(F.sum(evidence).over(w), F.lit(0.0)) / temperature)
    t = t.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(Window.partitionBy(key, "rn"))))
    return t.groupBy(key, "rn").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mixed"))


# --- estimates for each series ------------------------------------------------------------------------------------------


def slopes(table: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Four slopes of ``y`` by ``x``: median of steps (0 for fewer than three), end to end, least squares, and least squares through
    the last point."""
    w, last = ordered(key), Window.partitionBy(key)
    t = table.select(key, "rn", F.col(x).alias("_x"), F.col(y).alias("_y"))
    t = t.withColumn("_s", F.try_divide(F.col("_y") - F.lag("_y").over(w), F.nullif(F.col("_x") - F.lag("_x").over(w), F.lit(0.0))))
    t = t.withColumns({"_dx": F.col("_x") - F.max_by("_x", "rn").over(last), "_dy": F.col("_y") - F.max_by("_y", "rn").over(last)})
    ends = lambda c: F.max_by(c, "rn") - F.min_by(c, "rn")
    return t.groupBy(key).agg(
        F.when(F.count("_s") >= 3, F.median("_s")).otherwise(F.lit(0.0)).alias("median_step"),
        F.try_divide(ends("_y"), F.nullif(ends("_x"), F.lit(0.0))).alias("endpoint"),
        F.regr_slope("_y", "_x").alias("least_squares"),
        F.try_divide(F.sum(F.col("_dx") * F.col("_dy")), F.nullif(F.sum(F.col("_dx") * F.col("_dx")), F.lit(0.0))).alias("anchored"),
    )


def calibration(table: DataFrame, key: str, x: str, y: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Affine maps of ``x`` to ``y``: clipped slope with median offset (``a``, ``b``), plain least squares (``slope``,
    ``intercept``), and offset alone (``offset``: median of ``y - x``)."""
    fit = table.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.median(F.col(y) - F.col(x)).alias("offset"))
    fit = fit.withColumn("a", clip(F.coalesce("slope", F.lit(1.0)), low, high))
    offset = table.join(fit.select(key, "a"), key).groupBy(key).agg(F.median(F.col(y) - F.col("a") * F.col(x)).alias("b"))
    return fit.join(offset, key)


def robust_scale(table: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """``scale``: 1.4826 times the median absolute deviation, between bounds."""
    mid = F.median(value).over(whole(key))
    return table.withColumn("_dev", F.abs(F.col(value) - mid)).groupBy(key).agg(clip(F.median("_dev") * 1.4826, low, high).alias("scale"))


def correlation_length(table: DataFrame, key: str, value: str, lags: int = 60, stop: float = 0.05, low: float = 1.0, high: float = 60.0) -> DataFrame:
    """``length``: one plus the autocorrelations from lag 1 on, until the first that is at most ``stop``; then clipped.

    Lags meet as rows: each row is paired with those up to ``lags`` behind by a window of collected values.
    """
    t = table.withColumn("_c", F.col(value) - F.avg(value).over(whole(key)))
    behind = F.collect_list("_c").over(ordered(key).rowsBetween(-lags, -1))
    pairs = t.withColumn("_behind", behind).select(key, "_c", F.posexplode(F.reverse("_behind")).alias("_k", "_o"))
    cov = pairs.groupBy(key, (F.col("_k") + 1).alias("lag")).agg(F.sum(F.col("_c") * F.col("_o")).alias("cov"))
    var = t.groupBy(key).agg(F.sum(F.col("_c") * F.col("_c")).alias("var"))
    r = cov.join(var, key).withColumn("r", F.try_divide("cov", F.nullif("var", F.lit(0.0))))
    stopped = F.max(F.when(F.coalesce(F.col("r"), F.lit(0.0)) <= stop, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("lag"))
    summed = r.withColumn("_stop", stopped).groupBy(key).agg(F.sum(F.when(F.col("_stop") == 0, F.col("r"))).alias("s"))
    return var.select(key).join(summed, key, "left").select(key, clip(1 + F.coalesce("s", F.lit(0.0)), low, high).alias("length"))


def fingerprint(table: DataFrame, key: str, value: str, points: int = 64) -> DataFrame:
    """``shape``: the filled series at evenly spaced places, centered, of length one; zeros for fewer than four values or a flat one."""
    w, last = whole(key), points - 1
    t = fill_linear(table, key, value, "_f").select(key, "rn", "_f", F.lead("_f").over(ordered(key)).alias("_g"), F.count("*").over(w).alias("_n"), F.count(value).over(w).alias("_seen"))
    span = F.greatest(F.col("_n") - 1, F.lit(1))  # place k lies at k * (n - 1) / last; each row gives the places between itself and the next
    low, high = F.floor(F.col("rn") * last / span - 1e-6), F.ceil((F.col("rn") + 1) * last / span + 1e-6)
    t = t.withColumn("_k", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(last)))))
    at = F.col("_k") * (F.col("_n") - 1)
    t = t.where((F.col("rn") * last <= at) & (at < (F.col("rn") + 1) * last))
    t = t.withColumn("_y", F.col("_f") + (F.coalesce("_g", "_f") - F.col("_f")) * (at / last - F.col("rn")))
    t = t.withColumn("_y", F.col("_y") - F.avg("_y").over(w))
    s = t.groupBy(key).agg(F.max("_seen").alias("_n"), F.sqrt(F.sum(F.col("_y") * F.col("_y"))).alias("_l"), F.sort_array(F.collect_list(F.struct("_k", "_y"))).alias("_s"))
    zeros = F.array_repeat(F.lit(0.0), points)
    return s.select(key, F.when((F.col("_n") >= 4) & (F.col("_l") > 1e-12), F.transform("_s", lambda x: x["_y"] / F.col("_l"))).otherwise(zeros).alias("shape"))


def rolling_origin(table: DataFrame, key: str, predictor: str, target: str, fractions: Sequence[float], ahead: float = 0.1) -> DataFrame:
    """``(key, cv)``: mean over origins of the root error, on the next ``ahead`` share of rows, of the predictor shifted by the median
    difference before the origin."""
    t = table.select(key, "rn", (F.col(target) - F.col(predictor)).alias("_d"), F.count("*").over(whole(key)).alias("_n"))
    t = t.withColumn("_f", F.explode(F.array(*map(F.lit, fractions))))  # a step of its own: windows count after a generator
    cut, end = F.floor(F.col("_n") * F.col("_f")), F.floor(F.col("_n") * (F.col("_f") + ahead))
    shift = t.where(F.col("rn") < cut).groupBy(key, "_f").agg(F.median("_d").alias("_m"))
    errors = t.where((F.col("rn") >= cut) & (F.col("rn") < end)).join(shift, [key, "_f"]).groupBy(key, "_f").agg(F.sqrt(F.avg(F.pow(F.col("_d") - F.col("_m"), 2))).alias("_e"))
    return errors.groupBy(key).agg(F.avg("_e").alias("cv"))


def step_statistics(table: DataFrame, key: str, position: str, unit: float = 1.0) -> DataFrame:
    """Over all steps of all series: number, extremes, quartiles, and the share that differs from ``unit``."""
    d = F.col(position) - F.lag(position).over(ordered(key))
    counts = value_counts(table.select(d.alias("_d")).where("_d is not null"), "_d")
    n = F.coalesce(F.sum("n"), F.lit(0))
    t = counts.agg(n.alias("steps"), F.min("_d").alias("least"), F.max("_d").alias("most"), F.try_divide(F.sum(F.when(F.abs(F.col("_d") - unit) > 1e-9, F.col("n")).otherwise(0)), n).alias("off_unit"))
    return t.crossJoin(F.broadcast(quantiles(counts, "_d", {f"q{int(q * 100)}": q for q in (0.25, 0.5, 0.75, 0.95)}))).select("steps", "least", "most", "q25", "q50", "q75", "q95", "off_unit")  # two single rows


def value_counts(table: DataFrame, value: str) -> DataFrame:
    """``(value, n, upto)``: rows of each value, and of all values up to it, numbered by ranges: no task holds all values."""
    from cairn.plans.staging import Stage

    stage = Stage(table.sparkSession, "values")
    counts = stage.put(table.groupBy(value).agg(F.count("*").alias("n")))
    ranged = stage.put(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"))  # one row for each range
    before = sizes.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("_range").orderBy(value))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select(value, "n", (F.col("_own") + F.col("_before")).alias("upto"))


def quantiles(counts: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact quantiles of ``value_counts``, by straight lines between the two values next to each place."""
    place = {k: F.lit(q) * (F.col("_n") - 1) for k, q in shares.items()}
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    t = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_n"))))  # one row
    ends = t.agg(F.first("_n").alias("_n"), *(at(f(p)).alias(f"_{k}_{n}") for k, p in place.items() for n, f in (("low", F.floor), ("high", F.ceil))))
    line = lambda k, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_{k}_low")).otherwise((F.ceil(p) - p) * F.col(f"_{k}_low") + (p - F.floor(p)) * F.col(f"_{k}_high"))
    return ends.select(*(line(k, p).alias(k) for k, p in place.items()))


def shuffled(t: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Adds ``name``: the place from 0 in an order that follows from seed and key alone, the same on any engine and partitioning."""
    from cairn.operators.joins import numbered

    return numbered(t.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), ["_draw", key], name).drop("_draw")
