"""Per-series estimators as maps over streams of whole series and their curves (``runs``).

A series table has ``well, row_number, MD, X, Y, Z, GR, TVT_input`` (null where hidden), a curve table ``well, TVT, GR``. One
task holds one series and its curve, for a block of seeds and one arm; what depends on the order of rows stays inside the map, everything after it is an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import particles as pf
from cairn.functions import states
from cairn.functions.grid import GridSettings, GridSmoother
from cairn.operators import neighbours, runs

COLUMNS = ("MD", "X", "Y", "Z", "GR", "TVT_input")


def frame_of(pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns as arrays in row order, and the row numbers; refuses a record without a leading visible part and a hidden rest."""
    pdf = pdf.sort_values("row_number", kind="stable")
    return checked({c: pdf[c].to_numpy(float) for c in COLUMNS if c in pdf}, pdf["well"].iloc[0]), pdf["row_number"].to_numpy()


def checked(frame: dict[str, np.ndarray], well: str) -> dict[str, np.ndarray]:
    """The columns that estimators see, of rows in order; refuses what ``frame_of`` refuses."""
    out = {c: np.asarray(frame[c], float) for c in COLUMNS if c in frame}
    known = np.isfinite(out["TVT_input"])
    if known.all() or not known.any() or not known[: int(known.sum())].all():
        raise ValueError(f"{well}: the visible rows must be a leading run with hidden rows after it")
    return out


def observable(series: DataFrame) -> DataFrame:
    """The columns that estimators may see; a truth column does not get through."""
    return series.select("well", "row_number", *(F.col(c).cast("double").alias(c) for c in COLUMNS if c in series.columns))


#: Rows of a series that look for their anchors together.
STRETCH = 128
#: Seeds that run in one task, side by side.
SEEDS = 8


def particle_paths(series: DataFrame, curves: DataFrame, seeds: Sequence[int], settings: pf.FilterSettings = pf.FilterSettings(), rates: DataFrame | None = None) -> DataFrame:
    """``(well, arm, seed, row_number, tvt, evidence)`` for every hidden row and seed, and for every ``(well, arm, rate)`` of ``rates`` if given.

    A series goes to a task with up to ``SEEDS`` seeds, whose particles move as one array; more seeds, and arms, are further tasks.
    """
    spark = series.sparkSession
    seeds = [int(s) for s in seeds]
    blocks = [seeds[k : k + SEEDS] for k in range(0, len(seeds), SEEDS)]
    rows = runs.with_curves(observable(series), curves).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in range(len(blocks))], "block int")))  # a parameter
    rows = rows.join(rates, "well") if rates is not None else rows.withColumns({"arm": F.lit("median"), "rate": F.lit(None).cast("double")})

    def run(key, own, at, value) -> runs.Columns:
        frame, seeds = checked(own, key[0]), blocks[key[2]]
        rate = float(own["rate"][0])
        t = pf.track(frame, pf.Curve(at, value), seeds, settings, None if np.isnan(rate) else rate)
        hidden = own["row_number"][~np.isfinite(frame["TVT_input"])]
        return {"seed": np.repeat(seeds, len(hidden)), "row_number": np.tile(hidden, len(seeds)), "tvt": t.path.ravel(), "evidence": t.evidence.ravel()}

    made = runs.by_series(rows, ["well", "arm", "block"], run, "well string, arm string, block int, seed int, row_number int, tvt double, evidence double")
    return made.drop("block")


def full_paths(series: DataFrame, curves: DataFrame, seeds: Sequence[int], settings: pf.FilterSettings = pf.FilterSettings(), temperature: float = 8.0) -> DataFrame:
    """``(well, row_number, tvt, known)`` for every row: the visible level where there is one, else the likelihood-weighted mixture of the seeds."""
    made = by_likelihood(particle_paths(series, curves, seeds, settings), temperature).select("well", "row_number", F.col("tvt").alias("_path"))
    t = observable(series).select("well", "row_number", "TVT_input").join(made, ["well", "row_number"], "left")
    return t.select("well", "row_number", F.coalesce("TVT_input", "_path").alias("tvt"), F.col("TVT_input").isNotNull().alias("known"))


def start_rates(series: DataFrame, windows: Sequence[int] = (30, 50, 120, 200), kinds: Sequence[str] = pf.RATE_KINDS, shrinks: Sequence[float] = (0.0, 0.5, 1.0)) -> DataFrame:
    """``(well, arm, rate)``: every registered initial rate, arms of shrink zero (which are the same) once, as ``zero``."""

    def run(key, own) -> runs.Columns:
        frame = checked(own, key[0])
        known = np.isfinite(frame["TVT_input"])
        md, u = frame["MD"][known], (frame["TVT_input"] + frame["Z"])[known]
        rows = [("zero", 0.0)] if 0.0 in shrinks else []
        rows += [(f"w{w:03d}_{k}_s{s:.1f}", pf.start_rate(md, u, w, k, s)) for w in windows for k in kinds for s in shrinks if s]
        return {"arm": np.array([a for a, _ in rows], object), "rate": np.array([r for _, r in rows], float)}

    return runs.by_group(observable(series), ["well"], ["row_number"], run, "well string, arm string, rate double")


def by_likelihood(paths: DataFrame, temperature: float = 8.0, least: float | None = None) -> DataFrame:
    """``(well, arm, row_number, tvt, spread)``: seeds weighted by the softmax of their total evidence; aggregates only.

    ``least``: weights move towards uniform as far as this effective number of seeds asks, by its closed form.
    """
    t = paths.withColumn("_l", F.sum("evidence").over(Window.partitionBy("well", "arm", "seed")) / temperature)
    row = Window.partitionBy("well", "arm", "row_number")
    t = t.withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(row)))
    t = t.withColumn("_w", F.col("_w") / F.sum("_w").over(row))
    if least is not None:
        n = F.count("*").over(row)
        size = F.sum(F.pow("_w", 2)).over(row) - 1 / n
        room = F.greatest(F.lit(0.0), 1 / F.least(F.lit(float(least)), n) - 1 / n)
        rho = F.when(size <= room + 1e-15, F.lit(1.0)).otherwise(F.sqrt(room / size))
        t = t.withColumn("_w", 1 / n + rho * (F.col("_w") - 1 / n))
    return t.groupBy("well", "arm", "row_number").agg(F.sum(F.col("_w") * F.col("tvt")).alias("tvt"), F.stddev_pop("tvt").alias("spread"))


def robust(paths: DataFrame) -> DataFrame:
    """``(well, arm, row_number, uniform, median, trim1)`` over seeds."""
    n = F.count("*")
    return paths.groupBy("well", "arm", "row_number").agg(F.avg("tvt").alias("uniform"), F.median("tvt").alias("median"), F.when(n >= 4, (F.sum("tvt") - F.min("tvt") - F.max("tvt")) / (n - 2)).alias("trim1"))


def candidate_paths(paths: DataFrame) -> DataFrame:
    """``(well, arm, row_number, candidate, tvt)``: all registered aggregates, in one map for each series over its seeds."""

    def run(key, own) -> runs.Columns:
        seeds = np.count_nonzero(own["row_number"] == own["row_number"][0])
        path, ev = (own[c].reshape(seeds, -1) for c in ("tvt", "evidence"))
        made = pf.candidates(pf.Track(path, ev))
        rows = own["row_number"][: path.shape[1]]
        return {"row_number": np.tile(rows, len(made)), "candidate": np.repeat(np.array(list(made), object), len(rows)), "tvt": np.concatenate(list(made.values()))}

    t = paths.select("well", "arm", "seed", "row_number", "tvt", "evidence")
    return runs.by_group(t, ["well", "arm"], ["seed", "row_number"], run, "well string, arm string, row_number int, candidate string, tvt double")


def grid_paths(series: DataFrame, curves: DataFrame, settings: GridSettings = GridSettings()) -> DataFrame:
    """``(well, row_number, tvt, spread, log_likelihood)`` by forward-backward smoothing on a grid."""

    def run(key, own, at, value) -> runs.Columns:
        frame = checked(own, key[0])
        mean, std, logl = GridSmoother(frame, pf.Curve(at, value), settings).run()
        hidden = own["row_number"][~np.isfinite(frame["TVT_input"])]
        return {"row_number": hidden, "tvt": mean, "spread": std, "log_likelihood": np.full(len(hidden), logl)}

    return runs.by_series(runs.with_curves(observable(series), curves), ["well"], run, "well string, row_number int, tvt double, spread double, log_likelihood double")


# --- overlays that need a recursion -------------------------------------------------------------------------------------


def _overlay(rows: DataFrame, extra: str, run) -> DataFrame:
    return rows.groupBy("well").applyInPandas(run, f"well string, row_number int, {extra}")


def fused(rows: DataFrame, settings: states.FusionSettings = states.FusionSettings()) -> DataFrame:
    """``(well, row_number, meta_state, state)`` from ``well, row_number, horizon, hgrg, pf, hmm, structural, prefix_cv``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_number")
        made, state, _ = states.fuse(pdf["hgrg"].to_numpy(float), pdf[["pf", "hmm", "structural"]].to_numpy(float), pdf["horizon"].to_numpy(float), float(pdf["prefix_cv"].iloc[0]), settings)
        return pd.DataFrame({"well": pdf["well"], "row_number": pdf["row_number"], "meta_state": made, "state": state})

    return _overlay(rows.select("well", "row_number", "horizon", "hgrg", "pf", "hmm", "structural", "prefix_cv"), "meta_state double, state double", run)


def smoothed(rows: DataFrame, value: str, variance: float = 1.0, jerk: float = 0.05, stride: int = 20) -> DataFrame:
    """``(well, row_number, smooth)``: ``value`` along ``horizon`` as a path of constant acceleration under white jerk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_number")
        return pd.DataFrame({"well": pdf["well"], "row_number": pdf["row_number"], "smooth": states.smooth(pdf["horizon"].to_numpy(float), pdf[value].to_numpy(float), variance, jerk, stride)})

    return _overlay(rows.select("well", "row_number", "horizon", value), "smooth double", run)


def switched(rows: DataFrame, settings: states.SwitchSettings = states.SwitchSettings()) -> DataFrame:
    """``(well, row_number, switching, offset, p_<regime> …)`` from the same columns as ``fused``."""
    names = [f"p_{r}" for r in states.REGIMES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_number")
        made, state, p, _ = states.switching(pdf["hgrg"].to_numpy(float), pdf[["pf", "hmm", "structural"]].to_numpy(float), pdf["horizon"].to_numpy(float), float(pdf["prefix_cv"].iloc[0]), settings)
        return pd.DataFrame({"well": pdf["well"], "row_number": pdf["row_number"], "switching": made, "offset": state[:, 0]} | dict(zip(names, p.T)))

    return _overlay(rows.select("well", "row_number", "horizon", "hgrg", "pf", "hmm", "structural", "prefix_cv"), "switching double, offset double, " + ", ".join(f"{n} double" for n in names), run)


def nearest_within(rows: DataFrame, base: str, proposed: str, rms_cap: float, row_cap: float) -> DataFrame:
    """``(well, row_number, projected)``: the nearest path to the proposed one that keeps both caps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_number")
        b = pdf[base].to_numpy(float)
        return pd.DataFrame({"well": pdf["well"], "row_number": pdf["row_number"], "projected": b + states.nearest_within(pdf[proposed].to_numpy(float) - b, rms_cap, row_cap)})

    return _overlay(rows.select("well", "row_number", base, proposed), "projected double", run)


# --- regional surface ---------------------------------------------------------------------------------------------------


class Surface:
    """Linear radial functions with a plane, through the ``neighbours`` anchors nearest to each place; the solution does not hang on where
    the coordinates begin."""

    def __init__(self, xy: np.ndarray, level: np.ndarray, scale: float = 10_000.0, neighbours: int = 80):
        if len(xy) < 4:
            raise ValueError("a surface needs at least four anchors")
        self.centre, self.scale = xy.mean(0), scale
        self.xy, self.level, self.k = (xy - self.centre) / scale, level, min(neighbours, len(xy))

    def __call__(self, places: np.ndarray) -> np.ndarray:
        p, out = (places - self.centre) / self.scale, np.empty(len(places))
        d = np.linalg.norm(p[:, None] - self.xy[None], axis=2)
        near = np.sort(np.argsort(d, axis=1, kind="stable")[:, : self.k], axis=1)  # ties to the first anchor
        for own in np.unique(near, axis=0):  # places with the same neighbours share a system
            rows = np.flatnonzero((near == own).all(1))
            a = self.xy[own]
            plane = np.c_[np.ones(self.k), a]
            system = np.block([[-np.linalg.norm(a[:, None] - a[None], axis=2), plane], [plane.T, np.zeros((3, 3))]])
            coef = np.linalg.lstsq(system, np.r_[self.level[own], 0, 0, 0], rcond=None)[0]
            out[rows] = np.c_[-d[rows][:, own], np.ones(len(rows)), p[rows]] @ coef
        return out


def anchors(series: DataFrame, truth: str = "TVT", top: str = "ASTNU") -> DataFrame:
    """``(well, x, y, level)``: a row for each training series; the level is that of the formation top, else of truth plus elevation."""
    has = top in series.columns
    level = F.coalesce(*( [F.median(top)] if has else []), F.median(F.col(truth) + F.col("Z")))
    return series.groupBy("well").agg(F.median("X").alias("x"), F.median("Y").alias("y"), level.alias("level"))


def structural_paths(series: DataFrame, table: DataFrame, fractions: Sequence[float] = (0.40, 0.55, 0.70, 0.85), count: int = 80) -> DataFrame:
    """``(well, row_number, structural, prefix_cv)`` of hidden rows: the surface shifted by its median misfit on the visible part,
    and its rolling-origin error there. ``table``: anchors ``(well, x, y, level)``.

    Each row's surface is through its ``count`` nearest anchors. A series' task gets only the anchors that are near one of its rows.
    """
    rows = observable(series).where("X - X = 0 AND Y - Y = 0")
    boxes = rows.groupBy("well", F.floor(F.col("row_number") / STRETCH).alias("stretch")).agg(F.min("X").alias("left"), F.max("X").alias("right"), F.min("Y").alias("low"), F.max("Y").alias("high"))
    named = table.select(F.col("well").alias("anchor"), "x", "y", "level")
    close = neighbours.around(boxes.withColumn("place", F.struct("well", "stretch")), named.select("anchor", "x", "y"), "place", "anchor", count)
    own = close.select(F.col("place.well").alias("well"), "anchor").distinct().join(named, "anchor")

    def run(pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"well": [], "row_number": [], "structural": [], "prefix_cv": []})
        near = near.sort_values("anchor")
        surface = Surface(near[["x", "y"]].to_numpy(float), near["level"].to_numpy(float), neighbours=count)
        frame, at = frame_of(pdf)
        known = np.isfinite(frame["TVT_input"])
        level = surface(np.c_[frame["X"], frame["Y"]]) - frame["Z"]
        miss = (frame["TVT_input"] - level)[known]
        n, errors = len(miss), []
        for f in fractions:
            cut = int(min(max(round(f * n), 20), n - 10))
            errors.append(miss[cut : cut + max(10, n // 10)] - np.median(miss[:cut]))
        cv = float(np.sqrt(np.mean(np.concatenate(errors) ** 2)))
        return pd.DataFrame({"well": pdf["well"].iloc[0], "row_number": at[~known], "structural": level[~known] + np.median(miss), "prefix_cv": cv})

    return observable(series).groupBy("well").cogroup(own.groupBy("well")).applyInPandas(run, "well string, row_number int, structural double, prefix_cv double")


def weights(series: DataFrame, error: str, settings: Sequence[tuple[float, bool]]) -> DataFrame:
    """``(*columns, correlation, on_simplex, pf, hmm, structural)``: the experts' weights for each row's prefix error ``error``, under each ``(correlation,
    on_simplex)``."""

    def run(parts):
        for t in parts:
            for pair, simplex in settings:
                made = [states.expert_weights(float(v), states.FusionSettings(pair_correlation=pair, on_simplex=simplex))[0] for v in t[error]]
                out = t.copy()
                out["correlation"], out["on_simplex"] = pair, simplex
                for i, name in enumerate(("pf", "hmm", "structural")):
                    out[name] = [float(w[i]) for w in made]
                yield out

    kinds = ", ".join(f"`{c}` {k}" for c, k in series.dtypes)
    return series.mapInPandas(run, f"{kinds}, correlation double, on_simplex boolean, pf double, hmm double, structural double")
