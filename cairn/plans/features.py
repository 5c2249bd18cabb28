"""The frozen matrix of 121 features of hidden rows, as column expressions.

Input rows: one for each row of a series with ``rn``, position ``md``, ``x``, ``y``, ``z``, signal ``gr``, visible level ``tvt`` (null
where hidden) and expert columns ``pf``, ``pf_std``, ``hmm``. Nothing reads a truth column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.expr import clip, or_zero
from cairn.operators import ordered as o

#: Names of the features and the offsets, windows and shifts of their families.
BEAMS = {"cons": (0.75, 0.25, 0.0), "loose": (1.15, 0.0, 0.0), "vcons": (0.5, 0.5, 0.0), "sm5": (0.8, 0.0, 0.2), "vloose": (1.3, 0.0, 0.0), "mid": (0.5, 0.5, 0.0), "stiff": (0.0, 1.0, 0.0)}
WIDE = (-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80)
MIDDLE = (-40, -20, -10, -5, -3, 0, 3, 5, 10, 20, 40)
NARROW = (-30, -15, -8, -4, -2, 0, 2, 4, 8, 15, 30)
WINDOWS = (5, 21, 51, 101)
SHIFTS = (1, 5, 15, 30)
FAMILIES = {"tda": ("hmm", WIDE), "tdbc": ("_beam_cons", MIDDLE), "tdsc": ("_cons", NARROW), "tdpf": ("pf", NARROW)}
NAMES = sorted(
    "last_known_tvt pf_ancc pf_ancc_std pf_ancc_delta pf_z pf_z_delta pf_vs_z beam_mean_d beam_std_d beam_med_d sc8_d sc8_sc sc15_d sc15_sc sc25_d sc25_sc sc_cons_d sc_ens_d sc_trust hyb_d sc_vs_beam cal_a cal_b pfx_rmse known_len eval_len slp_all slp_50 slp_z slp_b_d_all slp_b_d_50 ktvt_range ktvt_std md_since frac frac2 sqrt_frac z dx dy dz dxy dzdmd dxdmd dydmd gr gr_d1 gr_d2 gr_env gr_nrg gr_vs_tw_anc gr_vs_slp_all tw_range tw_gr_mean".split()
    + [f"beam_{k}_d" for k in BEAMS] + [f"{n}{o}" for n, (_, offsets) in FAMILIES.items() for o in offsets] + [f"gr{s}{w}" for s in "ms" for w in WINDOWS] + [f"g{s}{k}" for s in ("lag", "lead") for k in SHIFTS]
)


def _array_stats(values: list[Column]) -> tuple[Column, Column, Column]:
    """Mean, population deviation and median across columns of a row."""
    a, n = F.array(*values), len(values)
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    spread = F.sqrt(F.aggregate(F.transform(a, lambda v: F.pow(v - mean, 2)), F.lit(0.0), lambda s, v: s + v) / n)
    s = F.sort_array(a)
    median = s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    return mean, spread, median


def curve_arrays(typewell: DataFrame, key: str, at: str = "tvt", value: str = "gr") -> DataFrame:
    """``(key, _tx, _ty, …)``: each series' reference curve as two arrays in order, gaps filled; one small row for each series."""
    t = o.number_rows(typewell.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_x"), F.col(value).alias("_y")), key, ["_x"])
    t = o.fill_linear(t, key, "_y", "_f").withColumn("_f", F.coalesce("_f", F.lit(0.0)))
    g = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_x", "_f"))).alias("_c"), (F.max("_x") - F.min("_x")).alias("tw_range"), F.avg("_f").alias("tw_gr_mean"))
    return g.select(key, F.transform("_c", lambda r: r["_x"].cast("double")).alias("_tx"), F.transform("_c", lambda r: r["_f"].cast("double")).alias("_ty"), "tw_range", "tw_gr_mean")


def look_up(x: Column, tx: Column, ty: Column) -> Column:
    """The curve at ``x`` by a binary search over its knots, however many, constant beyond the ends. Lambdas are interpreted: for many places
    of a row use ``at_places``, which gives the same values."""
    span = F.size(tx)
    start = F.struct(F.lit(0).alias("lo"), (span - 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(tx, mid) <= x
        return F.struct(F.when(right & (s["hi"] - s["lo"] > 1), mid).otherwise(s["lo"]).alias("lo"), F.when(~right & (s["hi"] - s["lo"] > 1), mid).otherwise(s["hi"]).alias("hi"))

    def line(s: Column) -> Column:
        x0, y0 = F.get(tx, s["lo"]), F.get(ty, s["lo"])
        x1, y1 = F.get(tx, s["hi"]), F.get(ty, s["hi"])
        return F.when(x <= x0, y0).when(x >= x1, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    halvings = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(span, F.lit(2)))).cast("int"))
    return F.when(span > 0, F.aggregate(F.sequence(F.lit(1), halvings), start, halve, line))


def _values(x: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """``look_up`` over arrays. As in Spark, NaN is above all numbers."""
    lo = np.clip(np.searchsorted(tx, x, "right") - 1, 0, max(len(tx) - 2, 0))
    hi = np.minimum(lo + 1, len(tx) - 1)
    x0, y0, x1, y1 = tx[lo], ty[lo], tx[hi], ty[hi]
    with np.errstate(all="ignore"):
        line = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return np.where((x <= x0) | np.isnan(x0), y0, np.where((x >= x1) | np.isnan(x), y1, line))


def at_places(rows: DataFrame, curves: DataFrame, key: str, places: Sequence[tuple[str, Sequence[float]]], name: str) -> DataFrame:
    """Rows of series with a curve of ``curve_arrays``, in order of ``rn`` within their series, and the array ``name`` of the curve's values at
    each column of ``places`` plus each of its offsets. A curve goes with the first row of its series, not with each, and is never broadcast."""
    t = rows.withColumn("_first", F.row_number().over(o.ordered(key)) == 1).join(curves.select(key, "_tx", "_ty").hint("merge"), key)
    t = t.withColumns({c: F.when(F.col("_first"), F.col(c)) for c in ("_tx", "_ty")}).drop("_first").sortWithinPartitions(key, "rn")
    kept = [c for c in t.columns if c not in ("_tx", "_ty")]
    kind = T.StructType([t.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tx, ty = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, curve = b.column(key), (b.column("_tx"), b.column("_ty"))
            new = (np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
            x = np.concatenate([b.column(c).to_numpy(zero_copy_only=False)[:, None] + np.asarray(offsets, float) for c, offsets in places], 1)
            none = np.concatenate([np.repeat(b.column(c).is_null().to_numpy(zero_copy_only=False)[:, None], len(offsets), 1) for c, offsets in places], 1)
            made = np.empty(x.shape)
            for i, j in zip([0, *new], [*new, b.num_rows]):
                if i or keys[0].as_py() != now:
                    if not curve[0][i].is_valid:
                        raise RuntimeError(f"series {keys[i]} does not begin with its curve")
                    tx, ty = (c[i].values.to_numpy() for c in curve)
                made[i:j] = _values(x[i:j], tx, ty)
            now = keys[b.num_rows - 1].as_py()
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(made.ravel(), mask=none.ravel()))], names=kind.names)

    return t.mapInArrow(stream, kind)


def series_constants(rows: DataFrame, key: str) -> DataFrame:
    """One row for each series: what its visible part says."""
    known = rows.where("tvt is not null")
    w = o.ordered(key)
    t = known.withColumns({"_dm": F.col("md") - F.lag("md").over(w), "_dt": F.col("tvt") - F.lag("tvt").over(w), "_du": F.col("tvt") + F.col("z") - F.lag(F.col("tvt") + F.col("z")).over(w), "_n": F.count("*").over(o.whole(key)), "_k": F.row_number().over(w)})
    step = lambda c, extra=F.lit(True): F.when((F.col("_dm") > 0) & extra, F.col(c) / F.col("_dm"))
    late = F.col("_k") > F.col("_n") - 50 + 1  # steps between the last fifty rows
    slope = lambda c: F.when(F.count(c) >= 3, F.median(c)).otherwise(F.lit(0.0))
    last = lambda c: F.max_by(c, "rn")
    return t.groupBy(key).agg(
        last("tvt").alias("last_known_tvt"), last("md").alias("_md0"), last("x").alias("_x0"), last("y").alias("_y0"), last("z").alias("_z0"), F.count("*").cast("double").alias("known_len"),
        slope(step("_dt")).alias("slp_all"), slope(step("_dt", late)).alias("slp_50"), slope(step("_du")).alias("slp_z"),
        (F.max("tvt") - F.min("tvt")).alias("ktvt_range"), F.stddev_pop("tvt").alias("ktvt_std"), F.avg("gr_fill").alias("_gr_known"),
    )


def calibration(known: DataFrame, curves: DataFrame, key: str) -> DataFrame:
    """``(key, cal_a, cal_b, pfx_rmse)`` of the filled signal on the curve at the visible level; 1, 0, 30 for fewer than twenty rows."""
    t = at_places(known.select(key, "rn", "tvt", F.col("gr_fill").alias("_y")), curves, key, [("tvt", [0.0])], "_x").select(key, "rn", "_y", F.col("_x")[0].alias("_x"))
    w = o.ordered(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"_n": F.count("*").over(w), "cal_a": clip(F.coalesce(F.regr_slope("_y", "_x").over(w), F.lit(0.0)), 0.25, 4.0)})
    t = t.withColumn("_b", F.median(F.col("_y") - F.col("cal_a") * F.col("_x")).over(o.whole(key)))
    made = t.groupBy(key).agg(F.first("_n").alias("_n"), F.first("cal_a").alias("cal_a"), clip(F.first("_b"), -500.0, 500.0).alias("cal_b"), F.sqrt(F.avg(F.pow(F.col("_y") - F.col("cal_a") * F.col("_x") - clip(F.col("_b"), -500.0, 500.0), 2))).alias("pfx_rmse"))
    few = F.col("_n") < 20
    return made.select(key, F.when(few, 1.0).otherwise(F.col("cal_a")).alias("cal_a"), F.when(few, 0.0).otherwise(F.col("cal_b")).alias("cal_b"), F.when(few, 30.0).otherwise(F.col("pfx_rmse")).alias("pfx_rmse"))


def build(rows: DataFrame, typewell: DataFrame, key: str = "well") -> DataFrame:
    """``(key, rn, <121 features in order of name>)`` for every hidden row."""
    rows = rows.select(key, "rn", "md", "x", "y", "z", "gr", "tvt", "pf", "pf_std", "hmm")
    t = o.fill_linear(rows, key, "gr", "gr_fill").withColumn("gr_fill", F.coalesce("gr_fill", F.lit(0.0)))
    t = o.rolling(t, key, "gr_fill", WINDOWS)
    t = o.shifts(t, key, "gr_fill", SHIFTS)
    t = o.gradient(o.gradient(t, key, "gr_fill", "gr_d1"), key, "gr_d1", "gr_d2")
    curves = curve_arrays(typewell, key)
    const = series_constants(t, key).join(calibration(t.where("tvt is not null"), curves, key), key).join(curves.select(key, "tw_range", "tw_gr_mean"), key)
    t = t.where("tvt is null").drop("gr", "tvt").join(const, key)
    t = t.withColumn("eval_len", F.count("*").over(o.whole(key)).cast("double"))
    t = t.withColumns({"md_since": F.col("md") - F.col("_md0"), "frac": (F.col("rn") - F.col("known_len") + 1) / F.col("eval_len")})
    h, last = F.col("md_since"), F.col("last_known_tvt")
    t = t.withColumns({f"_beam_{k}": last + (a * F.col("slp_50") + b * F.col("slp_all") + c * F.col("slp_z")) * h for k, (a, b, c) in BEAMS.items()})
    mean, spread, median = _array_stats([F.col(f"_beam_{k}") for k in BEAMS])
    t = t.withColumns({"_bm": mean, "_bs": spread, "_bd": median, "pf_z": last + F.col("_z0") - F.col("z"), "_line_all": last + F.col("slp_all") * h, "_line_50": last + F.col("slp_50") * h})
    pf, hmm = F.col("pf"), F.col("hmm")
    ens, apart, _ = _array_stats([pf, hmm, F.col("_bm"), F.col("pf_z")])
    t = t.withColumns({"_sc8": 0.8 * pf + 0.2 * hmm, "_sc15": 0.85 * pf + 0.15 * hmm, "_sc25": 0.75 * pf + 0.25 * hmm, "_cons": 0.5 * pf + 0.25 * hmm + 0.25 * F.col("_bd"), "_ens": ens, "sc_trust": 1 / (1 + F.pow(apart / 6.0, 2))})
    asked = {"gr_vs_tw_anc": ("pf_z", (0.0,)), "gr_vs_slp_all": ("_line_all", (0.0,))} | FAMILIES
    t = at_places(t, curves, key, list(asked.values()), "_ref")
    named = [f"{name}{off}" if name in FAMILIES else name for name, (_, offsets) in asked.items() for off in offsets]
    residual = {k: F.col("gr_fill") - (F.col("cal_a") * F.col("_ref")[i] + F.col("cal_b")) for i, k in enumerate(named)}
    per = lambda c: c / F.greatest(h, F.lit(1e-6))
    dx, dy, dz = F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0"), F.col("z") - F.col("_z0")
    made = {
        "pf_ancc": pf, "pf_ancc_std": F.col("pf_std"), "pf_ancc_delta": pf - last, "pf_z_delta": F.col("pf_z") - last, "pf_vs_z": pf - F.col("pf_z"),
        "beam_mean_d": F.col("_bm") - last, "beam_std_d": F.col("_bs"), "beam_med_d": F.col("_bd") - last,
        "sc_cons_d": F.col("_cons") - last, "sc_ens_d": F.col("_ens") - last, "sc_vs_beam": F.col("_cons") - F.col("_bd"),
        "hyb_d": F.col("sc_trust") * F.col("_cons") + (1 - F.col("sc_trust")) * F.col("_bd") - last,
        "slp_b_d_all": F.col("_line_all") - F.col("_bd"), "slp_b_d_50": F.col("_line_50") - F.col("_bd"),
        "frac2": F.col("frac") * F.col("frac"), "sqrt_frac": F.sqrt("frac"), "dx": dx, "dy": dy, "dz": dz, "dxy": F.hypot(dx, dy), "dzdmd": per(dz), "dxdmd": per(dx), "dydmd": per(dy),
        "gr": F.col("gr_fill"), "gr_env": F.abs(F.col("gr_fill") - F.col("gr_fill_mean51")), "gr_nrg": F.pow(F.col("gr_fill") - F.col("_gr_known"), 2),
        **residual,
    }
    for k in ("8", "15", "25"):
        made[f"sc{k}_d"], made[f"sc{k}_sc"] = F.col(f"_sc{k}") - last, (F.col(f"_sc{k}") - F.col("_bm")) / F.greatest(F.col("_bs"), F.lit(1e-3))
    made |= {f"beam_{k}_d": F.col(f"_beam_{k}") - last for k in BEAMS}
    made |= {f"grm{w}": F.col(f"gr_fill_mean{w}") for w in WINDOWS} | {f"grs{w}": F.col(f"gr_fill_std{w}") for w in WINDOWS}
    made |= {f"glag{k}": F.col(f"gr_fill_lag{k}") for k in SHIFTS} | {f"glead{k}": F.col(f"gr_fill_lead{k}") for k in SHIFTS}
    for c in "last_known_tvt pf_z sc_trust cal_a cal_b pfx_rmse known_len eval_len slp_all slp_50 slp_z ktvt_range ktvt_std md_since frac z gr_d1 gr_d2 tw_range tw_gr_mean".split():
        made[c] = F.col(c)
    if sorted(made) != NAMES or len(NAMES) != 121:
        raise AssertionError(f"features differ: {sorted(set(made) ^ set(NAMES))}")
    return t.select(key, "rn", *(or_zero(made[c].cast("double")).alias(c) for c in sorted(made)))
