"""The second builder of the 121 features: the same names with other formulas, single precision, seeds by series name.

One grouped map runs the matchers and filters of a series; the rest of each row is arithmetic on arrays there, because single
precision has to be kept from end to end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import matching as m
from cairn.functions import particles as pf
from cairn.operators import runs
from cairn.operators.experts import checked, observable
from cairn.plans.features import FAMILIES, MIDDLE, NARROW, SHIFTS, WIDE, WINDOWS

LEVEL = pf.FilterSettings(particles=600, start_spread=0.3, reach=50.0)
if set(FAMILIES) != {"tda", "tdbc", "tdsc", "tdpf"}:
    raise AssertionError("the families of both builders must agree")


def _line(x: np.ndarray, y: np.ndarray) -> float:
    ok = np.isfinite(x) & np.isfinite(y)
    return float(np.polyfit(x[ok], y[ok], 1)[0]) if ok.sum() >= 2 and np.std(x[ok]) >= 1e-6 else 0.0


def one_series(well: str, frame: dict[str, np.ndarray], curve: pf.Curve, base_seed: int, particles: int) -> dict[str, np.ndarray]:
    known = np.isfinite(frame["TVT_input"])
    last, hidden = int(np.flatnonzero(known)[-1]), np.flatnonzero(~known)
    at, value, tvt, n = curve.at, curve.value, frame["TVT_input"], int((~known).sum())
    seed = m.series_seed(base_seed, well)
    both = known & np.isfinite(frame["GR"])
    sigma = float(np.clip(np.std(frame["GR"][both] - curve(tvt[both])), 10, 60)) if both.sum() >= 20 else 30.0
    t = pf.track(frame, curve, [seed], pf.FilterSettings(**{**LEVEL.__dict__, "particles": particles}))
    level = t.path[0]
    velocity, _ = m.velocity_track(frame, at, value, sigma, seed + 1, m.VelocitySettings(particles=particles))
    gr = pf.fill_by_index(frame["GR"], float(np.nanmean(value)))
    paths = m.signal_paths(frame["GR"], known, tvt, at, value)
    beams = np.stack([paths[f"beam_{k}"] for k in m.BEAMS], 1)
    t0, h = tvt[last], frame["MD"][hidden] - frame["MD"][last]
    ref, ens = (paths["beam_cons"] + paths["beam_sm5"]) / 2, paths["sc_ens"]
    trust = float(np.clip(known.sum() / 200, 0, 0.6))
    at_known, seen = curve(tvt[known]), gr[known]
    calm = np.std(at_known) < 1e-6 or known.sum() < 20
    a, b = (1.0, float(seen.mean() - at_known.mean())) if calm else np.polyfit(at_known, seen, 1)
    slp = {"slp_all": _line(frame["MD"][known], tvt[known]), "slp_50": _line(frame["MD"][known][-50:], tvt[known][-50:]), "slp_z": _line(frame["Z"][known], tvt[known])}
    s, step = pd.Series(gr), pd.Series(frame["MD"]).diff().replace(0, np.nan)
    frac = np.arange(n) / max(n - 1, 1)
    line = t0 + slp["slp_all"] * h
    miss = lambda path: gr[hidden] - curve(path)
    d = {k: frame[k][hidden] - frame[k][last] for k in "XYZ"}
    out = {"last_known_tvt": t0, "pf_ancc": level, "pf_ancc_std": t.deviation[0], "pf_ancc_delta": level - t0, "pf_z": velocity, "pf_z_delta": velocity - t0, "pf_vs_z": level - velocity}
    out |= {f"beam_{k}_d": paths[f"beam_{k}"] - t0 for k in m.BEAMS} | {"beam_mean_d": beams.mean(1) - t0, "beam_std_d": beams.std(1), "beam_med_d": np.median(beams, 1) - t0}
    out |= {f"sc{k}_d": paths[f"sc{k}"] - t0 for k in m.SCALES} | {f"sc{k}_sc": paths[f"sc{k}_sc"] for k in m.SCALES}
    out |= {"sc_cons_d": np.mean([paths[f"sc{k}"] for k in m.SCALES], 0) - t0, "sc_ens_d": ens - t0, "sc_trust": trust, "hyb_d": (1 - trust) * ref + trust * ens - t0, "sc_vs_beam": ens - paths["beam_cons"]}
    out |= {"cal_a": a, "cal_b": b, "pfx_rmse": np.sqrt(np.mean((seen - at_known) ** 2)), "known_len": known.sum(), "eval_len": n, **slp, "slp_b_d_all": slp["slp_all"] * h, "slp_b_d_50": slp["slp_50"] * h}
    out |= {"ktvt_range": np.ptp(tvt[known]), "ktvt_std": tvt[known].std(), "md_since": h, "frac": frac, "frac2": frac**2, "sqrt_frac": np.sqrt(frac), "z": frame["Z"][hidden]}
    out |= {"dx": d["X"], "dy": d["Y"], "dz": d["Z"], "dxy": np.hypot(d["X"], d["Y"])} | {f"d{k.lower()}dmd": (pd.Series(frame[k]).diff() / step).to_numpy()[hidden] for k in "XYZ"}
    out |= {"gr": gr[hidden], "gr_d1": s.diff().fillna(0).to_numpy()[hidden], "gr_d2": s.diff().diff().fillna(0).to_numpy()[hidden]}
    out |= {"gr_env": s.rolling(21, center=True, min_periods=1).max().to_numpy()[hidden], "gr_nrg": np.sqrt((s * s).rolling(21, center=True, min_periods=1).mean().clip(lower=0)).to_numpy()[hidden]}
    out |= {"gr_vs_tw_anc": miss(np.full(n, t0)), "gr_vs_slp_all": miss(line), "tw_range": np.ptp(at), "tw_gr_mean": value.mean()}
    for name, path, offsets in (("tda", np.full(n, t0), WIDE), ("tdbc", ref, MIDDLE), ("tdsc", ens, NARROW), ("tdpf", level, NARROW)):
        out |= {f"{name}{o}": miss(path + o) for o in offsets}
    for w in WINDOWS:
        r = s.rolling(w, center=True, min_periods=1)
        out |= {f"grm{w}": r.mean().to_numpy()[hidden], f"grs{w}": r.std().fillna(0).to_numpy()[hidden]}
    for k in SHIFTS:
        out |= {f"glag{k}": s.shift(k).bfill().to_numpy()[hidden], f"glead{k}": s.shift(-k).ffill().to_numpy()[hidden]}
    return {k: np.broadcast_to(np.asarray(v, np.float32), n) for k, v in sorted(out.items())}


def build(series: DataFrame, curves: DataFrame, names: list[str], base_seed: int = 42, particles: int = 600) -> DataFrame:
    """``(well, id, <121 features>)`` of hidden rows; ``names`` is the frozen list, and any difference from it is an error. Series with
    fewer than ten visible rows or three knots are left out."""

    def run(key, own, at, value) -> runs.Columns:
        frame = checked(own, key[0])
        made = one_series(key[0], frame, pf.Curve(at, value), base_seed, particles)
        if list(made) != sorted(names):
            raise ValueError(f"features differ: {sorted(set(made) ^ set(names))}")
        hidden = own["row_number"][~np.isfinite(frame["TVT_input"])]
        return {"id": np.array([f"{key[0]}_{i}" for i in hidden.tolist()], object), **made}

    enough = series.groupBy("well").agg(F.count("TVT_input").alias("k"), F.count("*").alias("n")).where("k >= 10 and n > k").select(F.col("well").alias("k_well"))
    enough = enough.join(curves.groupBy("well").count().where("count >= 3").select(F.col("well").alias("c_well")), F.col("k_well") == F.col("c_well")).select("k_well")
    rows = observable(series).join(enough, F.col("well") == F.col("k_well"), "left_semi")
    return runs.by_series(runs.with_curves(rows, curves), ["well"], run, "well string, id string, " + ", ".join(f"`{n}` float" for n in sorted(names)))
