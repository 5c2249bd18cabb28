"""Matching a signal to a reference curve: beam search over knots, window correlation, and a velocity filter.

These feed the second builder of the 121 features, which shares names with the frozen one but not formulas.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from cairn.functions.particles import fill_by_index

#: Width, cost of a move, variance, smoothing radius of each beam.
BEAMS = {"cons": (10, 20.0, 144.0, 2), "loose": (10, 8.0, 64.0, 2), "vcons": (8, 35.0, 220.0, 1), "sm5": (10, 14.0, 90.0, 5), "vloose": (20, 4.0, 36.0, 3), "mid": (12, 12.0, 100.0, 3), "stiff": (15, 25.0, 180.0, 2)}
SCALES = (8, 15, 25)


def series_seed(base: int, well: str) -> int:
    """32 bits that follow from the base seed and the series' name."""
    if isinstance(base, bool) or not 0 <= base <= 0xFFFFFFFF or not well or "\0" in well:
        raise ValueError("the base seed must be 32 bits and the name not empty")
    return int.from_bytes(hashlib.sha256(f"{base}:{well}".encode()).digest()[:4], "little")


def rolling_mean(v: np.ndarray, radius: int) -> np.ndarray:
    """Centered, over the rows there are; gaps are skipped."""
    ok = np.isfinite(v)
    total, n = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(ok, v, 0.0), ok.astype(float)))
    i = np.arange(len(v))
    lo, hi = np.maximum(i - radius, 0), np.minimum(i + radius + 1, len(v))
    with np.errstate(invalid="ignore"):
        return (total[hi] - total[lo]) / (n[hi] - n[lo])


def nearest_knot(at: np.ndarray, x: float) -> int:
    i = int(np.clip(np.searchsorted(at, x), 1, len(at) - 1))
    return i - 1 if x - at[i - 1] <= at[i] - x else i


def beam(signal: np.ndarray, reference: np.ndarray, start: int, width: int, move_cost: float, variance: float, reach: int = 2) -> np.ndarray:
    """Knot of each row on the cheapest path that a beam of ``width`` keeps: squared misfit over the variance plus a cost for each
    knot moved, at most ``reach`` a row. Paths that meet at a knot keep the cheaper; ties go to the lower knot."""
    steps = np.arange(-reach, reach + 1)
    knots, cost, trail = np.array([start]), np.zeros(1), []
    for g in signal:
        to = (knots[:, None] + steps).ravel()
        total = (cost[:, None] + move_cost * np.abs(steps)).ravel()
        source = np.repeat(np.arange(len(knots)), len(steps))
        inside = (to >= 0) & (to < len(reference))
        to, total, source = to[inside], total[inside], source[inside]
        order = np.lexsort((source, total, to))
        first = np.concatenate([[True], np.diff(to[order]) > 0])
        own = order[first]
        total = total + (g - reference[to]) ** 2 / variance
        own = own[np.argsort(total[own], kind="stable")[:width]]
        knots, cost = to[own], total[own]
        trail.append((knots, source[own]))
    out, k = np.empty(len(signal), dtype=np.int64), int(np.argmin(cost)) if len(signal) else 0
    for t in range(len(signal) - 1, -1, -1):
        out[t], k = trail[t][0][k], trail[t][1][k]
    return out


def window_match(known: np.ndarray, level: np.ndarray, hidden: np.ndarray, half: int, stride: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each hidden row the level at the visible window that correlates best with the window around it, and the correlation."""
    size = 2 * half + 1
    if len(known) <= size or not len(hidden):
        return np.full(len(hidden), level[-1]), np.zeros(len(hidden))
    norm = lambda w: (w - w.mean(1, keepdims=True)) / (w.std(1, keepdims=True) + 1e-6)
    view = np.lib.stride_tricks.sliding_window_view
    starts = np.arange(0, len(known) - size + 1, stride)
    a = norm(view(rolling_mean(known, 2), size)[starts])
    b = norm(view(np.pad(rolling_mean(hidden, 2), half, mode="edge"), size))
    best, score = np.empty(len(b), dtype=np.int64), np.empty(len(b))
    for at in range(0, len(b), 2048):  # a strip of rows against all windows
        r = b[at : at + 2048] @ a.T / size
        best[at : at + 2048], score[at : at + 2048] = r.argmax(1), r.max(1)
    return level[starts[best] + half], score


@dataclass(frozen=True)
class VelocitySettings:
    particles: int = 600
    momentum: float = 0.993
    velocity_noise: float = 0.005
    level_noise: float = 0.01
    start_spread: float = 0.5
    start_velocity_spread: float = 0.02
    smooth_weight: float = 0.3
    jitter: tuple[float, float] = (0.2, 0.003)
    radius: int = 2


def velocity_track(frame: dict[str, np.ndarray], at: np.ndarray, value: np.ndarray, sigma: float, seed: int, s: VelocitySettings = VelocitySettings()) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the hidden level: particles with a velocity that should follow the slope of elevation as it did in the
    visible part, weighted by raw and smoothed signal. Rows without signal weigh by velocity alone."""
    known = np.isfinite(frame["TVT_input"])
    md, z, tvt = frame["MD"], frame["Z"], frame["TVT_input"]
    d_md, d_z, d_t = np.diff(md[known]), np.diff(z[known]), np.diff(tvt[known])
    go = d_md > 0
    beta, base, spread = -1.0, 0.0, 0.1
    if go.sum() >= 10:
        vz, vt = d_z[go] / d_md[go], d_t[go] / d_md[go]
        beta, base = np.linalg.lstsq(np.stack([vz, np.ones_like(vz)], 1), vt, rcond=None)[0]
        spread = max(float(np.std(vt - beta * vz - base)), 0.001)
    late = (d_t / np.where(go, d_md, 1))[go & (np.arange(len(go)) >= len(go) - 19)]
    rng, n, hidden = np.random.default_rng(seed), s.particles, np.flatnonzero(~known)
    x = tvt[known][-1] + s.start_spread * rng.standard_normal(n)
    v = (np.median(late) if len(late) >= 3 else 0.0) + s.start_velocity_spread * rng.standard_normal(n)
    w, smooth_signal, smooth_curve = np.full(n, 1 / n), rolling_mean(frame["GR"], s.radius), rolling_mean(value, s.radius)
    step = np.maximum(np.diff(md[hidden], prepend=md[hidden[0]] - 1), 1.0)
    want = beta * np.diff(z[hidden], prepend=z[hidden[0]] - 1) / step + base
    like = lambda d: np.maximum(np.exp(-0.5 * np.minimum(d * d, 600)), 1e-300)
    mean, std = np.empty(len(hidden)), np.empty(len(hidden))
    for t, row in enumerate(hidden):
        v = s.momentum * v + s.velocity_noise * rng.standard_normal(n)
        x = np.clip(x + v * step[t] + s.level_noise * rng.standard_normal(n), at[0] - 50, at[-1] + 50)
        if np.isfinite(frame["GR"][row]):
            p = like((frame["GR"][row] - np.interp(x, at, value)) / sigma)
            w = w * ((1 - s.smooth_weight) * p + s.smooth_weight * like((smooth_signal[row] - np.interp(x, at, smooth_curve)) / (1.5 * sigma)))
        w = w * like((v - want[t]) / max(2 * spread, 0.005))
        w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
        if (w * w).sum() * 0.5 * n > 1:
            chosen = np.minimum(np.searchsorted(np.cumsum(w), (rng.random() + np.arange(n)) / n), n - 1)
            x, v, w = x[chosen] + s.jitter[0] * rng.standard_normal(n), v[chosen] + s.jitter[1] * rng.standard_normal(n), np.full(n, 1 / n)
        mean[t] = w @ x
        std[t] = np.sqrt(w @ (x - mean[t]) ** 2)
    return mean, std


def signal_paths(gr: np.ndarray, known: np.ndarray, tvt: np.ndarray, at: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Beam paths ``beam_<name>``, window matches ``sc<half>`` with ``sc<half>_sc``, and their mixture ``sc_ens``, for hidden rows."""
    full = fill_by_index(gr, float(np.nanmean(value)))
    hidden, visible = full[~known], full[known]
    start = nearest_knot(at, tvt[known][-1])
    out = {f"beam_{k}": at[beam(rolling_mean(hidden, r), value, start, width, move, var)] for k, (width, move, var, r) in BEAMS.items()}
    for half in SCALES:
        out[f"sc{half}"], out[f"sc{half}_sc"] = window_match(visible, tvt[known], hidden, half)
    share = np.exp(3 * np.stack([out[f"sc{h}_sc"] for h in SCALES], 1))
    out["sc_ens"] = (share / share.sum(1, keepdims=True) * np.stack([out[f"sc{h}"] for h in SCALES], 1)).sum(1)
    return out
