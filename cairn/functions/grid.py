"""Forward-backward smoothing of a curve coordinate on a grid of values by slopes.

The density is a matrix ``[slope, value]``. A step moves each slope's row by its own fractional distance, blurs values, and mixes
slopes with a pull to their prior; the backward step is its transpose. Every row of a series is a step, visible or hidden, and the
whole visible part calibrates. What a step does follows from its length and rise alone, so distances, shares and the slopes' mixing
matrix are worked out once for each distinct step. A matrix is held from the first to the last value at which it is not zero: visible
rows leave few, and the backward pass needs no others than those in reach. Forward matrices are kept at segment starts only and the rest of a segment is computed again when the backward pass
reaches it, which ends at the first hidden row, as no earlier row is asked for; emissions are made a segment at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from cairn.functions.particles import Curve, start_rate


@dataclass(frozen=True)
class GridSettings:
    """Constants of the model. ``stride``, ``prefix_rows`` and ``calibration_rows`` thin it out where that is asked for: every so many
    rows, and the last so many visible ones. ``segment``: rows of a segment, at least; a long series has no more segments than rows in one.
    """

    step: float = 0.5
    margin: float = 25.0
    slopes: int = 25
    slope_max: float = 0.15
    slope_walk: float = 0.003
    slope_pull: float = 0.001
    slope_spread: float = 0.02
    blur: float = 0.005
    correlation_cap: float = 25.0
    calibration_rows: int | None = None
    distance_cap: float = 64.0
    floor: float = 0.004
    gap: int = 40
    gap_weight: float = 0.5
    noise_bounds: tuple[float, float] = (5.0, 40.0)
    prefix_rows: int | None = None
    clamp: float = 0.5
    stride: int = 1
    segment: int = 128


def _inner_fill(v: np.ndarray, limit: int) -> np.ndarray:
    at = np.flatnonzero(np.isfinite(v))
    if not len(at):
        return v.copy()
    i = np.arange(len(v))
    line = np.interp(i, at, v[at])
    before = np.maximum.accumulate(np.where(np.isfinite(v), i, -1))
    return np.where((i > at[0]) & (i < at[-1]) & (i - before <= limit), line, v)


def _memory_length(e: np.ndarray, cap: float, lags: int = 60, stop: float = 0.05) -> float:
    e = np.interp(np.arange(len(e)), np.flatnonzero(np.isfinite(e)), e[np.isfinite(e)]) if np.isfinite(e).any() else np.zeros(len(e))
    e = e - e.mean()
    if len(e) <= 80 or e.std() <= 1e-6:
        return 1.0
    r = np.array([np.mean(e[:-k] * e[k:]) for k in range(1, lags + 1)]) / np.mean(e * e)
    low = np.flatnonzero(r <= stop)
    return float(np.clip(1 + 2 * r[: low[0] if len(low) else lags].sum(), 1, cap))


class GridSmoother:
    def __init__(self, frame: dict[str, np.ndarray], curve: Curve, settings: GridSettings = GridSettings()):
        c, known = settings, np.isfinite(frame["TVT_input"])
        seen, hidden = np.flatnonzero(known), np.flatnonzero(~known)
        self.c, self.frame, self.hidden = c, frame, hidden
        self.values = np.arange(curve.at[0] - c.margin, curve.at[-1] + c.margin + c.step, c.step)
        self.slopes = np.linspace(-c.slope_max, c.slope_max, c.slopes)
        self.sampled = np.unique(np.r_[hidden[:: c.stride], hidden[-1]])
        self.rows = np.union1d(seen[-(c.prefix_rows or 0) :][:: c.stride], self.sampled)
        md, z = frame["MD"][self.rows], frame["Z"][self.rows]
        self.d_md, self.d_z = np.clip(np.diff(md), 0.25, 12.0), np.diff(z)
        tail = seen[-(c.calibration_rows or 0) :]
        gr, ref = frame["GR"][tail], curve(frame["TVT_input"][tail])
        both = np.isfinite(gr)
        offset = float(np.median((gr - ref)[both])) if both.any() else 0.0
        miss = gr - ref - offset
        scale = 1.4826 * np.nanmedian(np.abs(miss - np.nanmedian(miss))) if both.any() else np.nan
        if not scale > 0:
            scale = np.nanstd(miss) if both.any() and np.nanstd(miss) > 0 else c.noise_bounds[1]
        self.offset, self.scale = offset, float(np.clip(scale, *c.noise_bounds))
        self.memory = _memory_length(miss, c.correlation_cap)
        self.reference = curve(self.values) + offset
        p = seen[-200:]
        first = start_rate(frame["MD"][p], frame["TVT_input"][p] + frame["Z"][p], 200) if len(p) > 5 else 0.0
        self.slope = float(np.clip(first, -0.8 * c.slope_max, 0.8 * c.slope_max))
        prior = np.exp(-0.5 * ((self.slopes - self.slope) / c.slope_spread) ** 2)
        self.prior = prior / prior.sum()
        raw, filled = frame["GR"][self.rows], _inner_fill(frame["GR"], c.gap)[self.rows]
        self.gr = filled
        self.segment = max(c.segment, math.isqrt(len(self.rows)))
        self._steps: dict[tuple[float, float, int], tuple] = {}
        self._emitted: dict[int, np.ndarray] = {}
        self.weight = np.where(np.isfinite(raw), 1.0, np.where(np.isfinite(filled), c.gap_weight, 0.0))

    def emission(self, t: int) -> np.ndarray:
        low = t // self.segment * self.segment
        if low not in self._emitted:
            if len(self._emitted) > 1:
                self._emitted.pop(next(iter(self._emitted)))
            self._emitted[low] = self._emissions(np.arange(low, min(low + self.segment, len(self.rows))))
        return self._emitted[low][t - low]

    def _emissions(self, t: np.ndarray) -> np.ndarray:
        c = self.c
        feet = np.where(t > 0, self.d_md[np.maximum(t - 1, 0)] if len(self.d_md) else 1.0, 1.0)
        share = self.weight[t] * np.minimum(feet / self.memory, 1.0)
        d = share[:, None] * ((np.nan_to_num(self.gr[t])[:, None] - self.reference) / self.scale) ** 2
        out = np.where(self.weight[t][:, None] > 0, c.floor + (1 - c.floor) * np.exp(-0.5 * np.minimum(d, c.distance_cap)), 1.0)
        tvt = self.frame["TVT_input"][self.rows[t]]
        seen = np.flatnonzero(np.isfinite(tvt))
        out[seen] *= np.exp(-0.5 * ((self.values - tvt[seen, None]) / c.clamp) ** 2)
        return out

    def _step(self, t: int, sign: int) -> tuple[list[tuple[slice, int]], tuple[np.ndarray, np.ndarray], tuple[int, int], float, np.ndarray]:
        """Of the step to row ``t``: slopes that move by the same whole number of values, shares that move just so far and one
        further, how far the step reaches down and up, blur, and mixing matrix."""
        d_md, d_z = float(self.d_md[t - 1]), float(self.d_z[t - 1])
        key = (d_md, d_z, sign)
        if key not in self._steps:
            if len(self._steps) >= 64:
                self._steps.clear()
            bins = sign * (self.slopes * d_md - d_z) / self.c.step
            n = len(self.values)
            whole = np.clip(np.floor(bins), -n - 1, n).astype(int)  # so far and further all leave the grid
            part = (bins - np.floor(bins))[:, None]
            edges = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(whole)]
            alike = [(slice(i, j), int(whole[i])) for i, j in zip(edges[:-1], edges[1:])]
            reach = max(0, -int(whole.min())) + 1, max(0, int(whole.max()) + 1) + 1
            k, pull = min(self.c.slope_walk * d_md, 0.45), min(self.c.slope_pull * d_md, 0.1)
            s = len(self.slopes)
            mix = (1 - 2 * k - pull) * np.eye(s) + k * (np.eye(s, k=1) + np.eye(s, k=-1)) + pull * self.prior[:, None]
            mix[0, 0] += k  # the outermost slopes stand for what lies beyond them
            mix[-1, -1] += k
            self._steps[key] = (alike, (1 - part, part), reach, min(self.c.blur * d_md, 0.24), mix)
        return self._steps[key]

    def _window(self, low: int, high: int, reach: tuple[int, int]) -> tuple[int, int]:
        return max(0, low - reach[0]), min(len(self.values), high + reach[1])

    def _move(self, m: np.ndarray, alike: list[tuple[slice, int]], shares: tuple[np.ndarray, np.ndarray], reach: tuple[int, int], low: int = 0) -> np.ndarray:
        """``m`` begins at value ``low``; what is made begins where ``_window`` does."""
        begin, end = self._window(low, low + m.shape[1], reach)
        out = np.zeros((len(m), end - begin))
        stay, late = m * shares[0], m * shares[1]
        for rows, whole in alike:
            for share, by in ((stay, whole), (late, whole + 1)):
                at = low + by - begin
                a, b = max(0, -at), min(m.shape[1], end - begin - at)
                if a < b:
                    out[rows, at + a : at + b] += share[rows, a:b]
        return out

    def _blur(self, m: np.ndarray, k: float) -> np.ndarray:
        out = (1 - 2 * k) * m
        side = k * m
        out[:, 1:] += side[:, :-1]
        out[:, :-1] += side[:, 1:]
        return out

    def _normal(self, m: np.ndarray, low: int = 0) -> tuple[np.ndarray, float, int]:
        """Divided by its total, which comes with it; even over the whole grid if there is no total."""
        total = float(m.sum())
        return (m / total, total, low) if total > 0 and np.isfinite(total) else (self._even(), 1e-300, 0)

    def _held(self, m: np.ndarray, low: int) -> tuple[np.ndarray, int]:
        """Without the values at both ends where all is zero."""
        if m[:, 0].any() and m[:, -1].any():
            return m, low
        some = np.flatnonzero(m.max(0))
        return m[:, some[0] : some[-1] + 1], low + int(some[0])

    def _even(self) -> np.ndarray:
        shape = len(self.slopes), len(self.values)
        return np.full(shape, 1 / (shape[0] * shape[1]))

    def ahead(self, m: np.ndarray, t: int, low: int = 0) -> tuple[np.ndarray, float, int]:
        """The density of row ``t`` from that of the row before, which begins at value ``low``; its likelihood; where it begins."""
        *places, reach, k, mix = self._step(t, 1)
        begin, end = self._window(low, low + m.shape[1], reach)
        m = mix @ self._blur(self._move(m, *places, reach, low), k)
        m *= self.emission(t)[begin:end]
        return self._normal(m, begin)

    def back(self, m: np.ndarray, t: int, low: int, into: tuple[int, int]) -> np.ndarray:
        """What rows from ``t`` on say of the row before, at the values ``into``, from what those behind ``t`` say of ``t``."""
        *places, reach, k, mix = self._step(t, -1)
        begin, end = self._window(low, low + m.shape[1], (1, 1))
        wide = np.zeros((len(m), end - begin))
        wide[:, low - begin : low - begin + m.shape[1]] = mix @ (m * self.emission(t)[low : low + m.shape[1]])
        m = self._move(self._blur(wide, k), *places, reach, begin)
        begin, _ = self._window(begin, end, reach)
        m = m[:, into[0] - begin : into[1] - begin]
        total = float(m.sum())
        return m / total if total > 0 and np.isfinite(total) else np.full(m.shape, 1 / m.size)

    def run(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean and standard deviation at every hidden row, and the log-likelihood."""
        n, k, first = len(self.rows), self.segment, int(np.searchsorted(self.rows, self.hidden[0]))
        m, total, low = self._normal(self._even() * self.emission(0))
        m, low = self._held(m, low)
        logl, starts, part = np.log(max(total, 1e-300)), {0: (m, low)}, [(m, low)]
        near = [] if first else [(0, len(self.values))]  # what rows from the first hidden one on can reach
        for t in range(1, n):
            m, total, low = self.ahead(m, t, low)
            m, low = self._held(m, low)
            logl += np.log(max(total, 1e-300))
            if t == first:
                near.append((low, low + m.shape[1]))
            elif t > first:
                near.append(self._window(*near[-1], self._step(t, 1)[2]) if total > 1e-300 else (0, len(self.values)))
            if t % k == 0:
                starts, part = {s: d for s, d in starts.items() if s + k > first} | {t: (m, low)}, []
            part.append((m, low))
        mean, std, b = np.empty(n), np.empty(n), np.ones((len(self.slopes), near[-1][1] - near[-1][0]))
        for begin in sorted((s for s in starts if s + k > first), reverse=True):
            if begin + k < n:  # all but the last, which is at hand
                m, low = starts[begin]
                part = [(m, low)]
                for t in range(begin + 1, begin + k):
                    m, _, low = self.ahead(m, t, low)
                    m, low = self._held(m, low)
                    part.append((m, low))
            for t in range(begin + len(part) - 1, max(begin, first) - 1, -1):
                m, low = part[t - begin]
                at, of = self.values[low : low + m.shape[1]], near[t - first][0]
                p = (m * b[:, low - of : low - of + m.shape[1]]).sum(0)
                if not (p.sum() > 0 and np.isfinite(p.sum())):
                    p = m.sum(0)
                p = p / p.sum()
                mean[t] = p @ at
                std[t] = np.sqrt(max(p @ (at - mean[t]) ** 2, 0))
                if t > first:
                    b = self.back(b, t, of, near[t - first - 1])
        own = np.isin(self.rows, self.sampled)
        if self.c.stride == 1:
            return mean[own], std[own], float(logl)
        at, md = self.frame["MD"][self.hidden], self.frame["MD"][self.rows][own]
        return np.interp(at, md, mean[own]), np.interp(at, md, std[own]), float(logl)
