"""Sequential Monte Carlo along one series, all seeds at once.

State of a particle: structural level ``u`` (curve coordinate plus elevation) and its rate by depth. Arrays are ``[seed,
particle]``; every seed draws from a generator of its own, so a seed's path does not depend on which others run beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bytes of noise that a set of seeds keeps for the series that come after; later rows are drawn anew.
KEPT = 1 << 23
RATE_KINDS = ("median", "endpoint", "least_squares")


@dataclass(frozen=True)
class FilterSettings:
    """Constants of the model; ``chord`` measures steps along the path in space and scales decay and noise with them."""

    particles: int = 500
    start_spread: float = 4.5
    start_rate_spread: float = 0.01
    memory: float = 0.998
    rate_noise: float = 0.002
    level_noise: float = 0.005
    reach: float = 100.0
    resample_share: float = 0.5
    jitter: tuple[float, float] = (0.1, 0.001)
    noise_bounds: tuple[float, float] = (10.0, 60.0)
    distance_cap: float = 600.0
    chord: bool = False


def fill_by_index(v: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    """Gaps by straight lines over the row number, ends held; ``otherwise`` if there is no value at all."""
    ok = np.isfinite(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok]) if ok.any() else np.full(len(v), float(otherwise))


class Curve:
    """A reference log: knots in order, gaps of the value set to its mean."""

    def __init__(self, at: np.ndarray, value: np.ndarray):
        keep = np.isfinite(at)
        order = np.argsort(at[keep], kind="stable")
        self.at, v = at[keep][order], value[keep][order]
        mean = np.nanmean(v) if np.isfinite(v).any() else 0.0
        self.value = np.where(np.isfinite(v), v, mean)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def start_rate(md: np.ndarray, u: np.ndarray, window: int = 30, kind: str = "median", shrink: float = 1.0) -> float:
    """Rate of ``u`` at the end of the visible part; 0 where there is too little to tell."""
    ok = np.isfinite(md) & np.isfinite(u)
    x, y = md[ok][-window:], u[ok][-window:]
    if len(x) < 3:
        return 0.0
    if kind == "median":
        dx = np.diff(x)
        r = np.diff(y)[dx > 0] / dx[dx > 0]
        rate = np.median(r) if len(r) >= 3 else 0.0
    elif kind == "endpoint":
        rate = (y[-1] - y[0]) / (x[-1] - x[0]) if x[-1] > x[0] else 0.0
    elif kind == "least_squares":
        c = x - x.mean()
        rate = c @ (y - y.mean()) / (c @ c) if c @ c > 0 else 0.0
    else:
        raise ValueError(f"unknown kind of rate {kind!r}")
    return float(shrink * rate) if np.isfinite(rate) else 0.0


class Draws:
    """What each seed draws, ``[seed, particle]``: a start, noise row by row, and marks and jitter for each time that it resamples, which has
    a stream of its own. All series draw the same from the same seed, so the first rows are kept for the next one."""

    def __init__(self, seeds: tuple[int, ...], n: int):
        self.seeds, self.n, self.most = seeds, n, max(1, KEPT // (16 * n * len(seeds)))
        self.moves = [np.random.default_rng(k) for k in seeds]
        self.start = self._next()
        self.rows: list[np.ndarray] = []
        self.again = [np.random.default_rng([k, 1]) for k in seeds]
        self.picks: list[list[tuple[float, np.ndarray]]] = [[] for _ in seeds]

    def _next(self, of: list[np.random.Generator] | None = None) -> np.ndarray:
        return np.stack([g.standard_normal((2, self.n)) for g in of or self.moves], -2)

    def noise(self, rows: int):
        """``[level or rate, seed, particle]`` for so many rows."""
        while len(self.rows) < min(rows, self.most):
            self.rows.append(self._next())
        yield from self.rows[:rows]
        if rows > self.most:
            own = [_copy(g) for g in self.moves]
            for _ in range(rows - self.most):
                yield self._next(own)

    def pick(self, place: int, nth: int, own: dict[int, np.random.Generator]) -> tuple[float, np.ndarray]:
        """Mark and jitter of a seed's ``nth`` resampling; ``own`` keeps a series' generators beyond what is kept."""
        kept = self.picks[place]
        if nth < len(kept):
            return kept[nth]
        if nth < self.most:
            g = self.again[place]
        else:
            g = own.setdefault(place, _copy(self.again[place]))
        made = float(g.random()), g.standard_normal((2, self.n))
        if nth < self.most:
            kept.append(made)
        return made


def _copy(g: np.random.Generator) -> np.random.Generator:
    made = np.random.default_rng()
    made.bit_generator.state = g.bit_generator.state
    return made


@lru_cache(4)
def draws_of(seeds: tuple[int, ...], n: int) -> Draws:
    return Draws(seeds, n)


@dataclass
class Track:
    """``path``, ``evidence`` and ``deviation`` of the weighted particles: ``[seed, hidden row]``."""

    path: np.ndarray
    evidence: np.ndarray
    deviation: np.ndarray | None = None


def track(frame: dict[str, np.ndarray], curve: Curve, seeds: list[int], settings: FilterSettings = FilterSettings(), rate: float | None = None) -> Track:
    """Follows the hidden rows of a series: ``frame`` has MD, Z, GR, TVT_input and, for ``chord``, X and Y, in row order."""
    s, known = settings, np.isfinite(frame["TVT_input"])
    hidden = np.flatnonzero(~known)
    md, z, seen = frame["MD"], frame["Z"], frame["TVT_input"]
    last = int(np.flatnonzero(known)[-1])
    misfit = np.nan_to_num(frame["GR"][known]) - curve(seen[known])
    sigma = float(np.clip(np.std(misfit), *s.noise_bounds))
    gr = fill_by_index(frame["GR"], float(curve.value.mean()))
    rate = start_rate(md[known], seen[known] + z[known]) if rate is None else rate
    if s.chord:
        place = np.stack([frame["X"], frame["Y"], z], 1)
        steps = np.maximum(np.linalg.norm(place[hidden] - place[np.r_[last, hidden[:-1]]], axis=1), 0.25)
        keep, scale = s.memory**steps, np.sqrt((1 - s.memory ** (2 * steps)) / (1 - s.memory**2))
        spread = np.sqrt(steps)
    else:
        steps = np.maximum(md[hidden] - md[np.r_[last, hidden[:-1]]], 1.0)
        keep, scale, spread = np.full(len(steps), s.memory), np.ones(len(steps)), np.ones(len(steps))
    n = s.particles
    draws = draws_of(tuple(seeds), n)
    start, own, times = draws.start, {}, [0] * len(seeds)
    u = seen[last] + z[last] + s.start_spread * start[0]
    v = rate + s.start_rate_spread * start[1]
    w = np.full(u.shape, 1.0 / n)
    path, evidence, deviation = (np.empty((len(seeds), len(hidden))) for _ in range(3))
    low, high, even = curve.at[0] - s.reach, curve.at[-1] + s.reach, np.arange(n) / n
    shift = np.arange(len(seeds))[:, None]
    for t, (row, noise) in enumerate(zip(hidden, draws.noise(len(hidden)))):
        v = keep[t] * v + s.rate_noise * scale[t] * noise[0]
        tvt = u + v * steps[t]
        tvt += s.level_noise * spread[t] * noise[1]
        tvt -= z[row]
        np.clip(tvt, low, high, out=tvt)
        miss = gr[row] - curve(tvt.ravel()).reshape(tvt.shape)
        miss /= sigma
        miss *= miss
        np.minimum(miss, s.distance_cap, out=miss)
        miss *= -0.5
        w *= np.maximum(np.exp(miss, out=miss), 1e-300, out=miss)
        total = w.sum(1)
        evidence[:, t] = np.log(np.maximum(total, 1e-300))
        if (total > 0).all():
            w /= total[:, None]
        else:
            w = np.where(total[:, None] > 0, w / np.where(total > 0, total, 1)[:, None], 1.0 / n)
        u = tvt + z[row]
        worn = np.flatnonzero(np.einsum("ij,ij->i", w, w) * s.resample_share * n > 1)
        if len(worn):  # all seeds whose weights are worn at once: one search over sums that are a seed's number apart
            picks = [draws.pick(k, times[k], own) for k in worn.tolist()]
            for k in worn.tolist():
                times[k] += 1
            sums = np.minimum(np.cumsum(w[worn], axis=1), 1.0) + 2 * shift[: len(worn)]
            marks = np.array([m for m, _ in picks])[:, None] / n + even + 2 * shift[: len(worn)]
            chosen = np.searchsorted(sums.ravel(), marks.ravel()).reshape(marks.shape) - n * shift[: len(worn)]
            chosen = np.minimum(chosen, n - 1)
            fresh = np.stack([f for _, f in picks])
            u[worn] = np.take_along_axis(u[worn], chosen, 1) + s.jitter[0] * fresh[:, 0]
            v[worn] = np.take_along_axis(v[worn], chosen, 1) + s.jitter[1] * fresh[:, 1]
            w[worn] = 1.0 / n
        at = u - z[row]
        path[:, t] = np.einsum("ij,ij->i", w, at)
        at -= path[:, t, None]
        deviation[:, t] = np.sqrt(np.einsum("ij,ij->i", w, at * at))
    return Track(path, evidence, deviation)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(score - score.max(), -700, 0))
    return e / e.sum()


def with_effective_size(w: np.ndarray, least: float) -> np.ndarray:
    """The weights moved towards uniform just as far as an effective number of ``least`` asks.

    With ``d = w - 1/n`` the inverse of that number is ``1/n + rho^2 |d|^2``, so ``rho`` has a closed form.
    """
    n = len(w)
    if not 1 <= least <= n:
        raise ValueError("the effective number must lie between one and the number of members")
    d = w / w.sum() - 1 / n
    size = float(d @ d)
    rho = 1.0 if size <= 1 / least - 1 / n + 1e-15 else np.sqrt(max(0.0, 1 / least - 1 / n) / size)
    return 1 / n + min(1.0, rho) * d


def by_likelihood(t: Track, temperature: float = 8.0, least: float | None = None) -> np.ndarray:
    w = softmax(t.evidence.sum(1) / temperature)
    return (w if least is None else with_effective_size(w, least)) @ t.path


def _floored(w: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    """``with_effective_size`` of each column of weights that sum to one."""
    d = w - 1 / len(w)
    size = (d * d).sum(0)
    room = 1 / least - 1 / len(w)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.where(size <= room + 1e-15, 1.0, np.sqrt(np.maximum(0.0, room) / size))
    return 1 / len(w) + np.minimum(1.0, rho) * d


def seen_before(evidence: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """For every row the evidence of the rows strictly before it, which fades with ``decay``: ``[seed, row]``."""
    out, score = np.zeros(evidence.shape), np.zeros(len(evidence))
    for k in range(evidence.shape[1] - 1):
        score = decay * score + evidence[:, k]
        out[:, k + 1] = score
    return out


def prequential(t: Track, temperature: float, least: float | None = None, decay: float = 1.0, before: np.ndarray | None = None) -> np.ndarray:
    """Row by row with what was seen strictly before; older evidence fades with ``decay``. ``before``: ``seen_before``, if it is at hand."""
    if least is not None and not 1 <= least <= len(t.path):
        raise ValueError("the effective number must lie between one and the number of members")
    score = (seen_before(t.evidence, decay) if before is None else before) / temperature
    e = np.exp(np.clip(score - score.max(0), -700, 0))
    w = e / e.sum(0)
    return ((w if least is None else _floored(w, least)) * t.path).sum(0)


def robust(t: Track, kind: str) -> np.ndarray:
    if kind == "uniform":
        return t.path.mean(0)
    if kind == "median":
        return np.median(t.path, 0)
    if kind == "trim1" and len(t.path) >= 4:
        return (t.path.sum(0) - t.path.min(0) - t.path.max(0)) / (len(t.path) - 2)
    raise ValueError(f"{kind!r} does not fit {len(t.path)} members")


#: Temperatures, floors, decays and blends of the registered candidates.
LIKELIHOOD = (2, 4, 8, 16, 32)
FLOORED = ((4, 4), (4, 6), (4, 7), (8, 4), (8, 6), (8, 7), (16, 6))
FADING = ((4, 1.0, "d1"), (8, 1.0, "d1"), (4, 0.995, "d995"), (4, 0.98, "d98"))
PROGRESSIVE = (8, 10, 12, 14, 16, 18, 20, 24, 32)
BLENDS = (10, 20, 30, 40, 50, 60, 80, 100)
SHRINKAGES = {"uniform50_lik8": ("uniform", 0.5), "median25_lik8": ("median", 0.25), "median50_lik8": ("median", 0.5), "trim50_lik8": ("trim1", 0.5)}


def candidates(t: Track) -> dict[str, np.ndarray]:
    """All forty registered aggregates of an ensemble of at least seven seeds."""
    out = {k: robust(t, k) for k in ("uniform", "median", "trim1")}
    out |= {f"lik_t{h}": by_likelihood(t, h) for h in LIKELIHOOD}
    out |= {f"ess{e}_t{h}": by_likelihood(t, h, e) for h, e in FLOORED}
    before = {d: seen_before(t.evidence, d) for d in {1.0, *(d for _, d, _ in FADING)}}
    out |= {f"preq_t{h}_e6_{tag}": prequential(t, h, 6, d, before[d]) for h, d, tag in FADING}
    out |= {f"pbma_t{h}": prequential(t, h, before=before[1.0]) for h in PROGRESSIVE}
    base = out["lik_t8"]
    out |= {f"pbma16_blend{p:03d}": base + p / 100 * (out["pbma_t16"] - base) for p in BLENDS}
    return out | {name: share * out[kind] + (1 - share) * base for name, (kind, share) in SHRINKAGES.items()}
