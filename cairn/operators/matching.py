"""Matching signals to windows and to curves, over many series: windowed correlation in tiles, and beam search in array steps.

No series is bound to one task in the correlation: both sides are cut into strips with the rows around them, strips meet by
series, and each meeting is a blocked product. Beams of many series advance together, a row of each in one array step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a strip, of either side.
STRIP = 1024
SMOOTH = 2


def _strips(t: DataFrame, keys: Sequence[str], strip: int, before: int, after: int, by: Column | None = None) -> DataFrame:
    """``(*keys, strip, first, n, v, level)`` of ``(*keys, i, v, level, n)``: values of a strip's rows with ``before`` and ``after`` more on its
    sides, as far as the series has them; ``first`` is the position of the first value, ``n`` the length of the series."""
    around = F.sequence(F.greatest(F.floor((F.col("i") - after) / strip), F.lit(0)), F.floor((F.col("i") + before) / strip))
    rows = t.withColumn("strip", F.explode(around)).where((F.col("strip") * strip - before <= F.col("i")) & (F.col("i") < (F.col("strip") + 1) * strip + after) & (F.col("strip") * strip < F.col("n")))
    packed = rows.groupBy(*keys, "strip").agg(F.sort_array(F.collect_list(F.struct("i", "v", "level"))).alias("rows"), F.max("n").alias("n"))
    return packed.select(*keys, "strip", F.col("rows")[0]["i"].alias("first"), "n", F.col("rows.v").alias("v"), F.col("rows.level").alias("level"))


def _smoothed(v: np.ndarray, first: int, n: int) -> tuple[np.ndarray, int]:
    """Centered mean over the rows there are, for the rows whose neighbours are at hand; and the position of the first of them."""
    total = np.concatenate([[0.0], np.cumsum(v)])
    i = np.arange(len(v))
    lo, hi = np.maximum(i - SMOOTH, 0), np.minimum(i + SMOOTH + 1, len(v))
    mean = (total[hi] - total[lo]) / (hi - lo)
    a = 0 if first == 0 else SMOOTH
    b = len(v) if first + len(v) == n else len(v) - SMOOTH
    return mean[a:b], first + a


def _normal(w: np.ndarray) -> np.ndarray:
    w = w - w.mean(1, keepdims=True)
    return w / (np.sqrt((w * w).mean(1, keepdims=True)) + 1e-6)


def window_match(visible: DataFrame, hidden: DataFrame, keys: Sequence[str], half: int, stride: int = 3, strip: int = STRIP) -> DataFrame:
    """``(*keys, i, start, level, r)`` for each hidden row: the visible window that correlates best with the window around it.

    ``visible``: ``(*keys, i, v, level)``, ``hidden``: ``(*keys, i, v)``, numbered from 0 without gaps for each key. Both are smoothed by a
    centered mean of five rows. Windows have ``2 * half + 1`` rows; hidden ones repeat the first and last row beyond the ends, visible ones
    begin at multiples of ``stride`` and lie inside. ``r`` is the product of windows brought to mean 0 and deviation 1 (1e-6
    added) by their length; ties go to the earliest window. A series whose visible part is no longer than a window has
    the last visible level and ``r`` 0, without a ``start``; hidden rows without any visible one have nulls.
    """
    size, keys = 2 * half + 1, [*keys]
    ends = visible.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("level", "i").alias("last"))
    lengths = hidden.groupBy(*keys).agg(F.count("*").alias("n"))
    can = ends.where(F.col("n") > size)
    side_a = _strips(visible.join(can.select(*keys, "n"), keys).select(*keys, "i", "v", "level", "n"), keys, strip, SMOOTH, size - 1 + SMOOTH)
    side_b = _strips(hidden.join(lengths, keys).select(*keys, "i", "v", F.lit(None).cast("double").alias("level"), "n"), keys, strip, half + SMOOTH, half + SMOOTH)
    name = lambda t, s: t.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("strip", "first", "n", "v", "level")))
    tiles = name(side_b, "b").join(name(side_a, "a"), keys).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), *(f"{c}_{s}" for s in "ab" for c in ("strip", "first", "n", "v", "level")))
    schema = T.StructType([*tiles.schema.fields[: len(keys)], *T.StructType.fromDDL("i bigint, start bigint, level double, r double").fields])
    view = np.lib.stride_tricks.sliding_window_view

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                a, at_a = _smoothed(np.array(get("v_a").values), get("first_a").as_py(), get("n_a").as_py())
                b, at_b = _smoothed(np.array(get("v_b").values), get("first_b").as_py(), get("n_b").as_py())
                low, high, n_a = get("strip_a").as_py() * strip, (get("strip_a").as_py() + 1) * strip, get("n_a").as_py()
                starts = np.arange(-(-low // stride) * stride, min(high, n_a - size + 1), stride)
                if not len(starts):
                    continue
                own = np.arange(get("strip_b").as_py() * strip, min((get("strip_b").as_py() + 1) * strip, get("n_b").as_py()))
                a_windows = _normal(view(a, size)[starts - at_a])
                near = np.clip(own[:, None] + np.arange(-half, half + 1), 0, get("n_b").as_py() - 1) - at_b
                r = _normal(b[near]) @ a_windows.T / size
                best = r.argmax(1)
                level = np.array(get("level_a").values)[starts[best] + half - get("first_a").as_py()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.full(len(own), row))) for c in range(len(keys))), pa.array(own), pa.array(starts[best]), pa.array(level), pa.array(r[np.arange(len(own)), best])], names=schema.names)

    found = tiles.mapInArrow(run, schema).toDF(*keys, "i", "start", "level", "r")
    best = found.groupBy(*keys, "i").agg(F.max(F.struct("r", (-F.col("start")).alias("back"), "level")).alias("best"))
    out = hidden.select(*keys, "i").join(best, [*keys, "i"], "left").join(ends.select(*keys, "last"), keys, "left")
    return out.select(*keys, "i", (-F.col("best.back")).alias("start"), F.coalesce("best.level", "last").alias("level"), F.when(F.col("last").isNotNull(), F.coalesce("best.r", F.lit(0.0))).alias("r"))


class Beams:
    """Beams of several series that advance together: ``[series, width]`` knots and costs, and the trail by which paths go back.

    ``curves``: the reference of each series. A finished series keeps its last costs.
    """

    def __init__(self, curves: list[np.ndarray], starts: Sequence[int], width: int, move_cost: float, variance: float, reach: int = 2):
        n = np.array([len(c) for c in curves])
        self.curve = np.full((len(curves), int(n.max(initial=0)) + 1), np.nan)
        for i, c in enumerate(curves):
            self.curve[i, : len(c)] = c
        self.n, self.width, self.variance = n[:, None], width, variance
        self.moves = np.arange(-reach, reach + 1)
        self.price = move_cost * np.abs(self.moves)
        self.knots, self.cost = np.zeros((len(curves), width), np.int64), np.full((len(curves), width), np.inf)
        self.knots[:, 0], self.cost[:, 0] = starts, 0.0
        self.trail: list[tuple[np.ndarray, np.ndarray]] = []

    def step(self, signal: np.ndarray) -> None:
        """One row more of the first ``len(signal)`` series. Paths that meet at a knot keep the cheaper one, then the ``width`` cheapest go on;
        ties go to the earlier path and the lower knot."""
        m = len(signal)
        to = (self.knots[:m, :, None] + self.moves).reshape(m, -1)
        total = (self.cost[:m, :, None] + self.price).reshape(m, -1)
        source = np.broadcast_to(np.repeat(np.arange(self.width), len(self.moves)), to.shape)
        to = np.where((to < 0) | (to >= self.n[:m]) | ~np.isfinite(total), self.n[:m], to)  # what is no path stands behind the last knot
        order = np.lexsort((source, total, to), axis=-1)
        to, total, source = (np.take_along_axis(x, order, 1) for x in (to, total, source))
        no = to == self.n[:m]
        no[:, 1:] |= to[:, 1:] == to[:, :-1]
        total = np.where(no, np.inf, total + (signal[:, None] - np.take_along_axis(self.curve[:m], to, 1)) ** 2 / self.variance)
        best = np.argsort(total, axis=1, kind="stable")[:, : self.width]
        self.knots[:m], self.cost[:m] = np.take_along_axis(to, best, 1), np.take_along_axis(total, best, 1)
        self.trail.append((self.knots[:m].astype(np.int32), np.take_along_axis(source, best, 1).astype(np.int32)))

    def paths(self) -> np.ndarray:
        """``[series, row]``: knots of each series' cheapest path; rows that a series has not are -1."""
        slot = self.cost.argmin(1)
        return self._back(len(self.trail), slot)

    def _back(self, rows: int, slot: np.ndarray) -> np.ndarray:
        out = np.full((len(slot), rows), -1, np.int64)
        for t in range(rows - 1, -1, -1):
            knots, source = self.trail[t]
            m = np.arange(len(knots))
            out[: len(m), t], slot[: len(m)] = knots[m, slot[: len(m)]], source[m, slot[: len(m)]]
        return out

    def settled(self) -> np.ndarray:
        """Of a single series: knots of the rows before all paths of the beam part, which are taken off the trail."""
        alive = np.flatnonzero(np.isfinite(self.cost[0]))
        for t in range(len(self.trail) - 1, 0, -1):
            alive = np.unique(self.trail[t][1][0, alive])
            if len(alive) == 1:
                out = self._back(t, alive.copy())[0]
                del self.trail[:t]
                return out
        return np.zeros(0, np.int64)


def beam_paths(series: DataFrame, key: str, width: int, move_cost: float, variance: float, reach: int = 2, rows: int = 100_000) -> DataFrame:
    """``(key, i, knot)`` of ``series (key, i, v, start, curve)``: each series' path along its curve that a beam of ``width`` keeps as the cheapest.

    A row costs the squared misfit of ``v`` and the curve at its knot by ``variance``, and ``move_cost`` for each knot moved, ``reach`` a row at most. ``start``
    and ``curve``, an array of doubles, are read from a series' first row; the path begins one move from ``start``. Rows go by ``i``; ``v`` has no
    nulls. A task holds series of ``rows`` rows together and advances them in one; a longer one is read on in pieces, from
    beam to beam, and gives out its path as far as it is settled.
    """
    src = series.select(F.col(key).alias("key"), F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"), F.col("start").cast("bigint").alias("start"), F.col("curve").cast("array<double>").alias("curve"))
    schema = T.StructType([src.schema["key"], src.schema["i"]]).add("knot", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, int, np.ndarray]] = []  # key, i, v, start, curve of whole series
        total, going, late = 0, None, np.zeros(0, np.int64)

        def out(name: pa.Array, i: np.ndarray, knots: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(i), np.int64))), pa.array(i), pa.array(knots)], names=schema.names)

        def together() -> Iterator[pa.RecordBatch]:
            nonlocal total
            held.sort(key=lambda s: -len(s[1]))
            beams = Beams([s[4] for s in held], [s[3] for s in held], width, move_cost, variance, reach)
            length = np.array([len(s[1]) for s in held])
            signal = np.zeros((len(held), length[0]))
            for k, s in enumerate(held):
                signal[k, : len(s[2])] = s[2]
            for t in range(length[0]):
                beams.step(signal[: np.searchsorted(-length, -t), t])
            for s, path in zip(held, beams.paths()):
                yield out(s[0], s[1], path[: len(s[1])])
            held.clear()
            total = 0

        def advance(i: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal late
            name, beams = going
            for g in v:
                beams.step(np.array([g]))
            done, late = beams.settled(), np.concatenate([late, i])
            if len(done):
                yield out(name, late[: len(done)], done)
                late = late[len(done) :]

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal going, late
            if going and len(late):
                yield out(going[0], late, going[1].paths()[0])
            going, late = None, late[:0]

        parts, open_key = [], None

        def close() -> Iterator[pa.RecordBatch]:
            """The series that is being read has ended."""
            nonlocal total, parts
            if going:
                yield from advance(*(np.concatenate([p[c] for p in parts]) for c in (1, 2))) if parts else ()
                yield from finish()
            elif parts:
                if held and total + sum(len(p[1]) for p in parts) > rows:
                    yield from together()
                held.append((parts[0][0], *(np.concatenate([p[c] for p in parts]) for c in (1, 2)), parts[0][3], parts[0][4]))
                total += len(held[-1][1])
            parts = []

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("key").to_pylist()
            cuts = [0, *(j for j in range(1, len(names)) if names[j] != names[j - 1]), len(names)]
            i, v = batch.column("i").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
            for a, b in zip(cuts, cuts[1:]):
                if (names[a],) != open_key:
                    yield from close()
                    open_key = (names[a],)
                first = not parts and not going
                parts.append((batch.column("key").slice(a, 1), i[a:b], v[a:b], batch.column("start")[a].as_py() if first else None, np.array(batch.column("curve")[a].values) if first else None))
                if sum(len(p[1]) for p in parts) > rows:
                    if not going:
                        going = parts[0][0], Beams([parts[0][4]], [parts[0][3]], width, move_cost, variance, reach)
                    yield from advance(*(np.concatenate([p[c] for p in parts]) for c in (1, 2)))
                    parts = []
        yield from close()
        if held:
            yield from together()

    return src.repartition("key").sortWithinPartitions("key", "i").mapInArrow(run, schema).toDF(key, "i", "knot")
