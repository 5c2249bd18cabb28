"""Windowed correlation and beams against the kernels that take one series at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.matching import beam, window_match
from cairn.operators import matching


def walks(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(size=n)) for n in lengths]


@pytest.mark.parametrize("strip", [9, 40, 1024])
@pytest.mark.parametrize("half", [3, 8])
def test_windows_are_those_of_the_kernel(spark, strip, half):
    seen, hidden = walks([90, 18, 17, 5, 200], 1), walks([70, 30, 3, 9, 150], 2)
    levels = [v * 2 + 1 for v in seen]
    rows = lambda x, *more: [(f"w{k}", i, float(v), *(float(m[k][i]) for m in more)) for k, s in enumerate(x) for i, v in enumerate(s)]
    a = spark.createDataFrame(rows(seen, levels), "well string, i long, v double, level double")
    b = spark.createDataFrame([*rows(hidden), ("none", 0, 1.0)], "well string, i long, v double")
    got = {}
    for r in matching.window_match(a, b, ["well"], half, 3, strip).collect():
        got.setdefault(r.well, {})[r.i] = r
    assert got["none"][0].level is None and got["none"][0].r is None
    for k, (s, lv, h) in enumerate(zip(seen, levels, hidden)):
        level, score = window_match(s, lv, h, half)
        own = got[f"w{k}"]
        assert sorted(own) == list(range(len(h)))
        assert np.allclose([own[i].level for i in range(len(h))], level) and np.allclose([own[i].r for i in range(len(h))], score)
        assert all((own[i].start is None) == (len(s) <= 2 * half + 1) for i in own)


def test_repeated_windows_go_to_the_earliest(spark):
    wave = [float(v) for v in (0, 1, 5, 1, 0, -3) * 8]
    a = spark.createDataFrame([(1, i, v, float(i)) for i, v in enumerate(wave)], "k int, i long, v double, level double")
    b = spark.createDataFrame([(1, i, v) for i, v in enumerate(wave[:24])], "k int, i long, v double")
    inner = [r for r in matching.window_match(a, b, ["k"], 3, 3, 12).collect() if 6 <= r.i < 18]
    assert inner and all(r.start < 9 for r in inner)


def exact(signal, curve, start, move, variance, reach=2):
    """Cheapest cost of all paths, by dynamic programming over every knot."""
    cost = np.full(len(curve), np.inf)
    cost[start] = 0
    for g in signal:
        best = np.full(len(curve), np.inf)
        for d in range(-reach, reach + 1):
            moved = np.full(len(curve), np.inf)
            moved[max(0, d) : len(curve) + min(0, d)] = cost[max(0, -d) : len(curve) - max(0, d)] + move * abs(d)
            best = np.minimum(best, moved)
        cost = best + (g - curve) ** 2 / variance
    return cost.min()


def path_cost(signal, curve, start, path, move, variance):
    steps = np.abs(np.diff(np.r_[start, path]))
    assert steps.max() <= 2
    return (move * steps + (signal - curve[path]) ** 2 / variance).sum()


@pytest.mark.parametrize("rows", [10, 50, 100_000])
def test_beams_are_those_of_the_kernel_and_exact_when_wide(spark, rows):
    signals, curves = walks([60, 1, 33, 8, 47, 120], 3), walks([40, 5, 60, 3, 21, 50], 4)
    starts = [k * 7 % len(c) for k, c in enumerate(curves)]
    t = spark.createDataFrame([(f"w{k}", i, float(v), starts[k] if not i else None, [float(x) for x in curves[k]] if not i else None) for k, s in enumerate(signals) for i, v in enumerate(s)], "well string, i long, v double, start long, curve array<double>")
    for width in (3, 80):
        got = {}
        for r in matching.beam_paths(t, "well", width, 0.5, 2.0, rows=rows).collect():
            got.setdefault(r.well, {})[r.i] = r.knot
        for k, (s, c, start) in enumerate(zip(signals, curves, starts)):
            path = np.array([got[f"w{k}"][i] for i in range(len(s))])
            assert path.tolist() == beam(s, c, start, width, 0.5, 2.0).tolist()
            if width == 80:
                assert path_cost(s, c, start, path, 0.5, 2.0) == pytest.approx(exact(s, c, start, 0.5, 2.0))
    assert matching.beam_paths(t.where(F.lit(False)), "well", 3, 0.5, 2.0).count() == 0
