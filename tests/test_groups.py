"""Groups dealt, split and sampled by ranges against loops; routing by sums against one model at a time."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import groups
from cairn.plans import routing
from cairn.plans.blending import Ridge


def _quantile(v, w, q):
    order = np.argsort(v, kind="stable")
    at = np.searchsorted(np.cumsum(w[order]) / w.sum(), q)
    return float(v[order][min(at, len(v) - 1)])


def _unit_weight(names):
    _, inv, n = np.unique(names, return_inverse=True, return_counts=True)
    return 1 / n[inv] / np.mean(1 / n[inv])


def loop(sizes, folds, tie):
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], tie(g), str(g))):
        k = load.index(min(load))
        out[g] = k
        load[k] += sizes[g]
    return out


@pytest.mark.parametrize("folds", [1, 2, 3, 5, 8])
def test_runs_are_the_loop(folds):
    rng = np.random.default_rng(folds)
    for trial in range(60):
        sizes = {f"g{i:03d}": int(v) for i, v in enumerate(rng.choice([0, 1, 2, 3, 5, 40, 41, 1000], rng.integers(folds, 60)))}
        counts = {s: list(sizes.values()).count(s) for s in set(sizes.values())}
        want = loop(sizes, folds, lambda g: 0)
        got = {}
        for size, first, end, order in groups.dealt(counts, folds):
            names = sorted(g for g in sizes if sizes[g] == size)
            got |= {names[p]: order[(p - first) % len(order)] for p in range(first, end)}
        assert got == want, (trial, sizes)
    assert len(groups.dealt({7: 10**12, 3: 5}, 4)) < 20


def test_balanced_folds_of_a_table(spark):
    sizes = {f"g{i}": [9, 4, 4, 4, 1, 1][i % 6] for i in range(50)}
    t = spark.createDataFrame(list(sizes.items()), "g string, n long").repartition(3)
    md5 = lambda g: hashlib.md5(f"5:{g}".encode()).hexdigest()
    got = {r.g: r.fold for r in groups.balanced_folds(t, "g", "n", 4, groups.draw(5, "g")).collect()}
    assert got == loop(sizes, 4, md5)
    with pytest.raises(ValueError, match="cannot fill"):
        groups.balanced_folds(t.limit(2), "g", "n", 4)


def test_holdout_and_sample_are_loops(spark):
    sizes = {f"g{i}": 1 + i * 7 % 11 for i in range(40)}
    t = spark.createDataFrame(list(sizes.items()), "g string, n long").repartition(3)
    drawn = sorted(sizes, key=lambda g: hashlib.md5(f"3:{g}".encode()).hexdigest())
    out, rows = [], 0
    for g in drawn:
        if rows >= 0.3 * sum(sizes.values()) or len(sizes) - len(out) <= 3:
            break
        out.append(g)
        rows += sizes[g]
    got = {r.g: r.fold for r in groups.holdout_and_folds(t, "g", "n", 0.3, 3, 3).collect()}
    assert got == {g: -1 for g in out} | loop({g: n for g, n in sizes.items() if g not in out}, 3, lambda g: 0)
    for most in (0, 1, 17, 60, 1000):
        room, want = most, set()
        for g in drawn:
            if sizes[g] <= room:
                want.add(g)
                room -= sizes[g]
        assert {r.g for r in groups.whole_groups(t, "g", "n", most, 3).collect()} == want, most


def units(n=90, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    return pd.DataFrame({"well": np.arange(n), "component": [f"c{i % 17 if i % 3 else i % 5}" for i in range(n)], "f": x[:, 0], "h": 100 + x[:, 1], "flat": 3.0, "gain_a": 5 * x[:, 0] + rng.normal(size=n), "gain_b": x[:, 1] - 1})


def test_models_and_margins_are_those_of_single_fits(spark):
    u, names = units(), ["f", "h", "flat"]
    t = spark.createDataFrame(u)
    router = routing.fit(t, ["a", "b"], names, folds=3, seed=2)
    fold = {r.well: r._fold for r in routing.with_folds(t, 3, 2).collect()}
    k, groups_of = u["well"].map(fold).to_numpy(), u["component"].to_numpy()
    x = u[names].to_numpy()
    for arm in ("a", "b"):
        y, out = u[f"gain_{arm}"].to_numpy(), np.empty(len(u))
        for f in range(3):
            own = k != f
            out[~own] = Ridge.fit(x[own], y[own], _unit_weight(groups_of[own])).predict(x[~own])
        whole = Ridge.fit(x, y, _unit_weight(groups_of))
        assert np.allclose(router.models[arm].predict(x), whole.predict(x))
        for q in (0.5, 0.7, 0.8, 0.9):
            assert router.margins[q, arm] == pytest.approx(_quantile(np.abs(y - out), _unit_weight(groups_of), q))
    got = {r.well: r for r in router.route(t, 0.7, ["well"]).collect()}
    for i, row in enumerate(x):
        bound = [router.models[a].predict(row[None])[0] - router.margins[0.7, a] for a in "ab"]
        assert got[i].arm == ("fallback" if max(bound) <= 0 else "ab"[int(np.argmax(bound))]) and got[i].bound == pytest.approx(max(bound + [0.0]))
        assert got[i].abstained == (max(bound) <= 0)


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    v, w = rng.integers(0, 30, 200).astype(float), rng.random(200)
    t = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)], "v double, w double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    assert routing.quantiles(t, "v", "w", shares) == [_quantile(v, w, q) for q in shares]


def test_nested_scores_are_those_of_rows(spark):
    u = units(120, 5)
    rng = np.random.default_rng(6)
    for c in ("n", "rr", "c_a", "g_a", "c_b", "g_b"):
        u[c] = rng.integers(1, 9, len(u)).astype(float) + (10 if c == "rr" else 0)
    t = spark.createDataFrame(u)
    held = F.col("component").isin("c0", "c1", "c2")
    made = routing.nested(t, held, ["a", "b"], ["f", "h"], folds=2, seed=1)
    assert len(made.grid) == 16 and made.grid[made.quantile, made.blend] == min(made.grid.values())
    arm = {r.well: r.arm for r in made.decisions.collect()}
    own = u[u["component"].isin(["c0", "c1", "c2"])]
    assert set(arm) == set(own["well"])
    b = made.blend
    mse = [r.rr if arm[r.well] == "fallback" else max(0.0, r.rr + b * b * getattr(r, f"g_{arm[r.well]}") - 2 * b * getattr(r, f"c_{arm[r.well]}")) for r in own.itertuples()]
    assert made.holdout == pytest.approx(np.sqrt(np.average(mse, weights=own["n"]))) and made.fallback == pytest.approx(np.sqrt(np.average(own["rr"], weights=own["n"])))
