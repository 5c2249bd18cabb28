import random

import numpy as np
import pandas as pd
import pytest

from cairn.operators import checks, graph, joins, ordered


def table(spark, values, key="k"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "well string, rn int, v double")


def column(t, name):
    return [r[name] for r in t.orderBy("rn").collect()]


@pytest.mark.parametrize("values", [[None, 1, None, None, 4, None], [None, None], [1, 2, 3], [None, 5, None], [0, None, None, None, None, None, None, 7]])
def test_fills_are_pandas(spark, values):
    s = pd.Series(values, dtype=float)
    got = column(ordered.fill_linear(table(spark, values), "well", "v", "f"), "f")
    assert pd.Series(got, dtype=float).equals(s.interpolate(limit_direction="both")) or np.allclose(pd.Series(got, dtype=float), s.interpolate(limit_direction="both"), equal_nan=True)
    got = column(ordered.fill_inner(table(spark, values), "well", "v", "f", 2), "f")
    assert np.allclose(pd.Series(got, dtype=float), s.interpolate(limit=2, limit_area="inside"), equal_nan=True)


def test_windows_are_pandas(spark):
    v = np.random.default_rng(0).normal(size=60)
    s, t = pd.Series(v), table(spark, v)
    r = ordered.rolling(t, "well", "v", [5, 21])
    for w in (5, 21):
        assert np.allclose(column(r, f"v_mean{w}"), s.rolling(w, center=True, min_periods=1).mean())
        assert np.allclose(column(r, f"v_std{w}"), s.rolling(w, center=True, min_periods=2).std().fillna(0))
    r = ordered.shifts(t, "well", "v", [1, 15])
    assert np.allclose(column(r, "v_lag15"), s.shift(15).bfill()) and np.allclose(column(r, "v_lead15"), s.shift(-15).ffill())
    assert np.allclose(column(ordered.gradient(t, "well", "v", "g"), "g"), np.gradient(v))


def test_slopes_of_a_line_are_one(spark):
    t = spark.createDataFrame([("w", i, float(i), 1000 + 0.75 * i, 100 + 0.25 * i) for i in range(140)], "well string, rn int, md double, tvt double, z double")
    r = ordered.slopes(t.withColumn("u", t.tvt + t.z), "well", "md", "u").first()
    assert [r.median_step, r.endpoint, r.least_squares, r.anchored] == pytest.approx([1.0] * 4)


def test_fingerprint_is_numpy(spark):
    v = np.sin(np.arange(50) / 3.0)
    seen = [None if i % 9 == 4 else x for i, x in enumerate(v)]
    got = ordered.fingerprint(table(spark, seen), "well", "v").first().shape
    s = pd.Series(seen, dtype=float).interpolate(limit_direction="both").to_numpy()
    want = np.interp(np.linspace(0, 49, 64), np.arange(50), s)
    want = (want - want.mean()) / np.linalg.norm(want - want.mean())
    assert np.allclose(got, want)
    assert set(ordered.fingerprint(table(spark, [1, None, 2, None]), "well", "v").first().shape) == {0.0}
    assert set(ordered.fingerprint(table(spark, [3, 3, 3, 3, 3]), "well", "v").first().shape) == {0.0}


def test_prefix_length_rounds_half_to_even(spark):
    from pyspark.sql import functions as F

    got = {n: spark.range(1).select(ordered.prefix_length(F.lit(n), 0.5)).first()[0] for n in (100, 101, 103, 45, 400)}
    assert got == {100: 50, 101: 50, 103: 52, 45: 30, 400: 200}


def test_correlation_length_stops_at_the_first_low_lag(spark):
    v = np.sin(np.arange(200) / 8.0)
    c = v - v.mean()
    r = [c[:-k] @ c[k:] / (c @ c) for k in range(1, 61)]
    stop = next(i for i, x in enumerate(r) if x <= 0.05)
    got = ordered.correlation_length(table(spark, v), "well", "v").first().length
    assert got == pytest.approx(1 + sum(r[:stop]))


def test_interpolation_is_numpy(spark):
    rnd = random.Random(0)
    knots = [(k, float(x), rnd.random()) for k in "ab" for x in sorted(rnd.sample(range(100), 9))]
    asked = [(k, i, rnd.uniform(-20, 120)) for k in "ab" for i in range(50)] + [("a", 99, knots[3][1]), ("a", 98, None)]
    got = joins.interpolate(spark.createDataFrame(asked, "k string, i int, at double"), spark.createDataFrame(knots, "k string, x double, y double"), ["k"], "at", "x", "y").collect()
    assert len(got) == len(asked)
    for r in got:
        own = [(x, y) for k, x, y in knots if k == r.k]
        assert (r["at"] is None and r.value is None) or r.value == pytest.approx(np.interp(r["at"], *zip(*own)))


def test_nearest_ties_go_down(spark):
    grid = spark.createDataFrame([(0.0,), (1.0,), (4.0,)], "x double")
    asked = [-3.0, 0.5, 0.51, 2.5, 2.6, 9.0, 1.0]
    got = {r["at"]: r.nearest for r in joins.nearest(spark.createDataFrame([(a,) for a in asked], "at double"), grid, "at", "x").collect()}
    assert got == {-3.0: 0.0, 0.5: 0.0, 0.51: 1.0, 2.5: 1.0, 2.6: 4.0, 9.0: 4.0, 1.0: 1.0}


def test_radius_pairs_are_brute_force(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-50, 50, (200, 2))
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    got = {(r.a, r.b) for r in joins.radius_pairs(t, "id", "x", "y", 7.0).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if np.linalg.norm(xy[i] - xy[j]) <= 7}


def test_many_to_one_refuses_repeats(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert joins.many_to_one(left, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"]).count() == 3
    with pytest.raises(Exception, match="repeats a key"):
        joins.many_to_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    with pytest.raises(joins.DuplicateKeyError):
        joins.check_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_as_of_takes_the_latest_before(spark):
    facts = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 3, 30.0)], "k string, t int, v double")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 2), ("c", 5)], "k string, t int")
    got = {(r.k, r.t): r.v for r in joins.as_of(asked, facts, ["k"], "t", "t", "v", "v").collect()}
    assert got == {("a", 0): None, ("a", 1): 10.0, ("a", 4): 10.0, ("a", 9): 50.0, ("b", 2): None, ("c", 5): None}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components_are_union_find(spark, kind):
    rnd = random.Random(2)
    links = {"chain": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(400)], "random": [(rnd.randrange(500), rnd.randrange(500)) for _ in range(300)], "empty": []}[kind]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    parent = {n: n for l in links for n in l}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {n: find(n) for l in links if l[0] != l[1] for n in l}


def test_labels_follow_the_smallest_member(spark):
    nodes = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "id long")
    edges = spark.createDataFrame([(3, 9)], "a long, b long")
    got = {r.id: (r.component, r.degree) for r in joins.labelled_components(nodes, "id", edges).collect()}
    assert got == {1: ("component_000", 0), 3: ("component_001", 1), 9: ("component_001", 1), 5: ("component_002", 0)}


def test_checks_fail_closed(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    good, bad = checks.one_value(t.limit(1), "t", "single", "k", "v"), checks.unique(t, "t", "key", ["k"])
    checks.require(good)
    with pytest.raises(checks.CheckFailure, match="t/key"):
        checks.require(checks.log(good, bad))


def test_step_quantiles_are_exact_and_by_ranges(spark):
    """As Spark's own exact percentile gives them, which holds every value in one task; without steps there are none."""
    from cairn.operators import ordered

    t = spark.range(3000).selectExpr("id % 7 AS k", "id DIV 7 AS rn", "CAST((id * id) % 97 AS DOUBLE) / 3 AS md")
    got = ordered.step_statistics(t, "k", "md")
    assert "percentile(" not in got._jdf.queryExecution().executedPlan().toString()
    want = t.selectExpr("md - lag(md) OVER (PARTITION BY k ORDER BY rn) AS d").where("d IS NOT NULL").selectExpr("count(*)", "min(d)", "max(d)", "percentile(d, 0.25)", "percentile(d, 0.5)", "percentile(d, 0.75)", "percentile(d, 0.95)", "avg(CAST(abs(d - 1) > 1e-9 AS DOUBLE))")
    assert list(got.first()) == pytest.approx(list(want.first()))
    assert list(ordered.step_statistics(t.limit(1), "k", "md").first()) == [0] + [None] * 7
