"""Similarity joins in tiles, graph grids and nearest neighbours against plain loops, with crowded cells and few rows a block."""

import random

import numpy as np
import pytest

from cairn.operators import graph, joins, neighbours, tiles


def points(n, seed=0, crowd=True, size=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    xy = np.where(rng.random((n, 1)) < 0.6, 0.5 + 0.01 * rng.random((n, 2)), 10 * rng.random((n, 2))) if crowd else 3 * rng.random((n, 2))
    prints = centres[rng.integers(0, 4, n)] + 0.3 * rng.normal(size=(n, size))
    prints /= np.linalg.norm(prints, axis=1, keepdims=True)
    return [(int(i), float(x), float(y), [float(v) for v in p]) for i, ((x, y), p) in enumerate(zip(xy, prints))]


def loop(rows, near, far, threshold):
    out = {}
    for i, (a, ax, ay, p) in enumerate(rows):
        for b, bx, by, q in rows[i + 1 :]:
            if a is None or b is None or a == b or not np.isfinite([ax, ay, bx, by]).all():
                continue
            d = np.hypot(ax - bx, ay - by)
            c = float(np.dot(p, q)) if p and q and len(p) == len(q) == 6 and None not in (*p, *q) else None
            if d <= near or (d <= far and c is not None and c >= threshold):
                out[(min(a, b), max(a, b))] = (round(d, 9), None if c is None else round(c, 9))
    return out


@pytest.mark.parametrize("block", [7, 512])
@pytest.mark.parametrize("crowd", [True, False])
def test_similarity_edges_are_those_of_a_loop(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(tiles, "BLOCK", block)
    rows = points(150, 1, crowd) + [(900, 0.5, 0.5, None), (901, 0.5, 0.501, [1.0]), (902, 0.502, 0.5, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, float("nan"), 1.0, [1.0] * 6), (None, 0.5, 0.5, [1.0] * 6)]
    t = spark.createDataFrame([(*r, "x") for r in rows], "k long, x double, y double, f array<double>, other string")
    got = joins.similarity_edges(t, "k", "x", "y", "f", "f", 0.004, 0.8, 0.9).collect()
    want = loop(rows, 0.004, 0.8, 0.9)
    assert {(r.a, r.b): (round(r.dist, 9), None if r["corr"] is None else round(r["corr"], 9)) for r in got} == want and len(got) == len(want) > 50
    for r in got:
        spatial, similar = r.dist <= 0.004, r["corr"] is not None and r.dist <= 0.8 and r["corr"] >= 0.9
        assert r.reason == "+".join(["spatial"] * spatial + ["similar"] * similar)


def test_two_fingerprints_count_by_the_larger_product(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y), [float(v) for v in rng.normal(size=3)], [float(v) for v in rng.normal(size=3)] if i % 3 else None) for i, (x, y) in enumerate(rng.random((60, 2)))]
    t = spark.createDataFrame(rows, "k long, x double, y double, f array<double>, g array<double>")
    got = {(r.a, r.b): r["corr"] for r in joins.similarity_edges(t, "k", "x", "y", "f", "g", 0.0, 0.5, 1.0).collect()}
    want = {}
    for a in rows:
        for b in rows[a[0] + 1 :]:
            c = max([np.dot(a[3], b[3])] + ([np.dot(a[4], b[4])] if a[4] and b[4] else []))
            if np.hypot(a[1] - b[1], a[2] - b[2]) <= 0.5 and c >= 1.0:
                want[(a[0], b[0])] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_of_blocks_out_of_reach_are_not_made(spark, monkeypatch):
    """Clusters of opposite fingerprints in one cell: blocks of different clusters never meet."""
    monkeypatch.setattr(tiles, "BLOCK", 32)
    rng = np.random.default_rng(3)
    ends = np.eye(8)[:4] * 5
    rows = [(i, *map(float, rng.random(2)), [float(v) for v in ends[i % 4] + 0.01 * rng.normal(size=8)]) for i in range(400)]
    t = spark.createDataFrame(rows, "k long, x double, y double, f array<double>")
    found = tiles.blocks(t, "k", "x", "y", ["f"], 2.0, 8)
    n, met = found.count(), tiles.pairs_of_blocks(found, 1, 2.0, 20.0).count()
    assert n >= 12 and met < 0.45 * n * (n + 1) / 2
    assert joins.similarity_edges(t, "k", "x", "y", "f", "f", 0.0, 2.0, 20.0).count() == sum(1 for i in range(400) for j in range(i + 1, 400) if i % 4 == j % 4)


def components(n, links):
    parent = list(range(n))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return [root(v) for v in range(n)]


@pytest.mark.parametrize("forests", [False, True])
def test_graph_grid_is_a_loop_over_settings(spark, monkeypatch, forests):
    monkeypatch.setattr(tiles, "BLOCK", 16)
    rows = points(120, 4, crowd=False)
    t = spark.createDataFrame(rows, "k long, x double, y double, f array<double>")
    settings = [(r, c, 0.6) for r in (0.02, 0.1, 0.2) for c in (0.95, 0.98, 0.995)]
    edges = joins.similarity_edges(t, "k", "x", "y", "f", "f", 0.2, 0.6, 0.95, forests=forests)
    whole = loop(rows, 0.2, 0.6, 0.95)
    if forests:
        assert edges.count() < len(whole)
    got = {(r.radius, r.threshold): (r.components, r.largest, r.several) for r in joins.graph_grid(t, "k", edges, spark.createDataFrame(settings, "radius double, threshold double, far double")).collect()}
    for radius, threshold, far in settings:
        roots = components(len(rows), [k for k, (d, c) in whole.items() if d <= radius or (d <= far and c >= threshold)])
        sizes = [roots.count(v) for v in set(roots)]
        assert got[(radius, threshold)] == (len(sizes), max(sizes), sum(s > 1 for s in sizes))


def test_graph_grid_without_edges_or_points(spark):
    settings = spark.createDataFrame([(0.1, 0.5, 1.0)], "radius double, threshold double, far double")
    t = spark.createDataFrame([(1, 0.0, 0.0, [1.0]), (2, 9.0, 9.0, [1.0])], "k long, x double, y double, f array<double>")
    grid = lambda p: [tuple(r)[2:] for r in joins.graph_grid(p, "k", joins.similarity_edges(p, "k", "x", "y", "f", "f", 0.1, 1.0, 0.5), settings).collect()]
    assert grid(t) == [(2, 1, 0)] and grid(t.limit(0)) == [(0, 0, 0)]


@pytest.mark.parametrize("kind", ["long", "string", "struct"])
def test_components_in_one_task_and_in_rounds(spark, kind):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    links = [(rnd.randrange(-40, 200), rnd.randrange(-40, 200)) for _ in range(150)]
    t = spark.createDataFrame(links, "src long, dst long")
    form = {"long": lambda c: F.col(c), "string": lambda c: F.concat(F.lit("é"), F.col(c).cast("string")), "struct": lambda c: F.struct((F.col(c) / 2).alias("half"), F.when(F.col(c) > 0, F.col(c)).alias("k"))}[kind]
    t = t.select(form("src").alias("src"), form("dst").alias("dst"))
    find = lambda small: sorted(map(str, graph.connected_components(t, small=small).collect()))
    assert find(10_000) == find(0)


def nearest_loop(places, anchors, k):
    out = {}
    for name, x, y in places:
        found = sorted((np.hypot(x - ax, y - ay), a) for a, ax, ay in anchors)
        out[name] = [a for _, a in found[:k]]
    return out


@pytest.mark.parametrize("leaf", [6, 32])
def test_nearest_is_a_loop(spark, leaf):
    rng = np.random.default_rng(6)
    anchors = [(i, *map(float, 100 + 2.0 * rng.random(2) if i % 3 else 300 * rng.random(2))) for i in range(200)] + [(1000 + i, 50.0, 50.0) for i in range(30)]
    places = [(i, *map(float, 320 * rng.random(2) - 10)) for i in range(80)] + [(900 + i, *map(float, 100 + 2.0 * rng.random(2))) for i in range(40)] + [(990, 50.0, 50.0)]
    a = spark.createDataFrame([*anchors, (5000, None, 1.0), (5001, float("nan"), 1.0), (None, 1.0, 1.0)], "anchor long, x double, y double")
    p = spark.createDataFrame([*places, (991, None, 1.0), places[0]], "place long, x double, y double")
    for k in (1, 7):
        got = {}
        for r in neighbours.nearest(p, a, "place", "anchor", k, leaf).collect():
            got.setdefault(r.place, {})[r.k] = r.anchor
        want = nearest_loop(places, anchors, k)
        assert {n: [v[i] for i in sorted(v)] for n, v in got.items()} == want and all(sorted(v) == list(range(1, k + 1)) for v in got.values())


def test_nearest_of_few_or_no_anchors(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "place long, x double, y double")
    a = spark.createDataFrame([(7, 1.0, 1.0), (8, 1.0, 1.0)], "anchor long, x double, y double")
    assert sorted((r.place, r.k, r.anchor) for r in neighbours.nearest(p, a, "place", "anchor", 5).collect()) == [(1, 1, 7), (1, 2, 8), (2, 1, 7), (2, 2, 8)]
    empty = neighbours.nearest(p, a.limit(0), "place", "anchor", 5)
    assert empty.count() == 0 and empty.columns == ["place", "anchor", "x", "y", "k", "dist"]
    assert neighbours.nearest(p.limit(0), a, "place", "anchor", 5).count() == 0


def test_blocks_travel_by_bands_of_bounded_size(spark, monkeypatch):
    """All blocks of one crowded cell meet each other; each is sent once for each band, not once for each block."""
    monkeypatch.setattr(tiles, "BLOCK", 8)
    monkeypatch.setattr(tiles, "BANDS", 4)
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.random(2)), [float(v) for v in rng.normal(size=4)]) for i in range(300)]
    t = spark.createDataFrame(rows, "k long, x double, y double, f array<double>")
    found = tiles.blocks(t, "k", "x", "y", ["f"], 2.0, 4)
    made = found.join(tiles.bands(found, 4), "block").select("band", "n").collect()
    assert len(made) == found.count() > 30 and sum(r.n for r in made) == 300
    sizes = {b: [r.n for r in made if r.band == b] for b in {r.band for r in made}}
    assert 3 <= len(sizes) <= 5 and all(sum(n) <= 75 + max(n) for n in sizes.values())
    edges = joins.similarity_edges(t, "k", "x", "y", "f", "f", 0.05, 2.0, 3.0)
    assert {(r.a, r.b) for r in edges.collect()} == set(loop4(rows, 0.05, 2.0, 3.0))
    dealt = tiles.similar_pairs(t, "k", "x", "y", ["f"], 0.05, 2.0, 3.0, 4)._jdf.queryExecution().executedPlan().toString()
    assert dealt.index("Union") > dealt.index("MapInArrow") and "keys_b" not in dealt


def loop4(rows, near, far, threshold):
    for i, (a, ax, ay, p) in enumerate(rows):
        for b, bx, by, q in rows[i + 1 :]:
            d = np.hypot(ax - bx, ay - by)
            if d <= near or (d <= far and np.dot(p, q) >= threshold):
                yield a, b


@pytest.mark.parametrize("leaf", [6, 32])
def test_anchors_around_a_box_hold_the_nearest_of_its_points(spark, leaf):
    rng = np.random.default_rng(11)
    anchors = [(i, *map(float, 300 * rng.random(2))) for i in range(300)] + [(1000 + i, 50.0, 50.0) for i in range(30)]
    boxes, points = [], []
    for i in range(25):
        x, y, w, h = *(300 * rng.random(2)), *(20 * rng.random(2))
        boxes.append((i, float(x), float(x + w), float(y), float(y + h)))
        points += [(i, float(x + w * p), float(y + h * q)) for p, q in [(0, 0), (1, 1), (0, 1), (1, 0), *rng.random((6, 2))]]
    a = spark.createDataFrame([*anchors, (5000, None, 1.0)], "anchor long, x double, y double")
    b = spark.createDataFrame(boxes, "box long, left double, right double, low double, high double")
    found = {}
    for r in neighbours.around(b, a, "box", "anchor", 7, leaf).collect():
        found.setdefault(r.box, []).append(r.anchor)
    assert all(len(v) == len(set(v)) for v in found.values()) and sum(map(len, found.values())) < 25 * 330 / 3
    kept = [x for x in anchors if x[0] < 1007]  # of anchors at one spot the seven smallest take part
    for box, x, y in points:
        assert set(nearest_loop([(0, x, y)], kept, 7)[0]) <= set(found[box])
    assert neighbours.around(b, a.limit(0), "box", "anchor", 7).count() == 0
