import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import embed_dedup as e


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block, home, look", [(40, 30, 100), (1000, 1000, 10**6), (25, 500, 10**6)])
def test_matches_brute_force(spark, monkeypatch, block, home, look):
    for name, value in {"BLOCK": block, "HOME": home, "STRIP": 16, "LOOK": look}.items():
        monkeypatch.setattr(e, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 160)] + rng.normal(size=(160, 24)) * rng.choice([0.02, 0.3, 0.45], (160, 1)), rng.normal(size=(80, 24))])
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(2000, [v * 2 for v in rows[3][1]]), (2001, [1e-200] * 24), (2002, [1e-200] * 24), (2003, [1e300] * 24)]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [float("inf")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, []), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(t).collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in e.near_duplicates(t).collect())


def test_bounds_hold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 64)) * np.exp(rng.normal(size=(400, 64)))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, a, r, p, t, a2, r2 = e.quantise(u)
    exact, first = u @ u.T, q * s[:, None]
    both = first + p * t[:, None]
    for c, near, miss in ((first, a, r), (both, a2, r2)):
        assert (np.abs(exact - c @ c.T) <= miss[:, None] * near + near[:, None] * miss + miss[:, None] * miss + 1e-12).all()
    assert r2.max() < 1e-3 * r.max() * 10 and (r2 < r).all()


def block_of(y):
    import pyarrow as pa

    q, s, a, r, p, t, a2, r2 = e.quantise(y)
    codes = [c.tobytes() for c in np.concatenate([q, p], axis=1)]
    return e.Block(pa.table({"rep": np.arange(len(y)), "mult": np.ones(len(y), int), "codes": pa.array(codes, pa.binary()), "s": s, "a": a, "r": r, "t": t, "a2": a2, "r2": r2}))


def test_pairs_at_the_threshold():
    y = np.array([[1.0, 0.0]] + [[c, np.sqrt(1 - c * c)] for c in (0.9, 0.9 - 1e-9, 0.9 + 1e-9, 0.9 + 1e-3, 0.9 - 1e-3, 0.95, 0.85)])
    b = block_of(y)
    found = {(int(i), int(j)): bool(s) for i, j, sure in e.tile_links(b, b, True) for i, j, s in zip(i, j, sure)}
    first = {j: s for (i, j), s in found.items() if i == 0}
    assert first[6] and first[4] and 7 not in first and 5 not in first and first[1] is False and 3 in first and not first.get(2, False)


def test_few_pairs_are_left_open():
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + 0.33 * rng.normal(size=(1500, 64))  # cosines around the threshold
    x /= np.linalg.norm(x, axis=1)[:, None]
    b, exact = block_of(x), x @ x.T
    found = [np.stack(f) for f in e.tile_links(b, b, True)]
    i, j, sure = np.concatenate(found, axis=1)
    assert (exact[i[sure == 1], j[sure == 1]] >= 0.9).all() and (sure == 0).sum() < 0.002 * len(x) ** 2 / 2
    assert set(zip(*np.nonzero(np.triu(exact >= 0.9, 1)))) <= set(zip(i.tolist(), j.tolist()))


def test_visits_meet_every_link():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(30, 16))
    x = c[rng.integers(0, 30, 600)] + 0.25 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    home, visits = e.homes(x, x[:25], float(np.arccos(0.9)))
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
        assert home[j] in visits[i]
    assert np.mean([len(v) for v in visits]) < 25


def test_roots_join_as_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 90))))
        label = np.arange(n)
        used = e.join_roots(label, i, j)
        parent = list(range(n))

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for k in used:
            assert find(i[k]) != find(j[k])  # a forest
            parent[find(i[k])] = find(j[k])
        assert all(find(a) == find(b) for a, b in zip(i, j)) and len({find(k) for k in range(n)}) == len(set(label.tolist()))
        assert all((label[a] == label[b]) == (find(a) == find(b)) for a in range(n) for b in range(n))


@pytest.mark.parametrize("rows", [[], [(None, [1.0, 0.0])], [(1, [1.0]), (1, [1.0])]])
def test_small_tables(spark, rows):
    got = sorted(map(tuple, e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == ([] if not rows else [(None, 0, None, False)] if rows[0][0] is None else [(1, 1, 1, True)] * 2)
