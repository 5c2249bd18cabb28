"""Boosting on histograms against a loop that holds all rows and tries every split."""

import numpy as np
import pytest

from cairn.plans import boosting as bo


def plain(x, y, edges, trees, leaves, rate, l2, least):
    """Leaf-wise trees, one leaf at a time, every split tried on the rows themselves."""
    b = bo.binned(x, edges)
    pred, out = np.full(len(y), y.mean()), []

    def search(rows):
        best = (0.0, -1, 0, False)
        g = pred[rows] - y[rows]
        for missing_left in (False, True):
            top = (-np.inf,)
            for f in range(x.shape[1]):
                v = b[rows, f]
                for last in range(bo.MISSING):
                    left = np.where(v == bo.MISSING, missing_left, v <= last)
                    if left.sum() < least or (~left).sum() < least:
                        continue
                    gain = g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - g.sum() ** 2 / (len(g) + l2)
                    if gain > top[0] + 1e-9:
                        top = (gain, f, last, missing_left)
            if top[0] > best[0] + 1e-9:
                best = top
        return best

    for _ in range(trees):
        groups = [np.arange(len(y))]
        found = [search(groups[0])]
        while len(groups) < leaves and max(f[0] for f in found) > 0:
            k = int(np.argmax([f[0] for f in found]))
            rows, (_, f, last, missing_left) = groups.pop(k), found.pop(k)
            v = b[rows, f]
            left = np.where(v == bo.MISSING, missing_left, v <= last)
            groups += [rows[left], rows[~left]]
            found += [search(rows[left]), search(rows[~left])]
        step = np.zeros(len(y))
        for rows in groups:
            step[rows] = -rate * (pred[rows] - y[rows]).sum() / (len(rows) + l2)
        pred = pred + step
        out.append(sorted((len(r), round(float(step[r[0]]), 9)) for r in groups))
    return pred, out


@pytest.mark.parametrize("l2", [0.0, 3.0])
def test_leaves_are_those_of_a_loop(spark, monkeypatch, l2):
    monkeypatch.setattr(bo, "EVERY", 2)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=160), rng.integers(0, 5, 160).astype(float), rng.normal(size=160)])
    x[rng.random(160) < 0.2, 2] = np.nan
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] ** 2 / 4 + np.where(np.isnan(x[:, 2]), 3.0, x[:, 2]) + 0.1 * rng.normal(size=160)
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)] + [(1.0, 2.0, 3.0, None)]
    t = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)
    m = bo.fit(t, ["a", "b", "c"], "y", trees=3, leaves=6, rate=0.3, l2=l2, least=5, bins=12)
    pred, leaves = plain(x, y, m.edges, 3, 6, 0.3, l2, 5)
    b = m.binned(x)
    for tree, want in zip(m.trees, leaves):
        at = tree.leaves(b)
        assert sorted((int((at == k).sum()), round(tree.value[k], 9)) for k in set(at.tolist())) == want
    assert np.allclose(m.predict(x), pred)
    got = t.where("y is not null").withColumn("p", m.column(["a", "b", "c"])).collect()
    assert np.allclose(sorted(r.p for r in got), sorted(pred))


def test_few_values_have_a_bin_each_and_empty_or_constant_tables_no_tree(spark):
    t = spark.createDataFrame([(float(i % 4), None, 1.0) for i in range(40)], "a double, b double, y double")
    assert [e.tolist() for e in bo.bin_edges(t, ["a", "b"])] == [[0.0, 1.0, 2.0], []]
    m = bo.fit(t, ["a", "b"], "y", trees=2)
    assert m.trees == [] and m.base == 1.0 and m.predict(np.array([[1.0, np.nan]])).tolist() == [1.0]
    assert bo.fit(t.limit(0), ["a"], "y", trees=2).predict(np.array([[1.0]])).tolist() == [0.0]


def test_packed_rows_are_read_in_place():
    import pyarrow as pa

    bins = np.random.default_rng(4).integers(0, 256, (50, 3)).astype(np.uint8)
    column = bo.packed(bins)
    assert column.to_pylist() == [row.tobytes() for row in bins]
    for part, rows in ((column, bins), (column.slice(7, 20), bins[7:27]), (column.slice(50), bins[:0]), (column.cast(pa.large_binary()).slice(3), bins[3:])):
        assert np.array_equal(bo.unpacked(part, 3), rows)
