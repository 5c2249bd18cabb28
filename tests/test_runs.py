"""Whole groups out of streams, whatever the batches."""

import numpy as np
import pyarrow as pa
import pytest

from cairn.functions import particles as pf
from cairn.operators import experts, runs
from cairn.plans import domain, historical


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_do_not_depend_on_batches(size):
    rng = np.random.default_rng(size)
    keys = np.repeat([None, "a", "b", "c", "d", "a"], [3, 1, 9, 2, 30, 4])
    parts = np.r_[[0] * 3, [1], [0] * 4, [1] * 5, [2, 2], rng.integers(0, 1, 30), [5] * 4]
    t = pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.string()), pa.array(parts), pa.array([None if i % 5 == 0 else float(i) for i in range(len(keys))])], names=["k", "p", "v"])
    got = list(runs.groups((t.slice(i, size) for i in range(0, len(keys), size)), ["k", "p"]))
    want = [((None, 0), 3), (("a", 1), 1), (("b", 0), 4), (("b", 1), 5), (("c", 2), 2), (("d", 0), 30), (("a", 5), 4)]
    assert [(k, len(c["v"])) for k, c in got] == want
    all_ = np.concatenate([c["v"] for _, c in got])
    assert all(np.isnan(x) if i % 5 == 0 else x == i for i, x in enumerate(all_))


def test_series_meet_their_curves_in_small_batches_and_sides_dealt_alike(spark):
    """A union of sides that are dealt by their keys keeps series and curve together; curves alone make nothing."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        s = spark.range(4000).selectExpr("CAST(id % 400 AS STRING) AS well", "CAST(id DIV 400 AS INT) AS row_number", "CAST(id AS DOUBLE) AS GR").repartition("well")
        c = spark.range(405 * 3).selectExpr("CAST(id % 405 AS STRING) AS well", "CAST(id DIV 405 AS DOUBLE) AS TVT", "CAST(id % 405 AS DOUBLE) AS GR").repartition("well")
        run = lambda k, own, at, value: {"n": np.array([len(own["GR"])]), "knots": np.array([len(at)]), "right": np.array([bool((value == int(k[0])).all() and (own["GR"] % 400 == int(k[0])).all() and (np.diff(own["row_number"]) == 1).all())])}
        rows = runs.by_series(runs.with_curves(s, c), ["well"], run, "well string, n bigint, knots bigint, right boolean").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 400 and all((r.n, r.knots, r.right) == (10, 3, True) for r in rows)


def test_particle_map_has_one_python_call_for_a_stream_of_series(spark):
    """No grouped map and no join with the curves, which Spark takes for small and would broadcast."""
    d = "/root/testdata/sf0.001"
    t, c = domain.logs(spark, d)
    for made in (experts.particle_paths(t, c, [0, 1], pf.FilterSettings(particles=20)), experts.grid_paths(t, c), historical.build(t, c, historical_names())):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroups" not in plan and "MapInArrow" in plan
    plan = experts.particle_paths(t, c, [0], pf.FilterSettings(particles=20))._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def historical_names():
    from cairn.plans.features import NAMES

    return NAMES


def test_kept_draws_are_those_of_fresh_generators():
    seeds, n = (3, 8), 40
    d = pf.Draws(seeds, n)
    d.most = 4
    for rows in (2, 9, 6):
        got = list(d.noise(rows))
        gens = [np.random.default_rng(k) for k in seeds]
        want = [np.stack([g.standard_normal((2, n)) for g in gens], -2) for _ in range(rows + 1)]
        assert np.array_equal(d.start, want[0]) and all(np.array_equal(a, b) for a, b in zip(got, want[1:]))
    for _ in range(2):
        own, g = {}, np.random.default_rng([8, 1])
        for nth in range(7):
            mark, jitter = d.pick(1, nth, own)
            assert mark == g.random() and np.array_equal(jitter, g.standard_normal((2, n)))
