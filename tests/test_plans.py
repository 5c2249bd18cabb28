import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions.grid import GridSettings
from cairn.operators import experts
from cairn.plans import blending, evaluation, experiment, features
from cairn.sources.files import synthetic_logs


@pytest.fixture(scope="module")
def logs(spark):
    h, t = synthetic_logs(spark, 10, 100)
    return h.persist(), t.persist()


SMALL = experiment.Config(seeds=2, particles=32, folds=2, holdout=0.2, trees=2, leaves=4, draws=20, grid=GridSettings(step=4.0, slopes=5, stride=8))


def test_configuration_is_checked():
    for bad in ({"seeds": True}, {"particles": 2.5}, {"holdout": "x"}):
        with pytest.raises(TypeError):
            experiment.Config(**bad)
    for bad in ({"seeds": 1}, {"folds": 1}, {"holdout": 1.0}, {"seed_offset": 2**32}):
        with pytest.raises(ValueError):
            experiment.Config(**bad)


def test_pairs_of_wells_are_components(logs):
    c = experiment.components(*logs, SMALL)
    rows = c.collect()
    assert len(rows) == 10 and all(r.degree == 1 for r in rows)
    by = {r.well: r.component for r in rows}
    assert all(by[f"syn_{2 * i:03d}"] == by[f"syn_{2 * i + 1:03d}"] for i in range(5)) and len(set(by.values())) == 5


def test_nested_experiment_end_to_end(spark, logs):
    h, t = logs
    truth = h.where("TVT_input is null").select("well", "row_number", F.col("TVT").alias("truth"))
    r = experiment.run(h, t, truth, SMALL)
    p = r.predictions.toPandas()
    assert len(p) == truth.count() and p.row_id.is_unique and np.isfinite(p[[*experiment.ARMS, "nested_stack"]].to_numpy()).all()
    assert set(p[p.split == "holdout"].component).isdisjoint(p[p.split == "oof"].component)
    for b in r.stacks.values():
        w = np.array(list(b.weights.values()))
        assert w.min() >= 0 and w.sum() <= 1 + 1e-9 and b.parent_weight == pytest.approx(1 - w.sum())
    moved = p.assign(m=p.hgrg - p.incumbent)
    assert moved.m.abs().max() <= 10 + 1e-9 and np.sqrt((moved.m**2).groupby(moved.well).mean()).max() <= 2.5 + 1e-9
    assert r.scoreboard.count() == len(experiment.ARMS) + 1 and r.interval.first().draws == 20
    stack = next(iter(r.stacks.values()))
    with pytest.raises(ValueError):
        experiment.deploy((h, t, truth), h, t, stack, SMALL)


def test_truth_never_reaches_an_estimator(logs):
    h, t = logs
    poisoned = h.withColumn("TVT", F.col("TVT") + F.when(F.col("TVT_input").isNull(), 1e5).otherwise(0.0))
    assert "TVT" not in experts.observable(h).columns
    few = lambda x: x.where("well in ('syn_000', 'syn_001')")
    a, b = (sorted(map(tuple, experiment.physics(few(x), t, SMALL).collect())) for x in (h, poisoned))
    assert a == b


def test_initial_rate_arms(logs):
    h, t = logs
    few = h.where("well in ('syn_002', 'syn_003')")
    rates = experts.start_rates(few)
    assert rates.where("well = 'syn_002'").count() == 25  # 36 registered, of which 12 start alike
    truth = few.where("TVT_input is null").select("well", "row_number", F.col("TVT").alias("truth"))
    board = experiment.arms_grid(few, t, truth, [0, 1], experts.pf.FilterSettings(particles=16), windows=(30,), shrinks=(0.0, 1.0)).collect()
    assert len(board) == 4 and [r.rmse for r in board] == sorted(r.rmse for r in board)


def test_native_and_mapped_mixtures_agree(logs):
    h, t = logs
    paths = experts.particle_paths(h.where("well = 'syn_004'"), t, range(8), experts.pf.FilterSettings(particles=16)).persist()
    p = paths.toPandas()
    path, ev = (p.pivot(index="seed", columns="row_number", values=c).sort_index().to_numpy() for c in ("tvt", "evidence"))
    track = experts.pf.Track(path, ev)
    for least in (None, 4.0, 6.0):
        got = [r.tvt for r in experts.by_likelihood(paths, 8.0, least).orderBy("row_number").collect()]
        assert np.allclose(got, experts.pf.by_likelihood(track, 8.0, least))
    assert experts.candidate_paths(paths).select("candidate").distinct().count() == 40
    got = experts.robust(paths).orderBy("row_number").toPandas()
    assert np.allclose(got.trim1, experts.pf.robust(track, "trim1")) and np.allclose(got["median"], experts.pf.robust(track, "median"))


def test_features_are_numpy(spark):
    rng = np.random.default_rng(0)
    n, cut = 120, 80
    md = np.arange(n) * 1.5
    z, tvt = -9000 - 0.1 * md, 10050 + 5 * np.sin(md / 30)
    gr = 60 + rng.normal(0, 8, n)
    gr[[0, 17, 50, 119]] = np.nan
    pf, hmm = tvt + rng.normal(0, 1, n), tvt + rng.normal(0, 2, n)
    tx = np.arange(10000.0, 10100, 2)
    ty = 60 + 20 * np.sin(tx / 7)
    rows = [("w", i, float(md[i]), float(i), float(2 * i), float(z[i]), None if np.isnan(gr[i]) else float(gr[i]), float(tvt[i]) if i < cut else None, float(pf[i]), 1.0, float(hmm[i])) for i in range(n)]
    t = spark.createDataFrame(rows, "well string, rn int, md double, x double, y double, z double, gr double, tvt double, pf double, pf_std double, hmm double")
    c = spark.createDataFrame([("w", float(a), float(b)) for a, b in zip(tx, ty)], "well string, tvt double, gr double")
    got = features.build(t, c).orderBy("rn").toPandas()
    assert got.shape == (n - cut, 123) and list(got.columns[2:]) == sorted(got.columns[2:])
    s = pd.Series(gr).interpolate(limit_direction="both")
    h = md[cut:] - md[cut - 1]
    late = np.median(np.diff(tvt[cut - 50 : cut]) / np.diff(md[cut - 50 : cut]))
    assert np.allclose(got.grm21, s.rolling(21, center=True, min_periods=1).mean()[cut:]) and np.allclose(got.grs51, s.rolling(51, center=True, min_periods=2).std()[cut:])
    assert np.allclose(got.glead30, s.shift(-30).ffill()[cut:]) and np.allclose(got.gr_d2, np.gradient(np.gradient(s))[cut:])
    assert np.allclose(got.slp_50, late) and np.allclose(got.beam_loose_d, 1.15 * late * h) and np.allclose(got.md_since, h)
    ref = np.interp(tvt[:cut], tx, ty)
    a = np.clip(np.polyfit(ref, s[:cut], 1)[0], 0.25, 4)
    b = np.median(s[:cut] - a * ref)
    assert np.allclose(got.cal_a, a) and np.allclose(got.cal_b, b)
    assert np.allclose(got["tdpf-15"], s[cut:] - (a * np.interp(pf[cut:] - 15, tx, ty) + b)) and np.allclose(got.tda80, s[cut:] - (a * np.interp(hmm[cut:] + 80, tx, ty) + b))


def test_surface_is_exact_on_planes_and_anchors():
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 40_000, (30, 2))
    plane = 100 + xy @ [0.01, -0.02]
    s = experts.Surface(xy, plane)
    places = rng.uniform(0, 40_000, (50, 2))
    assert np.allclose(s(places), 100 + places @ [0.01, -0.02])
    rough = plane + rng.normal(0, 5, 30)
    assert np.allclose(experts.Surface(xy, rough, neighbours=12)(xy), rough)
    with pytest.raises(ValueError):
        experts.Surface(xy[:3], rough[:3])


def test_robust_blend_prefers_the_stable_arm(spark):
    rows = [(c, 0.0, 2.0, 1.0 + 0.05 * (i % 3), (0.1 if c != "c3" else 9.0)) for c in ("c1", "c2", "c3") for i in range(20)]
    t = spark.createDataFrame(rows, "component string, truth double, incumbent double, stable double, fragile double")
    w = blending.fit_robust(t, ["stable", "fragile"], tail=2.0).weights
    assert w["stable"] > w["fragile"] and sum(w.values()) <= 1 + 1e-9 and min(w.values()) >= 0


def test_trust_region_goes_to_its_cap(spark):
    t = spark.createDataFrame([(c, 0.0, 1.0, -1.0) for c in "abc" for _ in range(20)], "component string, truth double, sequential_final double, ridge double")
    assert blending.fit_trust_region(t, cap=0.05).weights == {"ridge": pytest.approx(0.05)}


def test_evaluation_fails_closed_and_unions(spark):
    rows = [(f"w{w}_{i}", f"w{w}", i, f"c{w // 2}", float(i), float(i % 5), float(i % 5) + 1.0 + w * 0.1, float(i % 5) - 0.5, w // 2 % 2) for w in range(8) for i in range(10)]
    t = spark.createDataFrame(rows, "row_id string, well string, row_number int, component string, horizon double, truth double, incumbent double, candidate double, fold int")
    reg = evaluation.Registry.from_dict({"contracts": [{"id": "p_oof", "panel": "p", "split": "oof", "models": ["incumbent", "candidate"], "baseline": "incumbent"}, {"id": "p_hold", "panel": "p", "split": "holdout", "models": ["incumbent", "candidate"], "baseline": "incumbent"}], "bounds": [3, 6], "draws": 20})
    parts = {"p_oof": t.where("fold = 0"), "p_hold": t.where("fold = 1").drop("fold")}
    e = evaluation.evaluate(parts, reg)
    assert e.checks.where("not passed").count() == 0 and e.models.count() == 4 and e.folds.count() == 2 and e.stability.count() == 4
    assert {r.model: r.mean_rank for r in e.stability.where("contract = 'p_oof'").collect()} == {"incumbent": 2.0, "candidate": 1.0}
    for broken in ({**parts, "p_hold": t.drop("fold")}, {**parts, "p_oof": parts["p_oof"].unionByName(parts["p_oof"])}, {**parts, "p_oof": parts["p_oof"].withColumn("candidate", F.lit(math.nan))}):
        with pytest.raises(Exception, match="disjoint|unique|finite"):
            evaluation.evaluate(broken, reg)
    with pytest.raises(ValueError):
        evaluation.Contract("x", "p", "oof", ("a",), "b")


def test_streamed_mixture_is_the_batch_one(spark, tmp_path):
    from cairn.operators.ordered import prequential
    from cairn.streaming.filters import prequential_stream

    rng = np.random.default_rng(2)
    rows = [("k", i, m, float(rng.normal()), float(rng.normal())) for i in range(12) for m in range(3)]
    schema = "key string, rn long, member int, value double, evidence double"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = prequential_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")), 3, 8.0).writeStream.format("memory").queryName("mixed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.rn: r.mixed for r in spark.table("mixed").collect()}
    want = {r.rn: r.mixed for r in prequential(spark.createDataFrame(rows, schema), "key", "member", "value", "evidence", 8.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_registered_candidates_cover_every_series(spark):
    from cairn.plans import domain

    d = "/root/testdata/sf0.001"
    want = {r.well for r in domain.paths(spark, d).select("well").distinct().collect()}
    got = {r.well: r.n for r in domain.d04b_registered_candidates(spark, d).groupBy("well").agg(F.count_distinct("candidate").alias("n")).collect()}
    assert len(want) > 4 and got.keys() == want and set(got.values()) == {40}


def test_physics_looks_at_every_hidden_row(spark):
    """One copy of a series for each hidden row, whose signal is another there: the smoothed path is another, too."""
    assert experiment.Config().grid == GridSettings() and GridSettings().stride == 1
    n, cut = 44, 30
    level = lambda i: 10050 + 6 * math.sin(i / 9)
    signal = lambda i: 70 + 25 * math.sin(level(i) / 9)
    rows = [(f"w{k}", i, float(i), i * 0.9, i * 0.3, -9000 - 0.05 * i, signal(i) + 60 * (i == k), level(i) if i < cut else None) for k in (0, *range(cut, n)) for i in range(n)]
    h = spark.createDataFrame(rows, "well string, row_number int, MD double, X double, Y double, Z double, GR double, TVT_input double").withColumn("GR", F.when(F.col("row_number") > 0, F.col("GR")))
    at = [10000.0 + 2 * i for i in range(50)]
    c = h.select("well").distinct().join(spark.createDataFrame([(x, 70 + 25 * math.sin(x / 9)) for x in at], "TVT double, GR double"))
    p = experiment.physics(h, c, experiment.Config(seeds=2, particles=8)).toPandas().pivot(index="row_number", columns="well", values="hmm")
    assert p.shape == (n - cut, n - cut + 1) and np.isfinite(p.to_numpy()).all()
    for k in range(cut, n):
        assert np.abs(p[f"w{k}"] - p["w0"]).max() > 1e-4, k
