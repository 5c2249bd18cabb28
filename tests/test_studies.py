import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import particles as pf
from cairn.operators import experts, joins, metrics
from cairn.operators.checks import CheckFailure
from cairn.plans import blending as b
from cairn.plans import features, studies
from cairn.sources import files


def panel(seed=0, groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(int(rng.integers(5, 30))):
            truth = rng.normal(0, 10)
            rows.append((g * 10 + int(rng.integers(0, 3)), g, truth, truth + rng.normal(g % 4, 3), truth + rng.normal(0, 4), truth + rng.normal(1, 2)))
    return pd.DataFrame(rows, columns=["well", "component", "truth", "incumbent", "x", "y"])


def direct(p, made, squares):
    se = (p["truth"] - made) ** 2
    mse = se.groupby(p["component"]).mean()
    worst = mse.sort_values().iloc[-max(1, int(np.ceil(0.1 * len(mse)))) :]
    return np.sqrt(se.mean()), np.sqrt(mse).mean(), np.sqrt(worst.mean()) if squares else np.sqrt(worst).mean()


@pytest.fixture(scope="module")
def two(spark):
    a, c = panel(1), panel(2, 9)
    return a, c, spark.createDataFrame(a), spark.createDataFrame(c)


@pytest.mark.parametrize("kind, arms", [(studies.GROUP_ROBUST, ["x", "y"]), (studies.TRUST_REGION, ["y"])])
def test_transfer_is_that_of_rows(two, kind, arms):
    a, c, sa, sc = two
    small = studies.Kind(kind.settings[:3], kind.solve, kind.shares, kind.tie, kind.squares, kind.rule)
    ma, mc = b.group_moments(sa, arms, "incumbent"), b.group_moments(sc, arms, "incumbent")
    made = studies.transfer(sa.sparkSession, ma, mc, arms, small, seeds=(1, 2), folds=4)
    blend = lambda p, w: p["incumbent"] + sum(v * (p[k] - p["incumbent"]) for k, v in w.items())
    assert made.parent == pytest.approx(direct(c, c["incumbent"], kind.squares)) and made.frozen == pytest.approx(direct(c, blend(c, made.weights), kind.squares))
    base, totals = direct(a, a["incumbent"], kind.squares), {}
    for setting in small.settings:
        each = []
        for seed in (1, 2):
            fold = b.assign(a.groupby("component").size().to_dict(), 4, kind.rule, seed)
            out = pd.Series(np.nan, a.index)
            for k in range(4):
                own = a["component"].map(fold) == k
                w = kind.solve(ma.take(np.array([fold[g] != k for g in ma.groups])), setting)
                out[own] = blend(a[own], dict(zip(arms, w)))
            each.append(sum(s * x / y for s, x, y in zip(kind.shares, direct(a, out, kind.squares), base)))
        totals[setting] = np.mean(each), np.std(each)
    for setting, mean, std in made.grid:
        assert (mean, std) == pytest.approx(totals[setting], abs=1e-9)
    assert made.setting == made.grid[0][0] and made.grid[0][1] == min(m for _, m, _ in made.grid)


def test_both_ways_and_the_frozen_gain(two):
    _, c, sa, sc = two
    out = studies.both_ways(sa, sc, ["y"], "incumbent", studies.TRUST_REGION, 20)
    assert set(out) == {"a_to_b", "b_to_a"}
    made, gain = out["a_to_b"]
    assert 0 <= made.weights["y"] <= 0.25 and gain.count() == 1
    grid = metrics.blend_grid(sa, "incumbent", "y", 0.1).orderBy(F.round("objective", 14), "w").first()
    assert b.solve_trust_region(b.group_moments(sa, ["y"], "incumbent"), 0.1, 0.25, 0.25, 0.01) == pytest.approx(grid.w)


def test_tie_rules():
    sizes = {f"g{i}": 5 for i in range(9)} | {"big": 20}
    for rule in b.TIES:
        fold = b.assign(sizes, 3, rule, 4)
        assert fold == b.assign(sizes, 3, rule, 4) and fold["big"] == 0 and set(fold.values()) == {0, 1, 2}
    assert b.assign(sizes, 3, "draw", 1) != b.assign(sizes, 3, "draw", 2)
    with pytest.raises(ValueError):
        b.assign(sizes, 3, "other")


def test_registered_panels_and_runs(spark, tmp_path):
    universe = spark.createDataFrame([(f"w{i:03d}", f"c{i // 3:02d}") for i in range(90)], "well string, component string")
    prior = spark.createDataFrame([("w000",), ("w031",)], "well string")
    root = str(tmp_path / "study")
    first = studies.register_panel(universe, prior, 40, 7, root, "digest")
    chosen = spark.read.option("header", True).csv(f"{root}/registration/panel")
    assert first["units"] == chosen.count() <= 40 and chosen.where("component in ('c00', 'c10')").count() == 0
    assert {r[1] for r in chosen.groupBy("component").count().collect()} == {3}  # whole groups
    assert studies.register_panel(universe, prior, 40, 99, root, "digest") == first
    with pytest.raises(CheckFailure):
        studies.register_panel(universe, prior, 40, 7, root, "other data")
    with pytest.raises(CheckFailure):
        studies.register_panel(universe, prior, 6, 7, str(tmp_path / "small"), "digest")
    calls = []

    def run(seed):
        calls.append(seed)
        return {"scores": spark.createDataFrame([(seed, 1.5)], "seed int, rmse double")}, {"n": 1}

    assert studies.resumable_runs(spark, root, "digest", [1, 2], run) == [(1, "made"), (2, "made")]
    assert studies.resumable_runs(spark, root, "digest", [1, 2, 3], run) == [(1, "kept"), (2, "kept"), (3, "made")] and calls == [1, 2, 3]
    target = next((tmp_path / "study/seed-2/scores").glob("*.csv.gz"))
    (target.parent / f".{target.name}.crc").unlink()
    target.write_bytes(b"")
    with pytest.raises(CheckFailure):
        studies.resumable_runs(spark, root, "digest", [2], run)


def test_subsets_and_dispatch(spark):
    universe = spark.createDataFrame([(f"w{i}", f"c{i // 2}") for i in range(20)], "well string, component string")
    a, c = (set(r.well for r in studies.subset(universe, 9, role, 3).collect()) for role in ("primary", "complement"))
    assert len(a) == 8 and a | c == {f"w{i}" for i in range(20)} and not a & c
    data = tuple(universe.withColumn(n, F.lit(1)) for n in ("s", "k", "t"))
    seen = studies.dispatch(spark, "full", lambda *t: [x.count() for x in t], data, universe, 9, "complement", 3)
    assert seen == [12, 12, 12]
    series, curves, truth = studies.dispatch(spark, "smoke", lambda *t: t, wells=10, rows=100)
    assert "TVT" not in series.columns and truth.count() == 10 * 38 and curves.count()
    for bad in (lambda: studies.dispatch(spark, "other", None), lambda: studies.dispatch(spark, "full", None), lambda: studies.subset(universe, 3, "some", 0)):
        with pytest.raises(ValueError):
            bad()


def test_only_the_selected_arm_runs(spark):
    series, curves = files.synthetic_logs(spark, 10, 100)
    truth = series.where("TVT_input is null").select("well", "row_number", F.col("TVT").alias("truth"))
    logs = series.drop("TVT", *files.TOPS)
    scored, gain = studies.frozen_arm(logs, curves, truth, "zero", "zero", range(2), pf.FilterSettings(particles=50))
    assert scored.count() == 380 and gain.count() == 1
    for chosen, arm in (("zero", "w030_median_s1.0"), ("no such arm", "no such arm")):
        with pytest.raises(CheckFailure):
            studies.frozen_arm(logs, curves, truth, chosen, arm, range(2))
    full = experts.full_paths(logs, curves, range(2), pf.FilterSettings(particles=50))
    seen = full.where("known").join(series.select("well", "row_number", F.col("TVT_input").alias("visible")), ["well", "row_number"]).where("tvt = visible").count()
    assert full.count() == 1000 and seen == 620 and full.where("tvt is null").count() == 0


def test_blocks_of_seeds_are_single_seeds(spark, monkeypatch):
    series, curves = files.synthetic_logs(spark, 10, 100)
    logs, s = series.drop("TVT", *files.TOPS).where("well < 'syn_003'"), pf.FilterSettings(particles=40)
    key = lambda t: sorted((r.well, r.seed, r.row_number, round(r.tvt, 9), round(r.evidence, 9)) for r in t.collect())
    whole = key(experts.particle_paths(logs, curves, range(5), s))
    monkeypatch.setattr(experts, "SEEDS", 2)
    assert whole == key(experts.particle_paths(logs, curves, range(5), s)) and len(whole) == 3 * 5 * 38


def test_particle_deviation_is_that_of_the_weighted_particles():
    """A filter written out seed by seed, drawing from the same streams."""
    from test_kernels import well

    frame, curve, _ = well(130, 100)
    s = pf.FilterSettings(particles=60)
    got = pf.track(frame, curve, [3, 4], s)
    known = np.isfinite(frame["TVT_input"])
    hidden, last = np.flatnonzero(~known), int(np.flatnonzero(known)[-1])
    gr = pf.fill_by_index(frame["GR"], float(curve.value.mean()))
    sigma = float(np.clip(np.std(np.nan_to_num(frame["GR"][known]) - curve(frame["TVT_input"][known])), 10, 60))
    rate = pf.start_rate(frame["MD"][known], (frame["TVT_input"] + frame["Z"])[known])
    for k, seed in enumerate((3, 4)):
        move, again, n = np.random.default_rng(seed), np.random.default_rng([seed, 1]), 60
        first = move.standard_normal((2, n))
        u, v, w = frame["TVT_input"][last] + frame["Z"][last] + 4.5 * first[0], rate + 0.01 * first[1], np.full(n, 1 / n)
        before = frame["MD"][last]
        noise = move.standard_normal((len(hidden), 2, n))
        for t, row in enumerate(hidden):
            step = max(frame["MD"][row] - before, 1.0)
            v = 0.998 * v + 0.002 * noise[t, 0]
            at = np.clip(u + v * step + 0.005 * noise[t, 1] - frame["Z"][row], curve.at[0] - 100, curve.at[-1] + 100)
            w = w * np.maximum(np.exp(-0.5 * np.minimum(((gr[row] - curve(at)) / sigma) ** 2, 600)), 1e-300)
            w, u, before = w / w.sum(), at + frame["Z"][row], frame["MD"][row]
            if 1 / (w @ w) < 0.5 * n:
                marks, fresh = again.random() / n + np.arange(n) / n, again.standard_normal((2, n))
                pick = np.minimum(np.searchsorted(np.cumsum(w), marks), n - 1)
                u, v, w = u[pick] + 0.1 * fresh[0], v[pick] + 0.001 * fresh[1], np.full(n, 1 / n)
            mean = w @ (u - frame["Z"][row])
            assert got.path[k, t] == pytest.approx(mean, abs=1e-6)
            assert got.deviation[k, t] == pytest.approx(np.sqrt(w @ (u - frame["Z"][row] - mean) ** 2), abs=1e-6)


def test_historical_deviation_is_not_nought(spark):
    from cairn.plans import historical

    series, curves = files.synthetic_logs(spark, 10, 100)
    t = historical.build(series.drop("TVT", *files.TOPS).where("well < 'syn_002'"), curves, features.NAMES, particles=50)
    assert t.where("pf_ancc_std <= 0").count() == 0 and t.count() == 76


@pytest.mark.parametrize("knots", [1, 2, 5, 4096, 4097, 20_000])
def test_look_up_has_no_bound_on_knots(spark, knots):
    x = np.arange(float(knots))
    asked = [-1.0, 0.0, 0.5, knots / 2 + 0.5, knots * 0.7 + 0.25, knots - 1.0, knots + 5.0]
    t = spark.createDataFrame([(x.tolist(), (x**2).tolist(), asked)], "tx array<double>, ty array<double>, q array<double>")
    got = t.select(F.transform("q", lambda q: features.look_up(q, F.col("tx"), F.col("ty")))).first()[0]
    assert np.allclose(got, np.interp(asked, x, x**2))


def test_places_of_streams_are_those_of_look_up(spark):
    """Curves of one knot, with equal knots and with knots that are no number; places of nulls, NaN, infinities and exact knots."""
    nan, inf = float("nan"), float("inf")
    curves = [("a", [1.0], [5.0]), ("b", [0.0, 0.0, 1.0, 1.0], [1.0, 2.0, 3.0, 4.0]), ("c", [0.0, 2.0, nan], [1.0, 5.0, 9.0]), ("d", [nan, nan], [3.0, 4.0]), ("e", [-inf, 0.0, 10.0, inf], [0.0, 1.0, 7.0, 9.0]), ("alone", [0.0], [0.0])]
    c = spark.createDataFrame(curves, "well string, _tx array<double>, _ty array<double>")
    asked = [None, nan, -inf, inf, -1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 10.0, 11.0] * 3
    rows = [(w, i, x, i) for w in ("a", "b", "c", "d", "e", "none") for i, x in enumerate(asked)]
    t = spark.createDataFrame(rows, "well string, rn int, x double, n int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.well, r.rn): r.v for r in features.at_places(t, c, "well", [("x", (0, 1.5)), ("n", (-3,))], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    look = lambda x: features.look_up(x, F.col("_tx"), F.col("_ty"))
    want = t.join(c, "well").select("well", "rn", F.array(look(F.col("x") + 0.0), look(F.col("x") + 1.5), look(F.col("n") - 3.0)).alias("v")).collect()
    assert len(got) == len(want) == 5 * len(asked)
    assert all(str(got[r.well, r.rn]) == str(r.v) for r in want)


def test_features_look_up_their_places_in_streams(spark):
    """No interpreted search for each place of each row, and no curve beside each row."""
    from cairn.plans import domain

    plan = domain.d07_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(1, greatest(" not in plan and "aggregate(sequence(" not in plan


def test_rows_are_numbered_over_ranges(spark):
    t = spark.createDataFrame([(i * 37 % 1009, i) for i in range(1009)], "k int, v int").repartition(7)
    got = joins.numbered(t, ["k"], "n")
    assert all(r.k == r.n for r in got.collect()) and got.columns == ["k", "v", "n"]


def test_npz_panels_and_logs_come_back(spark, tmp_path):
    t = spark.createDataFrame([(f"w{i}", i, i / 3) for i in range(50)], "well string, fold int, truth double")
    made = files.write_npz(t.repartition(4), str(tmp_path / "npz"))
    back = files.panel_from_npz(spark, str(tmp_path / "npz/*.npz"))
    assert 1 <= made <= 4 and sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    series, curves = files.synthetic_logs(spark, 10, 100)
    files.write_logs(series.select("well", "row_number", *files.HORIZONTAL), curves, str(tmp_path / "logs"))
    read = files.LogStore(spark, str(tmp_path / "logs")).horizontal()
    both = read.join(series.select("well", "row_number", F.col("GR").alias("g"), F.col("TVT_input").alias("v")), ["well", "row_number"])
    assert both.count() == 1000 and both.where("abs(GR - g) > 1e-9 or not (TVT_input <=> v)").count() == 0
