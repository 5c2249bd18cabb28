"""Hand-computed values on a six-row panel, and resampling against loops."""

import hashlib
import math

import pytest

from cairn.operators import metrics as m

PANEL = [("r0", "w1", 1, "c1", 1.0, 2.0, 1.0, 0), ("r1", "w1", 2, "c1", 2.0, 2.0, 1.0, 0), ("r2", "w1", 3, "c1", 3.0, 2.0, 1.0, 0), ("r3", "w1", 4, "c1", 4.0, 2.0, 1.0, 0), ("r4", "w2", 1, "c2", 5.0, 2.0, 3.0, 1), ("r5", "w3", 1, "c3", 6.0, 2.0, 4.0, 1)]
ARMS = ["incumbent", "candidate"]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(*r[:5], 0.0, *r[5:]) for r in PANEL], "row_id string, well string, row_number int, component string, horizon double, truth double, incumbent double, candidate double, fold int")


def test_scoreboard(panel):
    got = {r.model: r for r in m.model_metrics(panel, ARMS, "incumbent").collect()}
    c = got["candidate"]
    assert c.pooled_rmse == pytest.approx(math.sqrt(29 / 6)) and c.macro_well_rmse == pytest.approx(8 / 3) == c.macro_component_rmse
    assert c.harmed_well_rate == pytest.approx(2 / 3) and c.tail_rmse == 4.0 and c.tail_components == 1 and c.worst_component_rmse == 4.0
    assert c.median_well_gain == -1.0 and got["incumbent"].harmed_well_rate == 0 and got["incumbent"].rank_pooled_rmse == 1.0


def test_horizon_bins_count_each_bound_once(panel):
    got = {(r.bin, r.model): r.rows for r in m.horizon_metrics(panel, ARMS, "incumbent", [2.0, 4.0]).collect()}
    assert got == {(b, a): 2 for b in ("0-2", ">2-4", ">4") for a in ARMS}


def test_fold_ranks(panel):
    got = {(r.fold, r.model): r["rank"] for r in m.fold_metrics(panel, ARMS, "incumbent").collect()}
    assert got[0, "candidate"] == 1 and got[1, "candidate"] == 2


def test_equal_scores_share_a_rank(spark):
    t = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 1.0), ("u", "c", 2.0)], "unit string, model string, rmse double")
    got = {r.model: (r["rank"], r.is_best) for r in m.rank_units(t, ["unit"], "c").collect()}
    assert got == {"a": (1.5, True), "b": (1.5, True), "c": (3.0, False)}


def test_two_tail_means_differ(spark):
    t = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)], "model string, v double")
    assert m.tail_mean(t, ["model"], "v", 0.5, "x").first().x == 3.5
    assert m.tail_mean(t, ["model"], "v", 0.5, "x", of_squares=True).first().x == pytest.approx(math.sqrt(3.5))
    assert m.tail_mean(t, ["model"], "v", 0.01, "x").first().x == 4.0


def test_bootstrap_draws_whole_groups(panel):
    got = {r.draw: r.gain for r in m.bootstrap_draws(m.group_stats(panel, "component", "incumbent", "candidate"), 40).collect()}
    stats = [(4, 16.0, 4.0), (1, 4.0, 9.0), (1, 4.0, 16.0)]
    for d, gain in got.items():
        own = [stats[int(hashlib.md5(f"{d}:{k}".encode()).hexdigest()[:8], 16) % 3] for k in range(3)]
        n, a, b = map(sum, zip(*own))
        assert gain == pytest.approx(math.sqrt(a / n) - math.sqrt(b / n))
    assert len(got) == 40 and len(set(got.values())) > 3


def test_weights_count_groups_alike(panel):
    rows = m.row_weights(panel).collect()
    assert sum(r.weight for r in rows) == pytest.approx(1) and sum(r.weight for r in rows if r.component == "c1") == pytest.approx(1 / 3)


def test_weighted_quantile(spark):
    t = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", 3.0, 2.0)], "k string, v double, w double")
    assert [m.weighted_quantile(t, ["k"], "v", "w", q).first().quantile for q in (0.25, 0.26, 0.5, 0.51, 1.0)] == [1.0, 2.0, 2.0, 3.0, 3.0]


def test_crossed_bootstrap_needs_no_pairs_of_rows(spark):
    t = spark.createDataFrame([(s, c, 100, 400.0 + s, 100.0 + 10 * s) for s in (1, 2, 3) for c in "abc"], "seed int, component string, n int, ref double, cand double")
    r = m.interval(m.crossed_bootstrap(t, 100)).first()
    assert r.draws == 100 and r.ci95_low > 0.8 and r.probability_positive == 1.0


def test_blend_grid_is_the_direct_error(spark, panel):
    rows = m.blend_grid(panel, "incumbent", "candidate", cap=0.1, step=0.05).collect()
    for r in rows:
        se = [(x[5] + r.w * (x[6] - x[5])) ** 2 for x in PANEL]
        assert r.row == pytest.approx(math.sqrt(sum(se) / 6))
    assert [r.objective for r in rows if r.w == 0] == [pytest.approx(1.0)]


def test_promotion(spark, panel):
    assert m.promotion(m.refit_metrics(panel, "incumbent", "candidate")).first().decision == "HOLD"
    assert m.promotion(m.refit_metrics(panel, "candidate", "truth")).first().decision == "PROMOTE"


def test_draws_are_never_broadcast(spark):
    """Their estimated size is that of a few rows, whatever the number of groups."""
    stats = spark.range(50).selectExpr("id AS pos", "1L AS n", "1.0D AS ref", "2.0D AS cand")
    by_draw = m.bootstrap_draws(stats, 20)
    ranks = m.bootstrap_ranks(spark.range(50).selectExpr("id AS component", "1.0D AS a", "2.0D AS b"), ["a", "b"], "a", 20)
    for t in (by_draw, ranks):
        assert t.count() == 20 * (1 if t is by_draw else 2)
        joins = [line for line in t._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "[pos#" in line]
        assert joins and not any("Broadcast" in line for line in joins)
