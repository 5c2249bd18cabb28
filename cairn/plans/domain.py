"""Queries for the per-series and whole-plan operators, on series made from ``events`` and panels made from ``lineitem``.

A user's events are a series: depth is the row number, the signal is ``value``, and the hidden level is a closed form. Overlays have
SQL forms; recursions do not and are held against plain loops in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.grid import GridSettings
from cairn.functions.particles import FilterSettings
from cairn.operators import experts, groups, metrics, ordered, overlays
from cairn.plans import blending, boosting, evaluation, features, historical, routing, studies
from cairn.plans.relational import ARMS, BOUNDS, SERIES, panel, rounded, series
from cairn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The ensemble of the recorded runs.
SEEDS = range(8)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Series ``well, row_number, MD, X, Y, Z, GR, TVT_input, truth`` and curves ``well, row_number, TVT, GR``."""
    t = series(spark, d).select(F.col("user_id").cast("string").alias("well"), "user_id", F.col("rn").cast("int").alias("row_number"), F.col("gr").alias("GR"), "known")
    rn, u = F.col("row_number").cast("double"), F.col("user_id") % 7
    t = t.withColumns({"MD": rn, "X": F.col("user_id") * 900.0 + rn * 0.9, "Y": F.col("user_id") % 10 * 700.0 + rn * 0.3, "Z": -9800 - 0.02 * rn, "truth": 10050 + 12 * F.sin(rn / 15 + u)})
    t = t.withColumn("TVT_input", F.when(F.col("known"), F.col("truth")))
    users = t.select("well").distinct()
    c = users.select("well", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("row_number")).withColumn("TVT", 9990 + 2.0 * F.col("row_number"))
    return t.select("well", "row_number", "MD", "X", "Y", "Z", "GR", "TVT_input", "truth"), c.withColumn("GR", 50 + 25 * F.sin(F.col("TVT") / 9))


def paths(spark: SparkSession, d: str) -> DataFrame:
    t, c = logs(spark, d)
    return experts.particle_paths(t, c, SEEDS, FilterSettings())


@query()
def d01_single_trace(spark, d):
    """The path of one seed."""
    t, c = logs(spark, d)
    return experts.particle_paths(t, c, [0], FilterSettings()).select("well", "row_number", "tvt", "evidence")


@query("""WITH c AS (SELECT user_id, value::DOUBLE AS knot, CASE WHEN event_id % 7 <> 0 THEN (event_id % 101)::DOUBLE END AS v FROM events WHERE event_id % 11 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY knot, v NULLS FIRST) - 1 AS i, avg(v) OVER (PARTITION BY user_id) AS m, count(v) OVER (PARTITION BY user_id) AS known, stddev_pop(v) OVER (PARTITION BY user_id) AS sd FROM c),
    g AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS a, max(CASE WHEN v IS NOT NULL THEN i END) OVER w AS ai, first_value(v IGNORE NULLS) OVER z AS b, min(CASE WHEN v IS NOT NULL THEN i END) OVER z AS bi FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, i, round(knot, 6) AS knot, round(coalesce(v, m, 0), 6) AS mean_filled, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN coalesce(b, 0) WHEN b IS NULL THEN a ELSE a + (b - a) * (i - ai) / (bi - ai) END, 6) AS line_filled, known, round(CASE WHEN known >= 20 THEN sd ELSE 30 END, 6) AS noise FROM g""")
def d41_kernel_inputs(spark, d):
    e = F.col("event_id")
    at = F.when(e % 11 != 0, F.col("value")).otherwise(F.when(e % 2 == 0, F.lit(float("nan"))))  # knots without a place are left out
    curves = table(spark, d, "events").select("user_id", at.alias("knot"), F.when(e % 7 != 0, (e % 101).cast("double")).alias("v"))
    t = ordered.curve_inputs(curves, "user_id", "knot", "v")
    return rounded(t.select("user_id", F.col("i").cast("bigint").alias("i"), "knot", "mean_filled", "line_filled", "known", "noise"), 6)


@query()
def d02_particle_paths(spark, d):
    return paths(spark, d)


@query()
def d03_likelihood_mixture(spark, d):
    return experts.by_likelihood(paths(spark, d), 8.0, 4.0)


@query()
def d04_robust_mixtures(spark, d):
    return experts.robust(paths(spark, d))


@query()
def d04b_registered_candidates(spark, d):
    t, c = logs(spark, d)
    return experts.candidate_paths(experts.particle_paths(t, c, SEEDS, FilterSettings()))


@query()
def d05_grid_paths(spark, d):
    return experts.grid_paths(*logs(spark, d), GridSettings())


def _arms(spark, d) -> DataFrame:
    v = F.col("value")
    t = series(spark, d).withColumns({"pf": v * 1.05, "hmm": v * 0.97 + 2, "ridge": v * 0.9 + 5, "nonlinear": v * 1.01, "base": v, "z": -0.5 * F.col("rn")})
    return t


ARM = SERIES + ", a AS (SELECT user_id, event_id, rn, md, rn < cut AS known, value AS base, value * 1.05 AS pf, value * 0.97 + 2 AS hmm, value * 0.9 + 5 AS ridge, value * 1.01 AS nonlinear, -0.5 * rn AS z FROM s)"


@query()
def d07_features(spark, d):
    t, c = logs(spark, d)
    t = t.select("well", F.col("row_number").alias("rn"), F.col("MD").alias("md"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"), F.col("GR").alias("gr"), F.col("TVT_input").alias("tvt"), (F.col("truth") + 1).alias("pf"), F.lit(2.0).alias("pf_std"), (F.col("truth") - 2).alias("hmm"))
    return features.build(t, c.select("well", F.col("TVT").alias("tvt"), F.col("GR").alias("gr")))


@query()
def d08_historical_features(spark, d):
    t, c = logs(spark, d)
    return historical.build(t, c, features.NAMES)


@query()
def d10_ridge_scores(spark, d):
    p = panel(spark, d)
    names = ["horizon", "incumbent", "candidate"]
    m = blending.ridge_by_moments(p, names, "truth")
    return p.withColumn("ridge", blending.ridge_column(m, names)).groupBy("component").agg(F.round(metrics.rmse("truth", "ridge"), 4).alias("rmse"))


@query()
def d10b_boosted_scores(spark, d):
    p, names = panel(spark, d), ["horizon", "incumbent", "candidate"]
    m = boosting.fit(p, names, "truth", trees=4, leaves=31, rate=0.3, l2=1.0, least=30)
    return p.withColumn("boosted", m.column(names)).groupBy("component").agg(F.round(metrics.rmse("truth", "boosted"), 4).alias("rmse"))


@query(f"""WITH {ARM}, b AS (SELECT *, 0.3 * ridge + 0.7 * pf AS b, nonlinear - (0.3 * ridge + 0.7 * pf) AS dl FROM a), q AS (SELECT *, quantile_cont(abs(dl), 0.95) OVER (PARTITION BY user_id) AS p FROM b)
    SELECT event_id, round(b + CASE WHEN p <= 25 THEN 0.00425 / (1 + (abs(dl) / 6) ** 2) * dl ELSE 0 END, 6) AS incumbent FROM q""")
def d11_parent_blend(spark, d):
    t = overlays.parent_blend(_arms(spark, d), "user_id", "ridge", "pf", "nonlinear")
    return rounded(t.select("event_id", "incumbent"), 6)


BRIDGE = ARM + """, q AS (SELECT *, pf + 0.5 * (hmm - pf) - base AS q, ridge - base AS l FROM a), k AS (SELECT *, greatest(sqrt(avg(q * q) OVER w), 1e-12) AS size, sqrt(avg((hmm - pf) ** 2) OVER w) AS disp, sum(q * l) OVER w / greatest(sum(q * q) OVER w, 1e-12) AS al FROM q WINDOW w AS (PARTITION BY user_id)),
    g AS (SELECT *, (0.25 + 0.75 * least(1, (1 / greatest(disp / size * exp(-2 * least(greatest(al, -1), 1)), 1e-12)) ** 2)) * least(0.5, 2.5 / size) AS kk FROM k), hgrg AS (SELECT *, base + least(greatest(least(greatest(md / 250, 0), 1) * kk * q, -10), 10) AS hgrg FROM g)"""


@query(f"WITH {BRIDGE} SELECT event_id, round(hgrg, 6) AS hgrg FROM hgrg")
def d12_bridge(spark, d):
    t = overlays.bridge(_arms(spark, d), "user_id", "base", "ridge", "pf", "hmm", "md")
    return rounded(t.select("event_id", "hgrg"), 6)


def _radial(raw: str, name: str, source: str, rms_cap: float, row_cap: float) -> str:
    return f"SELECT event_id, round(base + least(1, {rms_cap} / greatest(sqrt(avg(({raw}) ** 2) OVER (PARTITION BY user_id)), 1e-12), {row_cap} / greatest(max(abs({raw})) OVER (PARTITION BY user_id), 1e-12)) * ({raw}), 6) AS {name} FROM {source}"


@query(f"WITH {ARM} {_radial('hmm - base', 'projected', 'a', 1.0, 1.5)}")
def d13_radial(spark, d):
    return rounded(overlays.radial(_arms(spark, d), "user_id", "base", "hmm", "projected", 1.0, 1.5).select("event_id", "projected"), 6)


@query()
def d14_nearest_within(spark, d):
    t = _arms(spark, d).select(F.col("user_id").cast("string").alias("well"), F.col("rn").cast("int").alias("row_number"), "base", "hmm")
    return experts.nearest_within(t, "base", "hmm", 1.0, 1.5)


@query()
def d15_surface(spark, d):
    t, _ = logs(spark, d)
    return experts.structural_paths(t, experts.anchors(t.withColumnRenamed("truth", "TVT")))


def _experts(spark, d) -> DataFrame:
    t, _ = logs(spark, d)
    h = t.where("TVT_input is null").withColumn("horizon", F.col("MD") - F.min("MD").over(metrics.Window.partitionBy("well")) + 1)
    x = F.col("truth")
    return h.select("well", "row_number", "horizon", (x + 3).alias("hgrg"), (x + 1).alias("pf"), (x - 2).alias("hmm"), (x + 0.05 * F.col("row_number")).alias("structural"), F.lit(4.0).alias("prefix_cv"))


@query()
def d18_meta_state(spark, d):
    return experts.fused(_experts(spark, d))


@query()
def d21_switching(spark, d):
    return experts.switched(_experts(spark, d))


TANGENT = ARM + """, v AS (SELECT *, CASE WHEN known THEN base + z END AS u, arg_max(md, CASE WHEN known THEN rn END) OVER (PARTITION BY user_id) AS p0 FROM a), w0 AS (SELECT *, arg_max(u, CASE WHEN known THEN rn END) OVER (PARTITION BY user_id) AS u0 FROM v),
    x AS (SELECT *, count(*) FILTER (known AND md >= p0 - 256) OVER (PARTITION BY user_id) AS n, sum(CASE WHEN known AND md >= p0 - 256 THEN (md - p0) ** 2 END) OVER (PARTITION BY user_id) AS xx, sum(CASE WHEN known AND md >= p0 - 256 THEN (md - p0) * (u - u0) END) OVER (PARTITION BY user_id) AS xy FROM w0),
    y AS (SELECT *, least(greatest(exp(-(md - p0) / 256) * (u0 + CASE WHEN n >= 8 AND xx > 1e-12 THEN xy / xx ELSE 0 END * (md - p0) - (base + z)), -10), 10) AS mv FROM x WHERE NOT known)"""


@query(f"WITH {TANGENT} {_radial('mv', 'prefix_boundary', 'y', 2.5, 10.0)}")
def d19_prefix_tangent(spark, d):
    return rounded(overlays.prefix_tangent(_arms(spark, d), "user_id", "base", "md", "base", "z", "known").select("event_id", "prefix_boundary"), 6)


SHAPE = ARM + """, d0 AS (SELECT *, hmm - pf AS d FROM a), d1 AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY rn) AS s FROM d0), d2 AS (SELECT *, sqrt(avg(d * d) OVER w) AS am, d - avg(d) OVER w AS c, coalesce(sqrt(avg(s * s) OVER w), 0) AS ss FROM d1 WINDOW w AS (PARTITION BY user_id)),
    d3 AS (SELECT *, 0.25 / (1 + (am / 6.41825) ** 2) * (ss / greatest(am, 1e-12)) / (ss / greatest(am, 1e-12) + 0.0090056) * c AS mv FROM d2)"""


@query(f"WITH {SHAPE} {_radial('mv', 'shape', 'd3', 0.75, 2.5)}")
def d20_centered_shape(spark, d):
    return rounded(overlays.centered_shape(_arms(spark, d), "user_id", "base", "pf", "hmm").select("event_id", "shape"), 6)


def _weights(spark, b: blending.Blend) -> DataFrame:
    return spark.createDataFrame([*b.weights.items(), (b.parent, b.parent_weight)], "arm string, weight double")


@query()
def d22_convex_stack(spark, d):
    return _weights(spark, blending.fit_stack(panel(spark, d), ["candidate", "blend"], "incumbent", 0.01))


@query()
def d23_robust_blend(spark, d):
    return _weights(spark, blending.fit_robust(panel(spark, d), ["candidate", "blend"]))


ROUTED = ["candidate", "blend"]


def _units(spark, d) -> tuple[DataFrame, list[str]]:
    u = metrics.unit_features(panel(spark, d), ROUTED, "incumbent", ["l_orderkey", "l_linenumber", "l_partkey", "truth", "incumbent", "candidate"])
    return u, [c for c in u.columns if c not in ("well", "component", "fallback_mse") and not c.startswith("gain_")]


@query()
def d25_regret_router(spark, d):
    units, names = _units(spark, d)
    choice = routing.fit(units, ROUTED, names, folds=2).route(units, 0.7, ["well", "component"])
    t = overlays.routed(panel(spark, d), choice, "well", "incumbent", ROUTED, 0.5, "routed")
    return t.groupBy("well").agg(F.round(metrics.rmse("truth", "routed"), 4).alias("routed"), F.round(metrics.rmse("truth", "incumbent"), 4).alias("incumbent"))


@query()
def d27_group_split(spark, d):
    sizes = panel(spark, d).groupBy(F.col("component").cast("string").alias("component")).agg(F.count("*").alias("n"))
    return groups.holdout_and_folds(sizes, "component", "n", 0.2, 3, 7).select("component", "fold")


@query()
def d29_group_sample(spark, d):
    units = table(spark, d, "supplier").select(F.col("s_nationkey").alias("component"), F.col("s_suppkey").cast("string").alias("well"))
    chosen = groups.whole_groups(units.groupBy("component").agg(F.count("*").alias("n")), "component", "n", 40, 3)
    return units.join(chosen, "component", "left_semi").select("well")


def _registry() -> evaluation.Registry:
    return evaluation.Registry((evaluation.Contract("all_oof", "all", "oof", tuple(ARMS), "incumbent"),), tuple(BOUNDS), 0.1, 50)


def _panel(spark, d) -> DataFrame:
    t = panel(spark, d)
    w = metrics.Window.partitionBy("well").orderBy("l_orderkey", "l_linenumber", "l_partkey", "truth", "incumbent", "candidate")
    t = t.withColumn("row_number", F.row_number().over(w))
    return t.withColumn("row_id", F.concat_ws("_", "well", "row_number")).select("row_id", "well", "row_number", "component", "fold", "horizon", "truth", *ARMS)


@query()
def d33_evaluation_checks(spark, d):
    return evaluation.evaluate({"all_oof": _panel(spark, d)}, _registry(), fail=False).checks


@query()
def d33b_rank_stability(spark, d):
    return rounded(evaluation.evaluate({"all_oof": _panel(spark, d)}, _registry(), fail=False).stability)


@query()
def d33c_grouping_sets(spark, d):
    return rounded(evaluation.grouped_scores(panel(spark, d), ARMS))


SQL["d33c_grouping_sets"] = """WITH p AS (SELECT l_suppkey AS well, s_nationkey AS component, l_extendedprice AS truth, l_extendedprice * (1 - l_discount) AS incumbent, l_extendedprice * (1 + l_tax) AS candidate, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS blend FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    l AS (SELECT component, well, truth, m.model, m.v FROM p, LATERAL (SELECT unnest(['incumbent', 'candidate', 'blend']) AS model, unnest([incumbent, candidate, blend]) AS v) m)
    SELECT CASE WHEN grouping(well) = 0 THEN 'well' WHEN grouping(component) = 0 THEN 'component' ELSE 'all' END AS grain, component, well, count(*) AS n, model, round(sqrt(avg((truth - v) ** 2)), 4) AS rmse FROM l GROUP BY GROUPING SETS ((component, well, model), (component, model), (model))"""


@query()
def d34_refits(spark, d):
    base = _panel(spark, d)
    runs = {k: base.withColumn("candidate", F.col("truth") + (F.col("candidate") - F.col("truth")) * (0.4 + 0.1 * k)) for k in (1, 2, 3)}
    each, _, _ = evaluation.refits(runs, "incumbent", "candidate", 50)
    return rounded(each)


@query("""""" + "WITH " + SERIES + """, k AS (SELECT user_id, rn, 10050 + 12 * sin(rn / 15.0::DOUBLE + user_id % 7) + (-9800 - 0.02::DOUBLE * rn) AS u, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back, count(*) OVER (PARTITION BY user_id) AS m FROM s WHERE rn < cut),
    x AS (SELECT *, least(w, m) AS size FROM (SELECT *, u - lag(u) OVER (PARTITION BY user_id ORDER BY rn) AS d FROM k), (VALUES (30), (50), (120), (200)) t(w) WHERE back <= w),
    g AS (SELECT user_id, w, any_value(size) AS size, median(d) FILTER (back < size) AS med, (arg_min(u, back) - arg_max(u, back)) / (max(rn) - min(rn)) AS en, regr_slope(u, rn) AS ls, count(d) FILTER (back < size) AS steps FROM x GROUP BY ALL),
    r AS (SELECT user_id, w, kind, CASE WHEN size < 3 THEN 0 WHEN kind = 'median' THEN CASE WHEN steps >= 3 THEN med ELSE 0 END WHEN kind = 'endpoint' THEN en ELSE ls END AS rate FROM g, (VALUES ('median'), ('endpoint'), ('least_squares')) q(kind))
    SELECT user_id::VARCHAR AS well, 'zero' AS arm, 0.0::DOUBLE AS rate FROM (SELECT DISTINCT user_id FROM s) UNION ALL
    SELECT user_id::VARCHAR, 'w' || lpad(w::VARCHAR, 3, '0') || '_' || kind || '_s' || sh, round(sh::DOUBLE * rate, 6) + 0.0 FROM r, (VALUES ('0.5'), ('1.0')) z(sh)""")
def d35_start_rates(spark, d):
    return rounded(experts.start_rates(logs(spark, d)[0]), 6).withColumn("rate", F.col("rate") + F.lit(0.0))


@query()
def d37_chord_filter(spark, d):
    t, c = logs(spark, d)
    return experts.particle_paths(t, c, SEEDS, FilterSettings(chord=True))


@query()
def d06_reference_filter(spark, d):
    t, c = logs(spark, d)
    return experts.full_paths(t, c, SEEDS)


@query()
def d28_balanced_folds(spark, d):
    sizes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("component")).agg(F.count("*").alias("size"))
    ties = {"name": None, "draw": groups.draw(3101, "component"), "draw_back": F.reverse(groups.draw(3101, "component"))}
    made = [groups.balanced_folds(sizes, "component", "size", 5, tie).select(F.lit(rule).alias("rule"), "component", "fold", "size") for rule, tie in ties.items()]
    return made[0].unionAll(made[1]).unionAll(made[2])


def _panels(spark, d) -> tuple[DataFrame, DataFrame]:
    p = panel(spark, d)
    return p.where("component < 13"), p.where("component >= 13")


def _transfers(spark, d, arms, kind) -> DataFrame:
    rows = []
    for name, (t, _) in studies.both_ways(*_panels(spark, d), arms, "incumbent", kind).items():
        for place, (setting, mean, std) in enumerate(t.grid):
            rows.append((name, place, str(setting), mean, std, *t.parent, *t.frozen, sum(t.weights.values())))
    return spark.createDataFrame(rows, "direction string, place int, setting string, mean double, std double, parent_row double, parent_macro double, parent_tail double, frozen_row double, frozen_macro double, frozen_tail double, moved double")


@query()
def d39_robust_transfer(spark, d):
    return _transfers(spark, d, ["candidate", "blend"], studies.GROUP_ROBUST)


@query()
def d39b_trust_region_transfer(spark, d):
    return _transfers(spark, d, ["candidate"], studies.TRUST_REGION)


@query()
def d25b_nested_router(spark, d):
    units, names = _units(spark, d)
    made = routing.nested(units.join(studies.unit_moments(panel(spark, d), ROUTED, "incumbent"), "well"), F.col("component") >= 18, ROUTED, names)
    rows = [(q, b, v, (q, b) == (made.quantile, made.blend), made.holdout, made.fallback) for (q, b), v in made.grid.items()]  # the grid of settings
    return spark.createDataFrame(rows, "quantile double, blend double, rmse double, chosen boolean, holdout double, fallback double")


@query()
def d36_frozen_arm(spark, d):
    t, c = logs(spark, d)
    truth = t.where("TVT_input is null").select("well", "row_number", "truth")
    chosen = "w120_least_squares_s0.5"
    scored, gain = studies.frozen_arm(t.drop("truth"), c, truth, chosen, chosen, SEEDS)
    return gain.crossJoin(F.broadcast(scored.agg(metrics.rmse("truth", "candidate").alias("candidate"), metrics.rmse("truth", "reference").alias("reference"), F.count("*").alias("rows"))))


@query()
def d40_physics(spark, d):
    from cairn.plans import experiment

    t, c = logs(spark, d)
    return experiment.physics(t.drop("truth"), c, experiment.Config())


@query()
def d17_smoothed(spark, d):
    return experts.smoothed(_experts(spark, d), "pf")


@query()
def d16_expert_weights(spark, d):
    """Weights of the experts for each series, from the deviation of its visible part's second half about the mean of the first."""
    first = F.avg(F.when(F.col("rn") < F.col("cut") / 2, F.col("value"))).over(Window.partitionBy("user_id"))
    late = F.col("known") & (F.col("rn") >= F.col("cut") / 2)
    cv = series(spark, d).withColumn("first", first).groupBy("user_id").agg(F.sqrt(F.avg(F.when(late, F.pow(F.col("value") - F.col("first"), 2)))).alias("prefix_cv"))
    return experts.weights(cv, "prefix_cv", [(pair, simplex) for pair in (0.2, 0.95) for simplex in (False, True)])
