"""One query for each relational operator, over the driver's tables, with its SQL form for DuckDB.

``lineitem`` with ``supplier`` stands for a prediction panel (unit: supplier, group: nation), ``events`` for ordered series
(key: user), ``embeddings`` for fingerprints, ``part`` for a lookup curve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import expr as X
from cairn.operators import checks, joins, matching, metrics, neighbours, ordered
from cairn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ARMS = ["incumbent", "candidate", "blend"]
BOUNDS = [5.0, 10.0, 20.0, 30.0, 40.0]

PANEL = """panel AS (
    SELECT l_suppkey AS well, s_nationkey AS component, s_nationkey % 3 AS fold, l_quantity AS horizon, l_orderkey, l_linenumber, l_partkey,
           l_extendedprice AS truth, l_extendedprice * (1 - l_discount) AS incumbent, l_extendedprice * (1 + l_tax) AS candidate,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS blend
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
LONG = PANEL + """, se AS (
    SELECT well, component, fold, horizon, m.model, (truth - m.v) ** 2 AS se, (truth - incumbent) ** 2 AS be
    FROM panel, LATERAL (SELECT unnest(['incumbent', 'candidate', 'blend']) AS model, unnest([incumbent, candidate, blend]) AS v) m)"""
SERIES = """s0 AS (
    SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, value,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS gr, epoch_us(ts) / 3600000000.0 AS md, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT *, least(greatest(round_even(0.62 * n, 0), 30), n - 10)::INT AS cut FROM s0)"""
FILLED = SERIES + """, f0 AS (
    SELECT *, last_value(gr IGNORE NULLS) OVER w AS a, max(CASE WHEN gr IS NOT NULL THEN rn END) OVER w AS i,
           first_value(gr IGNORE NULLS) OVER v AS b, min(CASE WHEN gr IS NOT NULL THEN rn END) OVER v AS j
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, CASE WHEN gr IS NOT NULL THEN gr WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * (rn - i) / (j - i) END AS fill FROM f0)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def panel(spark: SparkSession, d: str) -> DataFrame:
    price, li = F.col("l_extendedprice"), table(spark, d, "lineitem")
    t = joins.many_to_one(li.withColumnRenamed("l_suppkey", "s_suppkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"]).where("s_nationkey is not null")
    return t.select(
        F.col("s_suppkey").alias("well"), F.col("s_nationkey").alias("component"), (F.col("s_nationkey") % 3).alias("fold"), F.col("l_quantity").alias("horizon"), "l_orderkey", "l_linenumber", "l_partkey",
        price.alias("truth"), (price * (1 - F.col("l_discount"))).alias("incumbent"), (price * (1 + F.col("l_tax"))).alias("candidate"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("blend"),
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    t = ordered.number_rows(e, "user_id", ["ts", "event_id"])
    hours = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")) / 3600000000.0
    return ordered.mask_prefix(t.withColumns({"gr": F.when(F.col("event_id") % 7 != 0, F.col("value")), "md": hours}), "user_id", 0.62)


def r(c, n: int = 4):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


def rounded(t: DataFrame, n: int = 4) -> DataFrame:
    return t.select(*(F.round(F.col(c), n).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


# --- scans, projections, predicates -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 2")
def s03_pruned_scan(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity <= 2")


@query("SELECT user_id, count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM events GROUP BY user_id")
def s09_metadata_scan(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), r(F.min("value")).alias("lo"), r(F.max("value")).alias("hi"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s11_paired_rows(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def p01_allow_list(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def p02_numeric_coercion(spark, d):
    return table(spark, d, "events").select("event_id", X.number(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), X.number(F.col("event_type")).alias("bad"))


@query(f"WITH {SERIES}, v AS (SELECT *, CASE WHEN rn < cut THEN value END AS vis FROM s) SELECT user_id, count(vis) AS known, count(*) - count(vis) AS hidden, coalesce(max(CASE WHEN vis IS NOT NULL THEN rn END) + 1 = count(vis), false) AS contiguous FROM v GROUP BY user_id")
def p03_prefix_split(spark, d):
    t = series(spark, d).withColumn("vis", F.when(F.col("known"), F.col("value")))
    return ordered.prefix_summary(t, "user_id", "vis")


@query(f"WITH {SERIES} SELECT DISTINCT user_id, cut FROM s")
def p04_prefix_mask(spark, d):
    return series(spark, d).select("user_id", "cut").distinct()


@query(f"WITH {SERIES} SELECT user_id, rn, round(md - max(CASE WHEN rn = cut - 1 THEN md END) OVER (PARTITION BY user_id), 4) AS horizon FROM s QUALIFY rn >= cut")
def p05_horizon(spark, d):
    return ordered.horizon(series(spark, d), "user_id", "md").where("not known").select("user_id", F.col("rn").cast("bigint").alias("rn"), r("horizon").alias("horizon"))


@query(f"WITH {SERIES} SELECT event_id, user_id::VARCHAR || '_' || rn::VARCHAR AS row_id FROM s")
def p06_row_id(spark, d):
    return series(spark, d).select("event_id", F.concat_ws("_", "user_id", "rn").alias("row_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p07_membership(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT bin, bin_order, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 5 THEN '0-5' WHEN l_quantity <= 10 THEN '>5-10' WHEN l_quantity <= 20 THEN '>10-20' WHEN l_quantity <= 30 THEN '>20-30' WHEN l_quantity <= 40 THEN '>30-40' ELSE '>40' END AS bin,
    CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2 WHEN l_quantity <= 30 THEN 3 WHEN l_quantity <= 40 THEN 4 ELSE 5 END AS bin_order FROM lineitem) GROUP BY ALL""")
def p08_horizon_bins(spark, d):
    label, order = X.interval_label(F.col("l_quantity"), BOUNDS)
    return table(spark, d, "lineitem").groupBy(label.alias("bin"), order.alias("bin_order")).agg(F.count("*").alias("n"))


COS = "list_dot_product(a.e, b.e)"
EDGES = """e AS (SELECT vec_id, embedding::DOUBLE[] AS e, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, list_dot_product(a.e, b.e) AS corr FROM e a JOIN e b ON a.vec_id < b.vec_id),
    edges AS (SELECT a, b, dist, corr, CASE WHEN dist <= 0.002 AND dist <= 0.2 AND corr >= 0.4 THEN 'spatial+similar' WHEN dist <= 0.002 THEN 'spatial' WHEN dist <= 0.2 AND corr >= 0.4 THEN 'similar' ELSE 'none' END AS reason FROM p),
    kept AS (SELECT * FROM edges WHERE reason <> 'none')"""


def edges(spark, d, near=0.002, far=0.2, threshold=0.4, forests=False):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return joins.similarity_edges(e, "vec_id", "x", "y", "embedding", "embedding", near, far, threshold, 64, forests)


@query(f"WITH {EDGES} SELECT reason, count(*) AS n FROM kept GROUP BY reason")
def p09_edge_reason(spark, d):
    return edges(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


CHECKS = """SELECT 'lineitem' AS contract, 'supplier_known' AS check_name, count(*) = 0 AS passed, count(*) AS violations FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'lineitem', 'row_key_unique', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    UNION ALL SELECT 'orders', 'key_unique', count(*) = count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'events', 'value_finite', count(*) = 0, count(*) FROM events WHERE value IS NULL OR NOT isfinite(value)
    UNION ALL SELECT 'supplier', 'one_nation', count(*) = 0, count(*) FROM (SELECT s_suppkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1)
    UNION ALL SELECT 'events', 'time_increasing', count(*) = 0, count(*) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) WHERE d <= 0
    UNION ALL SELECT 'labels', 'disjoint_from_rest', count(*) = 0, count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


def check_log(spark, d):
    li, ev = table(spark, d, "lineitem"), table(spark, d, "events")
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    t = ev.withColumn("us", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")))
    return checks.log(
        checks.no_orphans(li, table(spark, d, "supplier"), "lineitem", "supplier_known", "l_suppkey", "s_suppkey"),
        checks.unique(li, "lineitem", "row_key_unique", ["l_orderkey", "l_linenumber"]),
        checks.unique(table(spark, d, "orders"), "orders", "key_unique", ["o_orderkey"]),
        checks.check(ev, "events", "value_finite", F.count_if(~X.finite(F.col("value")))),
        checks.one_value(table(spark, d, "supplier"), "supplier", "one_nation", "s_suppkey", "s_nationkey"),
        checks.increasing(t, "events", "time_increasing", "user_id", "event_id", "us"),
        checks.disjoint(lab, docs.join(lab, "doc_id", "left_anti"), "labels", "disjoint_from_rest", ["doc_id"]),
    )


QUERIES["p11_check_log"], SQL["p11_check_log"] = check_log, CHECKS


@query(f"WITH {SERIES}, k AS (SELECT user_id, n, cut, n >= 40 AS long_enough, cut >= 30 AND n - cut >= 10 AS split_ok FROM s WHERE rn = 0) SELECT count(*) AS wells, count(*) FILTER (NOT long_enough) AS short, count(*) FILTER (NOT split_ok) AS badly_split FROM k")
def p10_record_rules(spark, d):
    t = series(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("cut").alias("cut"))
    return t.agg(F.count("*").alias("wells"), F.count_if(F.col("n") < 40).alias("short"), F.count_if((F.col("cut") < 30) | (F.col("n") - F.col("cut") < 10)).alias("badly_split"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 4) AS series_mean FROM events")
def p15_broadcast_column(spark, d):
    return table(spark, d, "events").select("event_id", r(F.avg("value").over(Window.partitionBy("user_id"))).alias("series_mean"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS v FROM events")
def p16_finite_fill(spark, d):
    bad = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", X.or_zero(bad).alias("v"))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j01_many_to_one(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.many_to_one(table(spark, d, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j02_map_lookup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query(f"WITH {PANEL}, c AS (SELECT fold, sqrt(avg((truth - incumbent) ** 2)) AS v FROM panel GROUP BY fold) SELECT count(*) AS matched, 0::BIGINT AS only_stored, 0::BIGINT AS only_computed, 0::BIGINT AS differ, true AS agree FROM c")
def j03_reconcile(spark, d):
    p = panel(spark, d)
    stored = metrics.cells(p, ["fold"], ["incumbent"]).select("fold", F.sqrt(F.col("incumbent") / F.col("n")).alias("v"))
    return joins.reconcile(stored, p.groupBy("fold").agg(metrics.rmse("truth", "incumbent").alias("v")), ["fold"], "v", 1e-6)


@query(f"WITH {EDGES} SELECT a, b, round(dist, 6) AS dist, round(corr, 6) AS corr, reason FROM kept")
def j04_radius_join(spark, d):
    return edges(spark, d).select("a", "b", r("dist", 6).alias("dist"), r("corr", 6).alias("corr"), "reason")


CURVE = "k AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY p_size), g AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, row_number() OVER (ORDER BY x) AS i FROM k)"


def curve(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))


@query(f"WITH {CURVE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(CASE WHEN x1 IS NULL OR l_quantity - 0.3::DOUBLE <= x0 THEN y0 ELSE y0 + (y1 - y0) * (l_quantity - 0.3::DOUBLE - x0) / (x1 - x0) END, 4) AS value FROM lineitem JOIN g ON (i = 1 OR l_quantity - 0.3::DOUBLE >= x0) AND (x1 IS NULL OR l_quantity - 0.3::DOUBLE < x1)")
def j05_interpolate(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") - 0.3).alias("at"))
    return rounded(joins.interpolate(q, curve(spark, d), [], "at", "x", "y").drop("at"))


@query(f"WITH {CURVE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN x1 IS NULL OR l_quantity - 0.3::DOUBLE <= x0 OR l_quantity - 0.3::DOUBLE - x0 <= x1 - (l_quantity - 0.3::DOUBLE) THEN x0 ELSE x1 END AS nearest FROM lineitem JOIN g ON (i = 1 OR l_quantity - 0.3::DOUBLE >= x0) AND (x1 IS NULL OR l_quantity - 0.3::DOUBLE < x1)")
def j06_nearest(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") - 0.3).alias("at"))
    return joins.nearest(q, curve(spark, d), "at", "x").drop("at")


@query("SELECT e.event_id, (SELECT arg_max(p.value, p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type <> 'purchase'")
def j05b_as_of(spark, d):
    e = table(spark, d, "events")
    q = e.where("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    return joins.as_of(q, e.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("SELECT b.item_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS found FROM benchmark b LEFT JOIN labels l ON b.item_id = l.doc_id")
def j07_coverage(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return joins.coverage(table(spark, d, "benchmark").select("item_id"), lab, "item_id", "item_id").select("item_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "found")


@query("SELECT doc_id FROM documents WHERE source = 'src0' INTERSECT SELECT doc_id FROM labels")
def j08_shared_keys(spark, d):
    return joins.shared_keys(table(spark, d, "documents").where("source = 'src0'"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j09_complement(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(f"WITH {SERIES} SELECT a.user_id, a.rn, round(a.value + b.value, 4) AS total FROM s a JOIN s b ON a.user_id = b.user_id AND a.rn = b.rn")
def j10_align(spark, d):
    s = series(spark, d)
    b = s.select("user_id", "rn", F.col("value").alias("other"))
    return s.join(b, ["user_id", "rn"]).select("user_id", F.col("rn").cast("bigint").alias("rn"), r(F.col("value") + F.col("other")).alias("total"))


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def j13_subset(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return wanted.join(table(spark, d, "part").where("p_size < 40"), "p_partkey", "left_anti").agg(F.count("*").alias("missing"))


# --- aggregates ----------------------------------------------------------------------------------------------------------


@query(f"WITH {LONG} SELECT model, round(sqrt(avg(se)), 4) AS rmse FROM se GROUP BY model")
def a01_rmse(spark, d):
    return rounded(metrics.long(metrics.group_rmse_wide(panel(spark, d), [], ARMS), [], ARMS, "rmse"))


@query(f"WITH {PANEL} SELECT well, round(sqrt(avg((truth - incumbent) ** 2)), 4) AS incumbent, round(sqrt(avg((truth - candidate) ** 2)), 4) AS candidate, round(sqrt(avg((truth - blend) ** 2)), 4) AS blend FROM panel GROUP BY well")
def a02_group_rmse(spark, d):
    return rounded(metrics.group_rmse_wide(panel(spark, d), ["well"], ARMS))


@query(f"WITH {LONG} SELECT component, count(*) AS rows, count(DISTINCT well) AS wells, round(sqrt(avg(be)), 4) AS baseline_rmse, model, round(sqrt(avg(se)), 4) AS rmse, round(sqrt(avg(be)) - sqrt(avg(se)), 4) AS gain FROM se GROUP BY component, model")
def a03_group_metrics(spark, d):
    return rounded(metrics.group_metrics(panel(spark, d), "component", ARMS, "incumbent", [F.count_distinct("well").alias("wells")]))


BOARD = LONG + """, u AS (SELECT well, model, sqrt(avg(se)) AS rmse, sqrt(avg(be)) - sqrt(avg(se)) AS gain FROM se GROUP BY well, model),
    g AS (SELECT component, model, sqrt(avg(se)) AS rmse, sqrt(avg(be)) - sqrt(avg(se)) AS gain FROM se GROUP BY component, model),
    tail AS (SELECT model, avg(rmse) AS tail_rmse FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse DESC) AS r, count(*) OVER (PARTITION BY model) AS n FROM g) WHERE r <= greatest(1, ceil(0.1 * n)) GROUP BY model),
    m AS (SELECT model, count(*) AS rows, sqrt(avg(se)) AS pooled_rmse, sqrt(avg(be)) - sqrt(avg(se)) AS pooled_gain FROM se GROUP BY model),
    bu AS (SELECT model, count(*) AS wells, avg(rmse) AS macro_well_rmse, avg((gain < -1e-12)::INT) AS harmed_well_rate, avg(gain) AS mean_well_gain, median(gain) AS median_well_gain FROM u GROUP BY model),
    bg AS (SELECT model, count(*) AS components, avg(rmse) AS macro_component_rmse, avg((gain < -1e-12)::INT) AS harmed_component_rate, max(rmse) AS worst_component_rmse FROM g GROUP BY model),
    board AS (SELECT * FROM m JOIN bu USING (model) JOIN bg USING (model) JOIN tail USING (model))"""


@query(f"""WITH {BOARD} SELECT model, rows, round(pooled_rmse, 4) AS pooled_rmse, round(pooled_gain, 4) AS pooled_gain, wells, round(macro_well_rmse, 4) AS macro_well_rmse, round(harmed_well_rate, 4) AS harmed_well_rate, round(mean_well_gain, 4) AS mean_well_gain,
    round(median_well_gain, 4) AS median_well_gain, components, round(macro_component_rmse, 4) AS macro_component_rmse, round(harmed_component_rate, 4) AS harmed_component_rate, round(worst_component_rmse, 4) AS worst_component_rmse, round(tail_rmse, 4) AS tail_rmse,
    rank() OVER (ORDER BY pooled_rmse)::DOUBLE AS rank_pooled_rmse, rank() OVER (ORDER BY macro_well_rmse)::DOUBLE AS rank_macro_well_rmse, rank() OVER (ORDER BY macro_component_rmse)::DOUBLE AS rank_macro_component_rmse, rank() OVER (ORDER BY tail_rmse)::DOUBLE AS rank_tail_rmse,
    greatest(1, ceil(0.1 * components))::BIGINT AS tail_components FROM board""")
def a04_model_metrics(spark, d):
    return rounded(metrics.model_metrics(panel(spark, d), ARMS, "incumbent"))


@query(f"WITH {LONG}, g AS (SELECT component, model, sqrt(avg(se)) AS rmse FROM se GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse DESC) AS r, count(*) OVER (PARTITION BY model) AS n FROM g) SELECT model, round(avg(rmse), 4) AS tail FROM k WHERE r <= greatest(1, ceil(0.2 * n)) GROUP BY model")
def a05_tail_mean(spark, d):
    g = metrics.long(metrics.group_rmse_wide(panel(spark, d), ["component"], ARMS), ["component"], ARMS, "rmse")
    return rounded(metrics.tail_mean(g, ["model"], "rmse", 0.2, "tail"))


@query(f"WITH {LONG}, g AS (SELECT component, model, avg(se) AS mse FROM se GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mse DESC) AS r, count(*) OVER (PARTITION BY model) AS n FROM g) SELECT model, round(sqrt(avg(mse)), 4) AS tail FROM k WHERE r <= greatest(1, ceil(0.2 * n)) GROUP BY model")
def a05b_tail_mean_squares(spark, d):
    p = panel(spark, d).groupBy("component").agg(*(F.avg(metrics.squared("truth", a)).alias(a) for a in ARMS))
    return rounded(metrics.tail_mean(metrics.long(p, ["component"], ARMS, "mse"), ["model"], "mse", 0.2, "tail", of_squares=True))


@query(f"""WITH {LONG}, b AS (SELECT *, CASE WHEN horizon <= 5 THEN '0-5' WHEN horizon <= 10 THEN '>5-10' WHEN horizon <= 20 THEN '>10-20' WHEN horizon <= 30 THEN '>20-30' WHEN horizon <= 40 THEN '>30-40' ELSE '>40' END AS bin,
      CASE WHEN horizon <= 5 THEN 0 WHEN horizon <= 10 THEN 1 WHEN horizon <= 20 THEN 2 WHEN horizon <= 30 THEN 3 WHEN horizon <= 40 THEN 4 ELSE 5 END AS bin_order FROM se),
    u AS (SELECT bin, model, well, sqrt(avg(se)) AS rmse, sqrt(avg(be)) AS base FROM b GROUP BY ALL), mu AS (SELECT bin, model, count(*) AS wells, avg(rmse) AS macro_well_rmse, avg((rmse > base + 1e-12)::INT) AS harmed_well_rate FROM u GROUP BY ALL)
    SELECT bin, bin_order, model, count(*) AS rows, any_value(wells) AS wells, count(DISTINCT component) AS components, round(sqrt(avg(se)), 4) AS pooled_rmse, round(any_value(macro_well_rmse), 4) AS macro_well_rmse, round(any_value(harmed_well_rate), 4) AS harmed_well_rate, round(sqrt(avg(be)) - sqrt(avg(se)), 4) AS gain
    FROM b JOIN mu USING (bin, model) GROUP BY bin, bin_order, model""")
def a06_horizon_metrics(spark, d):
    return rounded(metrics.horizon_metrics(panel(spark, d), ARMS, "incumbent", BOUNDS))


FOLD = LONG + ", fm AS (SELECT fold, count(*) AS rows, count(DISTINCT well) AS wells, count(DISTINCT component) AS components, model, sqrt(avg(se)) AS rmse, sqrt(avg(be)) - sqrt(avg(se)) AS gain FROM se GROUP BY fold, model), fr AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY rmse) + (count(*) OVER (PARTITION BY fold, rmse) - 1) / 2.0 AS rank, abs(rmse - min(rmse) OVER (PARTITION BY fold)) <= 1e-12 AS is_best, abs(rmse - max(rmse) OVER (PARTITION BY fold)) <= 1e-12 AS is_worst FROM fm)"


@query(f"WITH {FOLD} SELECT fold, rows, wells, components, model, round(rmse, 4) AS rmse, rank::DOUBLE AS rank, is_best, is_worst, round(gain, 4) AS gain FROM fr")
def a07_fold_metrics(spark, d):
    return rounded(metrics.fold_metrics(panel(spark, d), ARMS, "incumbent"))


@query(f"WITH {FOLD} SELECT model, count(rank) AS units, round(avg(rank), 4) AS mean_rank, round(stddev_pop(rank), 4) AS rank_std, round(avg(is_best::INT), 4) AS best_rate, round(avg((gain > 1e-12)::INT), 4) AS beats_rate, round(avg(gain), 4) AS mean_gain, round(min(gain), 4) AS worst_gain FROM fr GROUP BY model")
def a08_rank_summary(spark, d):
    return rounded(metrics.rank_summary(metrics.fold_metrics(panel(spark, d), ARMS, "incumbent")))


@query(f"WITH {LONG}, c AS (SELECT fold AS contract, component, model, sqrt(avg(se)) AS rmse FROM se GROUP BY ALL), m AS (SELECT contract, model, avg(rmse) AS macro FROM c GROUP BY ALL) SELECT contract, model, round(macro, 4) AS macro, rank() OVER (PARTITION BY contract ORDER BY macro)::DOUBLE AS rank, macro = min(macro) OVER (PARTITION BY contract) AS is_best, round(max(CASE WHEN model = 'incumbent' THEN macro END) OVER (PARTITION BY contract) - macro, 4) AS gain FROM m")
def a09_contract_ranks(spark, d):
    c = metrics.group_rmse_wide(panel(spark, d).withColumnRenamed("fold", "contract"), ["contract", "component"], ARMS)
    m = metrics.long(c, ["contract", "component"], ARMS, "rmse").groupBy("contract", "model").agg(F.avg("rmse").alias("macro"))
    return rounded(metrics.rank_units(m, ["contract"], "incumbent", "macro").select("contract", "model", "macro", "rank", "is_best", "gain"))


@query(f"WITH {LONG}, u AS (SELECT well, model, sqrt(avg(se)) AS rmse FROM se GROUP BY ALL) SELECT well, model, round(rmse, 4) AS rmse FROM u QUALIFY row_number() OVER (PARTITION BY well ORDER BY rmse, model) = 1")
def a10_best_model(spark, d):
    u = metrics.long(metrics.group_rmse_wide(panel(spark, d), ["well"], ARMS), ["well"], ARMS, "rmse")
    return rounded(metrics.best_row(u, ["well"], [F.col("rmse"), F.col("model")]))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def a11_distinct_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated, count(*) - count(DISTINCT l_orderkey) AS beyond_first FROM lineitem")
def a12_duplicates(spark, d):
    return table(spark, d, "lineitem").agg((F.count("*") - F.count_distinct(F.struct("l_orderkey", "l_linenumber"))).alias("repeated"), (F.count("*") - F.count_distinct("l_orderkey")).alias("beyond_first"))


@query(f"WITH {SERIES} SELECT user_id, count(*) AS rows, round(median(md), 4) AS x, round(median(value), 4) AS y, count(gr) AS finite FROM s GROUP BY user_id")
def a13_metadata_record(spark, d):
    return rounded(series(spark, d).groupBy("user_id").agg(F.count("*").alias("rows"), F.median("md").alias("x"), F.median("value").alias("y"), F.count("gr").alias("finite")))


@query(f"WITH {PANEL} SELECT component, count(*) AS rows, round(sum(truth), 2) AS total FROM panel GROUP BY component")
def a14_sum_by_component(spark, d):
    return rounded(panel(spark, d).groupBy("component").agg(F.count("*").alias("rows"), F.sum("truth").alias("total")).orderBy(F.col("rows").desc(), "component"), 2)


@query(f"WITH {PANEL}, c AS (SELECT component, count(*) AS n FROM panel GROUP BY 1) SELECT component, round(1.0 / ((SELECT count(*) FROM c) * n), 10) AS weight, n FROM c")
def a15_row_weights(spark, d):
    t = metrics.row_weights(panel(spark, d).select("component", "truth"))
    return t.groupBy("component").agg(F.round(F.max("weight"), 10).alias("weight"), F.count("*").alias("n"))


@query("WITH c AS (SELECT s_nationkey AS component, count(*) AS n FROM supplier GROUP BY 1) SELECT s_suppkey, round((SELECT sum(n) FROM c)::DOUBLE / (n * (SELECT count(*) FROM c)), 8) AS weight FROM supplier JOIN c ON s_nationkey = component")
def a15b_unit_weights(spark, d):
    t = metrics.unit_weights(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "component"))
    return t.select("s_suppkey", r("weight", 8).alias("weight"))


MOVES = "m0 AS (SELECT component, candidate - incumbent AS a, blend - incumbent AS b, truth - incumbent AS t FROM panel)"


@query(f"WITH {PANEL}, {MOVES}, c AS (SELECT component, count(*) AS n FROM m0 GROUP BY 1), w AS (SELECT m0.*, 1.0 / ((SELECT count(*) FROM c) * n) AS q FROM m0 JOIN c USING (component)) SELECT round(sum(q*a*a), 2) AS g_0_0, round(sum(q*a*b), 2) AS g_0_1, round(sum(q*b*b), 2) AS g_1_1, round(sum(q*a*t), 2) AS c_0, round(sum(q*b*t), 2) AS c_1, round(sum(q*t*t), 2) AS rr, count(*) AS n FROM w")
def a16_weighted_gram(spark, d):
    return rounded(metrics.moments(metrics.row_weights(panel(spark, d)), ["candidate", "blend"], "incumbent", weight="weight"), 2)


@query(f"WITH {PANEL}, {MOVES} SELECT component, round(avg(a*a), 2) AS g_0_0, round(avg(a*b), 2) AS g_0_1, round(avg(b*b), 2) AS g_1_1, round(avg(a*t), 2) AS c_0, round(avg(b*t), 2) AS c_1, round(avg(t*t), 2) AS rr, count(*) AS n FROM m0 GROUP BY component")
def a17_component_quadratics(spark, d):
    return rounded(metrics.moments(panel(spark, d), ["candidate", "blend"], "incumbent", ["component"]), 2)


IDX = "('0x' || substr(md5({}), 1, 8))::UBIGINT % {}"
STATS = "st AS (SELECT row_number() OVER (ORDER BY {g}) - 1 AS pos, count(*) AS n, sum((truth - incumbent) ** 2) AS ref, sum((truth - candidate) ** 2) AS cand FROM panel GROUP BY {g}), dr AS (SELECT draw, ('0x' || substr(md5(draw || ':' || slot), 1, 8))::UBIGINT % (SELECT count(*) FROM st) AS pos FROM range({n}) t(draw), (SELECT unnest(range((SELECT count(*) FROM st))) AS slot)), gn AS (SELECT draw, sqrt(sum(ref) / sum(n)) - sqrt(sum(cand) / sum(n)) AS gain FROM dr JOIN st USING (pos) GROUP BY draw)"
CI = "SELECT count(*) AS draws, round(avg(gain), 4) AS gain_mean, round(quantile_cont(gain, 0.025), 4) AS ci95_low, round(quantile_cont(gain, 0.975), 4) AS ci95_high, round(avg((gain > 0)::INT), 4) AS probability_positive FROM gn"


@query(f"WITH {PANEL}, {STATS.format(g='component', n=300)} {CI}")
def a18_component_bootstrap(spark, d):
    return rounded(metrics.bootstrap(panel(spark, d), "component", "incumbent", "candidate", 300))


@query(f"""WITH {LONG}, g AS (SELECT component, model, sqrt(avg(se)) AS rmse FROM se GROUP BY ALL), st AS (SELECT dense_rank() OVER (ORDER BY component) - 1 AS pos, model, rmse FROM g), k AS (SELECT count(DISTINCT pos) AS n FROM st),
    dr AS (SELECT draw, ('0x' || substr(md5(draw || ':' || slot), 1, 8))::UBIGINT % (SELECT n FROM k) AS pos FROM range(100) t(draw), (SELECT unnest(range((SELECT n FROM k))) AS slot)), sc AS (SELECT draw, model, avg(rmse) AS rmse FROM dr JOIN st USING (pos) GROUP BY ALL),
    rk AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY rmse) + (count(*) OVER (PARTITION BY draw, rmse) - 1) / 2.0 AS rank, rmse - min(rmse) OVER (PARTITION BY draw) <= 1e-12 AS is_best, max(CASE WHEN model = 'incumbent' THEN rmse END) OVER (PARTITION BY draw) - rmse AS gain FROM sc)
    SELECT model, count(rank) AS units, round(avg(rank), 4) AS mean_rank, round(stddev_pop(rank), 4) AS rank_std, round(avg(is_best::INT), 4) AS best_rate, round(avg((gain > 1e-12)::INT), 4) AS beats_rate, round(avg(gain), 4) AS mean_gain, round(min(gain), 4) AS worst_gain FROM rk GROUP BY model""")
def a19_bootstrap_ranks(spark, d):
    g = metrics.group_rmse_wide(panel(spark, d), ["component"], ARMS)
    return rounded(metrics.rank_summary(metrics.bootstrap_ranks(g, ARMS, "incumbent", 100)))


CROSS = PANEL + """, st AS (SELECT dense_rank() OVER (ORDER BY fold3) - 1 AS i, dense_rank() OVER (ORDER BY component) - 1 AS j, count(*) AS n, sum((truth - incumbent) ** 2) AS ref, sum((truth - candidate) ** 2) AS cand FROM (SELECT *, l_partkey % 3 AS fold3 FROM panel) GROUP BY fold3, component),
    ci AS (SELECT draw, ('0x' || substr(md5('s' || draw || ':' || slot), 1, 8))::UBIGINT % (SELECT max(i) + 1 FROM st) AS i FROM range(100) t(draw), (SELECT unnest(range((SELECT max(i) + 1 FROM st))) AS slot)),
    cj AS (SELECT draw, ('0x' || substr(md5('c' || draw || ':' || slot), 1, 8))::UBIGINT % (SELECT max(j) + 1 FROM st) AS j FROM range(100) t(draw), (SELECT unnest(range((SELECT max(j) + 1 FROM st))) AS slot)),
    gn AS (SELECT draw, sqrt(sum(ref) / sum(n)) - sqrt(sum(cand) / sum(n)) AS gain FROM ci JOIN cj USING (draw) JOIN st USING (i, j) GROUP BY draw)"""


@query(f"WITH {CROSS} {CI}")
def a20_crossed_bootstrap(spark, d):
    t = panel(spark, d).withColumn("seed", F.col("l_partkey") % 3).groupBy("seed", "component").agg(F.count("*").alias("n"), F.sum(metrics.squared("truth", "incumbent")).alias("ref"), F.sum(metrics.squared("truth", "candidate")).alias("cand"))
    return rounded(metrics.interval(metrics.crossed_bootstrap(t, 100)))


@query(f"WITH {PANEL}, {STATS.format(g='well', n=100)} {CI}")
def a21_unit_bootstrap(spark, d):
    return rounded(metrics.bootstrap(panel(spark, d), "well", "incumbent", "candidate", 100))


@query(f"WITH {PANEL} SELECT component, round(quantile_cont(abs(candidate - incumbent), 0.95), 4) AS p95, round(quantile_cont(truth, 0.5), 4) AS p50 FROM panel GROUP BY component")
def a22_quantile(spark, d):
    return rounded(panel(spark, d).groupBy("component").agg(F.percentile(F.abs(F.col("candidate") - F.col("incumbent")), 0.95).alias("p95"), F.percentile("truth", 0.5).alias("p50")))


@query("WITH c AS (SELECT s_nationkey, s_acctbal, s_suppkey, sum(s_suppkey + 1) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING) / sum(s_suppkey + 1) OVER (PARTITION BY s_nationkey) AS cdf FROM supplier) SELECT s_nationkey, coalesce(min(CASE WHEN cdf >= 0.6 THEN s_acctbal END), max(s_acctbal)) AS quantile FROM c GROUP BY s_nationkey")
def a23_weighted_quantile(spark, d):
    return metrics.weighted_quantile(table(spark, d, "supplier").withColumn("w", F.col("s_suppkey") + 1), ["s_nationkey"], "s_acctbal", "w", 0.6, ["s_suppkey"])


REFIT = PANEL + """, w AS (SELECT well, avg((truth - incumbent) ** 2) AS p, avg((truth - candidate) ** 2) AS c FROM panel GROUP BY 1), g AS (SELECT component, avg((truth - incumbent) ** 2) AS p, avg((truth - candidate) ** 2) AS c FROM panel GROUP BY 1),
    k AS (SELECT greatest(1, ceil(0.1 * count(*))) AS n FROM g), one AS (SELECT (SELECT count(*) FROM panel) AS rows, (SELECT sqrt(avg((truth - incumbent) ** 2)) FROM panel) AS parent_rmse, (SELECT sqrt(avg((truth - candidate) ** 2)) FROM panel) AS candidate_rmse,
      (SELECT count(*) FROM w) AS wells, (SELECT avg(sqrt(p)) FROM w) AS parent_macro_well, (SELECT avg(sqrt(c)) FROM w) AS candidate_macro_well, (SELECT avg((sqrt(c) - sqrt(p) > 0)::INT) FROM w) AS harmed_well_rate, (SELECT max(sqrt(c) - sqrt(p)) FROM w) AS max_regret,
      (SELECT count(*) FROM g) AS components, (SELECT avg(sqrt(p)) FROM g) AS parent_macro_component, (SELECT avg(sqrt(c)) FROM g) AS candidate_macro_component,
      (SELECT sqrt(avg(p)) FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS r FROM g) WHERE r <= (SELECT n FROM k)) AS parent_tail, (SELECT sqrt(avg(c)) FROM (SELECT c, row_number() OVER (ORDER BY c DESC) AS r FROM g) WHERE r <= (SELECT n FROM k)) AS candidate_tail),
    rm AS (SELECT *, parent_rmse - candidate_rmse AS row_gain, parent_macro_component - candidate_macro_component AS macro_gain, parent_tail - candidate_tail AS tail_gain FROM one)"""
_RM = ["parent_rmse", "candidate_rmse", "parent_macro_well", "candidate_macro_well", "harmed_well_rate", "max_regret", "parent_macro_component", "candidate_macro_component", "parent_tail", "candidate_tail", "row_gain", "macro_gain", "tail_gain"]


@query(f"WITH {REFIT} SELECT rows, wells, components, {', '.join(f'round({c}, 4) AS {c}' for c in _RM)} FROM rm")
def a24_refit_metrics(spark, d):
    return rounded(metrics.refit_metrics(panel(spark, d), "incumbent", "candidate"))


@query(f"WITH {REFIT} SELECT count(*) AS contracts, bool_and(row_gain > 0 AND macro_gain > 0 AND tail_gain >= 0 AND harmed_well_rate <= 0.5) AS passed, CASE WHEN bool_and(row_gain > 0 AND macro_gain > 0 AND tail_gain >= 0 AND harmed_well_rate <= 0.5) THEN 'PROMOTE' ELSE 'HOLD' END AS decision FROM rm")
def a25_promotion_gate(spark, d):
    return metrics.promotion(metrics.refit_metrics(panel(spark, d), "incumbent", "candidate"))


UNIT = PANEL + """, q AS (SELECT *, candidate - incumbent AS m1, blend - incumbent AS m2, row_number() OVER w AS k, candidate - incumbent - lag(candidate - incumbent) OVER w AS d1, blend - incumbent - lag(blend - incumbent) OVER w AS d2 FROM panel WINDOW w AS (PARTITION BY well ORDER BY l_orderkey, l_linenumber, l_partkey, truth, incumbent, candidate))"""
_rms = lambda c: f"sqrt(avg(({c}) ** 2))"


@query(f"""WITH {UNIT} SELECT well, min(component) AS component, count(*) AS rows, max(horizon) AS horizon_max, round(avg(horizon), 4) AS horizon_mean,
    round({_rms('m1')}, 4) AS candidate_move_rms, round(max(abs(m1)), 4) AS candidate_move_absmax, round({_rms('candidate - incumbent')}, 4) AS candidate_local_rms, round(coalesce({_rms('d1')}, 0), 4) AS candidate_roughness, round(avg((truth - incumbent) ** 2) - avg((truth - candidate) ** 2), 2) AS gain_candidate,
    round({_rms('m2')}, 4) AS blend_move_rms, round(max(abs(m2)), 4) AS blend_move_absmax, round({_rms('blend - candidate')}, 4) AS blend_local_rms, round(coalesce({_rms('d2')}, 0), 4) AS blend_roughness, round(avg((truth - incumbent) ** 2) - avg((truth - blend) ** 2), 2) AS gain_blend, round(avg((truth - incumbent) ** 2), 2) AS fallback_mse FROM q GROUP BY well""")
def a26_unit_features(spark, d):
    t = metrics.unit_features(panel(spark, d), ["candidate", "blend"], "incumbent", ["l_orderkey", "l_linenumber", "l_partkey", "truth", "incumbent", "candidate"])
    return t.select(*(F.round(c, 2 if c.startswith("gain") or c == "fallback_mse" else 4).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


@query(f"WITH {REFIT} SELECT round(0.5 * candidate_rmse / parent_rmse + 0.25 * candidate_macro_component / parent_macro_component + 0.25 * candidate_tail / parent_tail, 6) AS score_a, round(0.6 * candidate_rmse / parent_rmse + 0.2 * candidate_macro_component / parent_macro_component + 0.2 * candidate_tail / parent_tail, 6) AS score_b FROM rm")
def a27_selection_scores(spark, d):
    t = metrics.refit_metrics(panel(spark, d), "incumbent", "candidate")
    score = lambda a, b, c: r(a * F.col("candidate_rmse") / F.col("parent_rmse") + b * F.col("candidate_macro_component") / F.col("parent_macro_component") + c * F.col("candidate_tail") / F.col("parent_tail"), 6)
    return t.select(score(0.5, 0.25, 0.25).alias("score_a"), score(0.6, 0.2, 0.2).alias("score_b"))


@query(f"WITH {PANEL}, z AS (SELECT w.w, sqrt(avg((truth - incumbent - w.w * (candidate - incumbent)) ** 2)) AS rmse FROM panel, (SELECT unnest([0.0, 0.05, 0.1, 0.25, 0.5]) AS w) w GROUP BY w.w) SELECT w::DOUBLE AS w, round(rmse, 4) AS rmse FROM z")
def a28_fixed_weight_audit(spark, d):
    q = metrics.moments(panel(spark, d), ["candidate"], "incumbent")
    w = F.explode(F.array(*map(F.lit, [0.0, 0.05, 0.1, 0.25, 0.5]))).alias("w")
    return q.select("rr", "c_0", "g_0_0", w).select("w", r(F.sqrt(F.col("rr") - 2 * F.col("w") * F.col("c_0") + F.col("w") * F.col("w") * F.col("g_0_0"))).alias("rmse"))


@query(f"""WITH {SERIES}, t AS (SELECT *, (value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0) AS st, md - last_value(md) OVER v AS dx, value - last_value(value) OVER v AS dy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn), v AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT user_id, round(CASE WHEN count(st) >= 3 THEN median(st) ELSE 0 END, 4) AS median_step, round((arg_max(value, rn) - arg_min(value, rn)) / nullif(arg_max(md, rn) - arg_min(md, rn), 0), 6) AS endpoint, round(regr_slope(value, md), 6) AS least_squares, round(sum(dx * dy) / nullif(sum(dx * dx), 0), 6) AS anchored FROM t GROUP BY user_id""")
def a29_slopes(spark, d):
    t = ordered.slopes(series(spark, d), "user_id", "md", "value")
    return t.select("user_id", r("median_step").alias("median_step"), *(r(c, 6).alias(c) for c in ("endpoint", "least_squares", "anchored")))


@query("""WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, median(l_extendedprice - l_quantity) AS off FROM lineitem GROUP BY 1), g AS (SELECT *, least(greatest(coalesce(slope, 1), 0.25), 4) AS a FROM f)
    SELECT l_suppkey, round(any_value(slope), 4) AS slope, round(any_value(intercept), 2) AS intercept, round(any_value(off), 4) AS "offset", round(any_value(a), 4) AS a, round(median(l_extendedprice - a * l_quantity), 4) AS b FROM lineitem JOIN g USING (l_suppkey) GROUP BY l_suppkey""")
def a30_calibration(spark, d):
    t = ordered.calibration(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey", "l_quantity", "l_extendedprice")
    return t.select("l_suppkey", *(r(c, 2 if c == "intercept" else 4).alias(c) for c in ("slope", "intercept", "offset", "a", "b")))


@query("WITH m AS (SELECT user_id, abs(value - median(value) OVER (PARTITION BY user_id)) AS dev FROM events) SELECT user_id, round(least(greatest(median(dev) * 1.4826, 1), 60), 8) AS scale FROM m GROUP BY user_id")
def a31_robust_scale(spark, d):
    return rounded(ordered.robust_scale(table(spark, d, "events").select("user_id", "value"), "user_id", "value", 1.0, 60.0), 8)


@query(f"""WITH {SERIES}, c AS (SELECT user_id, rn, value - avg(value) OVER (PARTITION BY user_id) AS c FROM s), v AS (SELECT user_id, sum(c * c) AS var FROM c GROUP BY 1),
    r AS (SELECT a.user_id, a.rn - b.rn AS lag, sum(a.c * b.c) / any_value(var) AS r FROM c a JOIN c b ON a.user_id = b.user_id AND a.rn - b.rn BETWEEN 1 AND 60 JOIN v ON v.user_id = a.user_id GROUP BY 1, 2), q AS (SELECT *, max((r <= 0.05)::INT) OVER (PARTITION BY user_id ORDER BY lag) AS stop FROM r)
    SELECT user_id, round(least(greatest(1 + coalesce(sum(CASE WHEN stop = 0 THEN r END), 0), 1), 60), 4) AS length FROM q GROUP BY user_id""")
def a32_correlation_length(spark, d):
    return rounded(ordered.correlation_length(series(spark, d).select("user_id", "rn", "value"), "user_id", "value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a33_frequency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, h AS (SELECT a % 2 = b % 2 AS same, dist, corr FROM kept) SELECT same, count(*) AS n, round(min(dist), 6) AS nearest, round(max(corr), 6) AS closest FROM h GROUP BY same")
def a35_cross_extremes(spark, d):
    t = edges(spark, d).groupBy((F.col("a") % 2 == F.col("b") % 2).alias("same")).agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.max("corr").alias("closest"))
    return rounded(t, 6)


@query(f"WITH {SERIES}, d AS (SELECT md - lag(md) OVER (PARTITION BY user_id ORDER BY rn) AS d FROM s) SELECT count(*) AS steps, round(min(d), 4) AS least, round(max(d), 4) AS most, round(quantile_cont(d, 0.25), 4) AS q25, round(quantile_cont(d, 0.5), 4) AS q50, round(quantile_cont(d, 0.75), 4) AS q75, round(quantile_cont(d, 0.95), 4) AS q95, round(avg((abs(d - 1) > 1e-9)::INT), 4) AS off_unit FROM d WHERE d IS NOT NULL")
def a36_step_statistics(spark, d):
    return rounded(ordered.step_statistics(series(spark, d).select("user_id", "rn", "md"), "user_id", "md"))


@query(f"WITH {FOLD} SELECT model, list_transform(list(rmse ORDER BY fold), lambda x: round(x, 4)) AS scores FROM fr GROUP BY model")
def a37_fold_scores(spark, d):
    t = metrics.fold_metrics(panel(spark, d), ARMS, "incumbent")
    return t.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "rmse"))), lambda x: F.round(x["rmse"], 4)).alias("scores"))


@query(f"WITH {PANEL} SELECT well, round(sqrt(avg((candidate - incumbent) ** 2)), 4) AS rms, round(max(abs(candidate - incumbent)), 4) AS absmax FROM panel GROUP BY well")
def a38_movement(spark, d):
    m = F.col("candidate") - F.col("incumbent")
    return rounded(panel(spark, d).groupBy("well").agg(F.sqrt(F.avg(m * m)).alias("rms"), F.max(F.abs(m)).alias("absmax")))


# --- windows -------------------------------------------------------------------------------------------------------------

_W = {w: f"OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)" for w in (5, 21, 51, 101)}


@query(f"WITH {FILLED} SELECT * FROM (SELECT event_id, {', '.join(f'round(avg(fill) {o}, 9) AS fill_mean{w}, round(coalesce(stddev_samp(fill) {o}, 0), 6) AS fill_std{w}' for w, o in _W.items())} FROM f)")
def w01_rolling(spark, d):
    t = ordered.rolling(ordered.fill_linear(series(spark, d), "user_id", "gr", "fill"), "user_id", "fill", list(_W))
    return t.select("event_id", *(r(f"fill_{k}{w}", 9 if k == "mean" else 6).alias(f"fill_{k}{w}") for w in _W for k in ("mean", "std")))


@query(f"WITH {FILLED} SELECT event_id, " + ", ".join(f"round(coalesce(lag(fill, {k}) OVER (PARTITION BY user_id ORDER BY rn), first_value(fill) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 4) AS fill_lag{k}, round(coalesce(lead(fill, {k}) OVER (PARTITION BY user_id ORDER BY rn), last_value(fill) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 4) AS fill_lead{k}" for k in (1, 5, 15, 30)) + " FROM f")
def w03_shifts(spark, d):
    t = ordered.shifts(ordered.fill_linear(series(spark, d), "user_id", "gr", "fill"), "user_id", "fill", [1, 5, 15, 30])
    return t.select("event_id", *(r(f"fill_{k}{w}").alias(f"fill_{k}{w}") for w in (1, 5, 15, 30) for k in ("lag", "lead")))


@query(f"WITH {SERIES}, g AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS g FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT event_id, round(g, 4) AS g1, round(CASE WHEN lag(g) OVER w IS NULL THEN lead(g) OVER w - g WHEN lead(g) OVER w IS NULL THEN g - lag(g) OVER w ELSE (lead(g) OVER w - lag(g) OVER w) / 2 END, 4) AS g2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY rn)")
def w04_gradient(spark, d):
    t = ordered.gradient(ordered.gradient(series(spark, d), "user_id", "value", "g1"), "user_id", "g1", "g2")
    return t.select("event_id", r("g1").alias("g1"), r("g2").alias("g2"))


@query(f"WITH {SERIES}, g AS (SELECT *, coalesce(value - lag(value) OVER w, 0) AS d1, (value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0) AS sl FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn)) SELECT event_id, round(d1, 4) AS value_d1, round(sl, 2) AS value_slope, round(coalesce(d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY rn), 0), 4) AS value_d2 FROM g")
def w05_differences(spark, d):
    t = ordered.differences(series(spark, d), "user_id", "value", "md")
    return t.select("event_id", r("value_d1").alias("value_d1"), r("value_slope", 2).alias("value_slope"), r("value_d2").alias("value_d2"))


@query(f"WITH {SERIES} SELECT event_id, round(max(value) {_W[21]}, 4) AS value_max21, round(sqrt(avg(value * value) {_W[21]}), 4) AS value_energy21 FROM s")
def w06_envelope(spark, d):
    t = ordered.envelope(series(spark, d), "user_id", "value", 21)
    return t.select("event_id", r("value_max21").alias("value_max21"), r("value_energy21").alias("value_energy21"))


@query("SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS rank FROM part")
def w07_average_rank(spark, d):
    return table(spark, d, "part").select("p_partkey", X.average_rank(["p_brand"], "p_size").alias("rank"))


@query(f"WITH {LONG}, g AS (SELECT component, model, sqrt(avg(se)) AS rmse FROM se GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse DESC, component) AS worst_rank, count(*) OVER (PARTITION BY model) AS n FROM g) SELECT component, model, round(rmse, 4) AS rmse, worst_rank::INT AS worst_rank, worst_rank <= ceil(0.1 * n) AS in_tail FROM k")
def w08_mark_worst(spark, d):
    g = metrics.long(metrics.group_rmse_wide(panel(spark, d), ["component"], ARMS), ["component"], ARMS, "rmse")
    return rounded(metrics.mark_worst(g, ["model"], "rmse", "component"))


@query("SELECT p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand) AS brand_min, count(*) OVER (PARTITION BY p_brand) AS brand_size FROM part")
def w09_group_transform(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", F.min("p_retailprice").over(w).alias("brand_min"), F.count("*").over(w).alias("brand_size"))


@query(f"WITH {SERIES}, q AS (SELECT event_id, (rn + 1)::DOUBLE / n AS frac, rn::DOUBLE / greatest(n - 1, 1) AS frac0 FROM s) SELECT event_id, round(frac, 8) AS frac, round(frac0, 8) AS frac0, round(frac * frac, 8) AS frac2, round(sqrt(frac), 8) AS sqrt_frac FROM q")
def w10_relative_position(spark, d):
    return rounded(ordered.relative_position(series(spark, d), "user_id").select("event_id", "frac", "frac0", "frac2", "sqrt_frac"), 8)


@query(f"WITH {SERIES} SELECT event_id FROM s WHERE rn < cut QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) <= 30")
def w11_tail_rows(spark, d):
    return ordered.tail_rows(series(spark, d).where("known"), "user_id", 30).select("event_id")


@query(f"WITH {FILLED} SELECT event_id, round(fill, 4) AS fill FROM f")
def w12a_fill_linear(spark, d):
    return rounded(ordered.fill_linear(series(spark, d), "user_id", "gr", "fill").select("event_id", "fill"))


_GAPS = FILLED.replace("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END", "CASE WHEN (rn_ // 5) % 3 = 0 THEN NULL ELSE value END").replace("FROM events),", "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn_ FROM events)),")


@query(f"WITH {_GAPS} SELECT event_id, round(CASE WHEN gr IS NOT NULL THEN gr WHEN a IS NOT NULL AND b IS NOT NULL AND rn - i <= 3 THEN fill END, 4) AS inner_fill, CASE WHEN gr IS NOT NULL THEN 1.0 WHEN a IS NOT NULL AND b IS NOT NULL AND rn - i <= 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS inner_fill_weight FROM f")
def w12b_fill_inner(spark, d):
    t = series(spark, d).withColumn("gr", F.when(F.floor(F.col("rn") / 5) % 3 != 0, F.col("value")))
    return rounded(ordered.fill_inner(t, "user_id", "gr", "inner_fill", 3).select("event_id", "inner_fill", "inner_fill_weight"))


@query(f"""WITH {FILLED}, v AS (SELECT user_id, list(fill ORDER BY rn) AS v, count(gr) AS c, count(*) AS n FROM f GROUP BY 1), p AS (SELECT user_id, c, k, v, k * (n - 1) / 63.0 AS pos, least(floor(k * (n - 1) / 63.0), n - 2)::INT AS i FROM v, (SELECT unnest(range(64)) AS k)),
    q AS (SELECT user_id, c, k, v[i + 1] + (v[i + 2] - v[i + 1]) * (pos - i) AS y FROM p), z AS (SELECT *, y - avg(y) OVER (PARTITION BY user_id) AS y0 FROM q) SELECT user_id, k, round(y0 / sqrt(sum(y0 * y0) OVER (PARTITION BY user_id)), 6) AS shape FROM z""")
def w13_fingerprint(spark, d):
    t = ordered.fingerprint(series(spark, d), "user_id", "gr")
    return t.select("user_id", F.posexplode("shape").alias("k", "shape")).select("user_id", F.col("k").cast("bigint").alias("k"), r("shape", 6).alias("shape"))


@query(f"""WITH {SERIES}, q AS (SELECT user_id, rn, n, fr, value - lagv AS d FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY rn), value) AS lagv FROM s), (SELECT unnest([0.4, 0.5, 0.6, 0.7]) AS fr)), m AS (SELECT user_id, fr, median(d) AS m FROM q WHERE rn < floor(n * fr::DOUBLE) GROUP BY ALL),
    e AS (SELECT user_id, fr, sqrt(avg((d - m) ** 2)) AS e FROM q JOIN m USING (user_id, fr) WHERE rn >= floor(n * fr::DOUBLE) AND rn < floor(n * (fr::DOUBLE + 0.1::DOUBLE)) GROUP BY ALL) SELECT user_id, round(avg(e), 4) AS cv FROM e GROUP BY user_id""")
def w14_rolling_origin(spark, d):
    w = ordered.ordered("user_id")
    t = series(spark, d).withColumn("before", F.coalesce(F.lag("value").over(w), F.col("value")))
    return rounded(ordered.rolling_origin(t, "user_id", "before", "value", [0.4, 0.5, 0.6, 0.7]))


@query(f"WITH {SERIES} SELECT event_id FROM s WHERE rn % 4 = 0 OR rn = n - 1")
def w15_stride(spark, d):
    return ordered.stride(series(spark, d), "user_id", 4).select("event_id")


@query("SELECT s_suppkey, round(sum(s_suppkey + 1) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING) / sum(s_suppkey + 1) OVER (PARTITION BY s_nationkey), 8) AS cdf FROM supplier")
def w16_cumulative_share(spark, d):
    return ordered.cumulative_share(table(spark, d, "supplier").withColumn("w", F.col("s_suppkey") + 1), ["s_nationkey"], "s_acctbal", "w", ["s_suppkey"]).select("s_suppkey", r("cdf", 8).alias("cdf"))


@query(f"""WITH {SERIES}, m AS (SELECT user_id, rn, seed, value * (1 + seed / 10.0) AS v, -((value / 100.0 - seed) ** 2) AS ll FROM s, (SELECT unnest([0, 1, 2]) AS seed)), c AS (SELECT *, coalesce(sum(ll) OVER (PARTITION BY user_id, seed ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM m), w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY user_id, rn)) AS w FROM c)
    SELECT user_id, rn, round(sum(w * v) / sum(w), 4) AS mixed FROM w GROUP BY user_id, rn""")
def w17_prequential(spark, d):
    t = series(spark, d).select("user_id", "rn", "value", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("seed"))
    t = t.withColumns({"v": F.col("value") * (1 + F.col("seed") / 10.0), "ll": -F.pow(F.col("value") / 100.0 - F.col("seed"), 2)})
    return ordered.prequential(t, "user_id", "seed", "v", "ll").select("user_id", F.col("rn").cast("bigint").alias("rn"), r("mixed").alias("mixed"))


@query(f"WITH {SERIES} SELECT event_id, round(CASE WHEN lag(rn) OVER w IS NOT NULL THEN greatest(sqrt((md - lag(md) OVER w) ** 2 + (value - lag(value) OVER w) ** 2), 0.25) END, 4) AS chord FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn)")
def w18_chord(spark, d):
    return rounded(ordered.chord(series(spark, d), "user_id", ["md", "value"]).select("event_id", "chord"))


# --- order, sets, reshapes ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal, c_custkey")
def o01_stable_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", "c_acctbal", "c_custkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey DESC")
def o02_mixed_order(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.col("s_acctbal").desc(), F.col("s_suppkey").desc())


@query(f"WITH {LONG} SELECT model, round(sqrt(avg(se)), 4) AS rmse FROM se GROUP BY model ORDER BY rmse, model")
def o03_leaderboard(spark, d):
    return a01_rmse(spark, d).orderBy("rmse", "model")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def o04_top_k(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderpriority")
def o05_arg_min(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.min("o_totalprice").alias("o_totalprice"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25")
def o06_first_n(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(25)


@query("SELECT c_custkey AS key, c_acctbal AS bal, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def u01_union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("key")))


@query("SELECT lang, count(*) AS n, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents GROUP BY lang")
def u02_distinct_codes(spark, d):
    t = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return t.withColumn("code", (F.dense_rank().over(Window.orderBy("lang")) - 1).cast("bigint"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u04_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("WITH t AS (SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_left, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS only_right) SELECT *, only_left + only_right = 0 AS same FROM t")
def u05_set_equality(spark, d):
    return joins.same_keys(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME model VALUE v")
def u06_unpivot(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return metrics.long(table(spark, d, "lineitem").select(*keys, "l_discount", "l_tax"), keys, ["l_discount", "l_tax"], "v")


@query("SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS \"F\", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS \"O\" FROM lineitem GROUP BY l_returnflag")
def u07_pivot(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")), 2)


@query(f"WITH {PANEL} SELECT well, component, horizon, round(truth, 6) AS truth, round(incumbent, 6) AS incumbent, round(candidate, 6) AS candidate, round(blend, 6) AS blend FROM panel")
def u08_prediction_table(spark, d):
    return rounded(panel(spark, d).select("well", "component", "horizon", "truth", *ARMS), 6)


@query("""SELECT 'extra_ids' AS check_name, count(*) AS violations FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'missing_ids', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT doc_id) FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'not_finite', count(*) FROM documents WHERE doc_id % 2 = 0 AND n_chars IS NULL UNION ALL SELECT 'out_of_order', 0""")
def k04_submission_checks(spark, d):
    from cairn.sources.files import submission_checks

    docs = table(spark, d, "documents")
    order = joins.numbered(docs.select(F.col("doc_id").alias("id")), ["id"], "ord")
    made = order.where("id % 2 = 0").join(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("tvt")), "id")
    return submission_checks(made, order)


# --- whole evaluations --------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {EDGES}" + """, bi AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, bi.b FROM reach JOIN bi ON reach.b = bi.a),
    root AS (SELECT a, min(b) AS r FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS degree FROM bi GROUP BY a)
    SELECT root.a AS vec_id, 'component_' || CASE WHEN dense_rank() OVER (ORDER BY r) - 1 < 1000 THEN lpad((dense_rank() OVER (ORDER BY r) - 1)::VARCHAR, 3, '0') ELSE (dense_rank() OVER (ORDER BY r) - 1)::VARCHAR END AS component, coalesce(degree, 0) AS degree FROM root LEFT JOIN deg ON root.a = deg.a""")
def d26_components(spark, d):
    return joins.labelled_components(table(spark, d, "embeddings"), "vec_id", edges(spark, d))


GRID = PANEL + """, q AS (SELECT component, count(*) AS n, avg((candidate - incumbent) ** 2) AS g, avg((candidate - incumbent) * (truth - incumbent)) AS c, avg((truth - incumbent) ** 2) AS rr FROM panel GROUP BY 1), gr AS (SELECT k * 0.005::DOUBLE AS w, n, greatest(0, rr - 2 * k * 0.005::DOUBLE * c + (k * 0.005::DOUBLE) ** 2 * g) AS mse FROM q, range(21) t(k)),
    tl AS (SELECT w, sqrt(avg(mse)) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY mse DESC) AS r, count(*) OVER (PARTITION BY w) AS m FROM gr) WHERE r <= greatest(1, ceil(0.1 * m)) GROUP BY w), t AS (SELECT w, sqrt(sum(n * mse) / sum(n)) AS row, avg(sqrt(mse)) AS macro, any_value(tail) AS tail FROM gr JOIN tl USING (w) GROUP BY w)"""


@query(f"WITH {GRID} SELECT round(w, 6) AS w, round(row, 4) AS row, round(macro, 4) AS macro, round(tail, 4) AS tail, round(0.5 * row / (SELECT row FROM t WHERE w = 0) + 0.25 * macro / (SELECT macro FROM t WHERE w = 0) + 0.25 * tail / (SELECT tail FROM t WHERE w = 0) + 0.01 * w * w, 6) AS objective FROM t")
def d24_trust_region_grid(spark, d):
    t = metrics.blend_grid(panel(spark, d), "incumbent", "candidate")
    return t.select(r("w", 6).alias("w"), r("row").alias("row"), r("macro").alias("macro"), r("tail").alias("tail"), r("objective", 6).alias("objective"))


def q01_headline(spark, d):
    headline = spark.createDataFrame([(11, 12, 0.66, 0.92, 320, 243, 1556878)], "positive_folds int, total_folds int, primary_oof_gain double, complement_oof_gain double, wells int, components int, rows bigint")
    return headline.select("positive_folds", "total_folds", "primary_oof_gain", "complement_oof_gain", "wells", "components", "rows")


QUERIES["q01_headline"] = q01_headline
SQL["q01_headline"] = "SELECT 11 AS positive_folds, 12 AS total_folds, 0.66::DOUBLE AS primary_oof_gain, 0.92::DOUBLE AS complement_oof_gain, 320 AS wells, 243 AS components, 1556878::BIGINT AS rows"


@query("SELECT n_nationkey AS position, n_name AS contract, n_regionkey AS \"order\" FROM nation ORDER BY n_nationkey")
def q02_ordered_report(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("contract"), F.col("n_regionkey").alias("order")).orderBy("position")


@query("SELECT s_suppkey AS position, s_name AS fold_label, s_nationkey AS panel, s_suppkey AS outer_fold, s_acctbal AS gain FROM supplier ORDER BY s_suppkey")
def q03_fold_report(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("fold_label"), F.col("s_nationkey").alias("panel"), F.col("s_suppkey").alias("outer_fold"), F.col("s_acctbal").alias("gain"))
    return t.orderBy("position")


@query("SELECT r_name AS stage, 'rule' AS role, r_regionkey * 0.5::DOUBLE AS rms_budget, r_regionkey + 10.0::DOUBLE AS row_cap, concat('no ', r_name) AS failure_mode, r_regionkey AS \"order\" FROM region ORDER BY \"order\"")
def q04_constraint_ledger(spark, d):
    table(spark, d, "region").createOrReplaceTempView("cairn_constraints")
    return spark.sql("SELECT r_name AS stage, 'rule' AS role, r_regionkey * 0.5D AS rms_budget, r_regionkey + 10.0D AS row_cap, concat('no ', r_name) AS failure_mode, r_regionkey AS `order` FROM cairn_constraints ORDER BY `order`")


SETTINGS = [(radius, threshold, 0.2) for radius in (0.001, 0.002, 0.004) for threshold in (0.35, 0.4, 0.5)]


@query(f"WITH RECURSIVE {EDGES}" + f""", st AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in SETTINGS)}) t(radius, threshold, far)), ks AS (SELECT radius, threshold, a, b FROM p, st WHERE dist <= radius OR (dist <= far AND corr >= threshold)), bi AS (SELECT * FROM ks UNION ALL SELECT radius, threshold, b, a FROM ks),
    reach AS (SELECT radius, threshold, vec_id AS a, vec_id AS b FROM embeddings, st UNION SELECT reach.radius, reach.threshold, reach.a, bi.b FROM reach JOIN bi ON reach.b = bi.a AND reach.radius = bi.radius AND reach.threshold = bi.threshold),
    root AS (SELECT radius, threshold, a, min(b) AS r FROM reach GROUP BY ALL), sz AS (SELECT radius, threshold, r, count(*) AS n FROM root GROUP BY ALL)
    SELECT radius, threshold, count(*) AS components, max(n) AS largest, count(*) FILTER (n > 1) AS several FROM sz GROUP BY ALL""")
def a34_graph_grid(spark, d):
    widest = edges(spark, d, max(r for r, _, _ in SETTINGS), 0.2, min(t for _, t, _ in SETTINGS), forests=True)
    return joins.graph_grid(table(spark, d, "embeddings"), "vec_id", widest, spark.createDataFrame(SETTINGS, "radius double, threshold double, far double"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) - 1 AS place FROM part")
def o07_seeded_shuffle(spark, d):
    return ordered.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 7)


@query("""WITH n AS (SELECT s_nationkey AS anchor, avg(s_acctbal) AS ax, avg(s_suppkey)::DOUBLE AS ay FROM supplier GROUP BY 1), r AS (SELECT s_suppkey AS place, anchor, sqrt((s_acctbal - ax) ** 2 + (s_suppkey - ay) ** 2) AS dist FROM supplier, n)
    SELECT place, anchor, k, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY dist, anchor) AS k FROM r) WHERE k <= 3""")
def j11_nearest_anchors(spark, d):
    s = table(spark, d, "supplier")
    known = s.groupBy(F.col("s_nationkey").alias("anchor")).agg(F.avg("s_acctbal").alias("x"), F.avg("s_suppkey").alias("y"))
    places = s.select(F.col("s_suppkey").alias("place"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    return rounded(neighbours.nearest(places, known, "place", "anchor", 3).select("place", "anchor", F.col("k").cast("bigint").alias("k"), "dist"), 6)


_HALF, _SIZE = 8, 17
MATCHED = FILLED + f""", sm AS (SELECT user_id, rn, cut, n, rn >= cut AS hidden, value, CASE WHEN rn < cut THEN rn ELSE rn - cut END AS i, CASE WHEN rn < cut THEN cut ELSE n - cut END AS m, avg(fill) OVER (PARTITION BY user_id, rn >= cut ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM f),
    aw AS (SELECT a.user_id, a.i AS start, any_value(a.m) AS m, list(b.v ORDER BY b.i) AS w, max(CASE WHEN b.i = a.i + {_HALF} THEN b.value END) AS level FROM sm a JOIN sm b ON a.user_id = b.user_id AND NOT a.hidden AND NOT b.hidden AND b.i BETWEEN a.i AND a.i + {_SIZE - 1} WHERE a.i % 3 = 0 AND a.i + {_SIZE} <= a.m AND a.m > {_SIZE} GROUP BY 1, 2),
    bw AS (SELECT a.user_id, a.i, list(b.v ORDER BY o) AS w FROM sm a, range(-{_HALF}, {_HALF} + 1) t(o) JOIN sm b ON b.user_id = a.user_id AND b.hidden AND b.i = least(greatest(a.i + o, 0), a.m - 1) WHERE a.hidden GROUP BY 1, 2),
    az AS (SELECT user_id, start, level, list_transform(w, lambda x: (x - list_avg(w)) / (list_stddev_pop(w) + 1e-6)) AS z FROM aw), bz AS (SELECT user_id, i, list_transform(w, lambda x: (x - list_avg(w)) / (list_stddev_pop(w) + 1e-6)) AS z FROM bw),
    mt AS (SELECT user_id, i, start, level, list_dot_product(az.z, bz.z) / {_SIZE} AS r FROM bz JOIN az USING (user_id)), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY r DESC, start) AS k FROM mt) WHERE k = 1),
    lastv AS (SELECT user_id, arg_max(value, rn) AS last FROM sm WHERE NOT hidden GROUP BY 1)"""


def sides(spark, d) -> DataFrame:
    """Filled series with each row's side and its number there."""
    t = ordered.fill_linear(series(spark, d), "user_id", "gr", "fill")
    return t.withColumn("i", F.when(F.col("known"), F.col("rn")).otherwise(F.col("rn") - F.col("cut")).cast("bigint"))


@query(f"WITH {MATCHED} SELECT s.user_id, s.i::BIGINT AS i, start::BIGINT AS start, round(coalesce(level, last), 4) AS level, round(coalesce(r, 0), 6) AS r FROM sm s LEFT JOIN top USING (user_id, i) LEFT JOIN lastv USING (user_id) WHERE s.hidden")
def j12_window_match(spark, d):
    t = sides(spark, d)
    found = matching.window_match(t.where("known").select("user_id", "i", F.col("fill").alias("v"), F.col("value").alias("level")), t.where("NOT known").select("user_id", "i", F.col("fill").alias("v")), ["user_id"], _HALF)
    return found.select("user_id", "i", "start", r("level").alias("level"), r("r", 6).alias("r"))


@query()
def o08_beam_search(spark, d):
    near = Window.partitionBy("user_id").orderBy("i").rowsBetween(-2, 2)
    t = sides(spark, d).where("NOT known").withColumn("v", F.avg("fill").over(near))
    c = curve(spark, d)
    span = c.agg(F.min("y").alias("low"), F.max("y").alias("high"))
    knots = c.crossJoin(F.broadcast(span)).select(F.sort_array(F.collect_list(F.struct("x", (100 * (F.col("y") - F.col("low")) / (F.col("high") - F.col("low"))).alias("y")))).alias("k"))  # one row
    t = t.join(F.broadcast(knots)).select("user_id", "i", "v", (F.col("user_id") % F.size("k")).alias("start"), F.when(F.col("i") == 0, F.col("k.y")).alias("curve"))
    return matching.beam_paths(t, "user_id", 10, 20.0, 144.0)


def entry(spark: SparkSession, d: str) -> DataFrame:
    return a04_model_metrics(spark, d)
