"""Joins that check what they assume, interpolating lookups, and joins within a radius.

None of them plans a nested loop over two large tables: range and radius conditions become equal keys first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import tiles
from cairn.operators.graph import connected_components
from cairn.plans.staging import Stage


class DuplicateKeyError(ValueError):
    pass


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that fails when a key repeats on the right. The check runs within the join: a repeated key raises there."""
    n = F.count("*").over(Window.partitionBy(*on))
    one = right.withColumn("_n", F.when(n == 1, n).otherwise(F.raise_error(F.lit("the right side of a many-to-one join repeats a key"))))
    return left.join(one.where("_n = 1").drop("_n"), [*on], "left")


def check_unique(table: DataFrame, on: Sequence[str]) -> None:
    if table.groupBy(*on).count().where("count > 1").limit(1).count():
        raise DuplicateKeyError(f"repeated keys: {', '.join(on)}")


def segments(knots: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``(*keys, x0, y0, x1, y1, first, last)``: a row for each knot up to the next one; knots of equal ``x`` must be merged before."""
    w = Window.partitionBy(*keys).orderBy(x)
    return knots.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), (F.row_number().over(w) == 1).alias("first"))


def interpolate(queries: DataFrame, knots: DataFrame, keys: Sequence[str], at: str, x: str, y: str, name: str = "value", width: float | None = None) -> DataFrame:
    """Adds ``name``: the piecewise linear curve through the knots of the same key, constant beyond its ends.

    Segments are cut at multiples of ``width`` (by default the knots' range by their mean number for a key, 64 at least), so a query
    meets by equal key only the segments of its own cell; a long segment is a row in each cell it crosses.
    """
    per_key = F.count("*") / F.count_distinct(*keys) if keys else F.count("*")
    lo, hi, n = knots.agg(F.min(x), F.max(x), per_key).first()
    if lo is None:
        return queries.withColumn(name, F.lit(None).cast("double"))
    width = float(width or (hi - lo) / max(64, int(n or 0)) or 1.0)
    cell = lambda c: F.floor((c - F.lit(lo)) / F.lit(width))
    top = int((hi - lo) // width)
    inside = lambda c: F.least(F.greatest(cell(c), F.lit(0)), F.lit(top)).cast("int")
    s = segments(knots, keys, x, y)
    begin = F.when(F.col("first"), F.lit(0)).otherwise(inside(F.col("x0")))
    end = F.when(F.col("x1").isNull(), F.lit(top)).otherwise(inside(F.col("x1")))
    s = s.withColumn("_cell", F.explode(F.sequence(begin, end)))
    q = queries.withColumn("_cell", inside(F.col(at)))
    hit = (F.col("first") | (F.col(at) >= F.col("x0"))) & (F.col("x1").isNull() | (F.col(at) < F.col("x1")))
    cond = [q[k].eqNullSafe(s[k]) for k in keys] + [q["_cell"] == s["_cell"], hit]
    both = q.join(s, cond, "left")
    a = F.col(at)
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (a - F.col("x0")) / (F.col("x1") - F.col("x0"))
    made = F.when(a.isNull(), F.lit(None)).when(F.col("x1").isNull() | (a <= F.col("x0")), F.col("y0")).otherwise(line)
    return both.select(*(q[c] for c in queries.columns), made.alias(name))


def nearest(queries: DataFrame, grid: DataFrame, at: str, x: str, name: str = "nearest") -> DataFrame:
    """Adds the nearest grid point; half way goes to the lower. One sorted pass over the union of both sides, in windows by cell."""
    lo, hi, n = grid.agg(F.min(x), F.max(x), F.count_distinct(x)).first()
    width = ((hi - lo) / max(1, n)) or 1.0
    cell = lambda c: F.least(F.greatest(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(int((hi - lo) // width))).cast("int")
    w = Window.orderBy("x0")
    s = grid.select(F.col(x).alias("x0")).distinct().select("x0", F.lag("x0").over(w).alias("before"), F.lead("x0").over(w).alias("after"))  # the grid's distinct points
    s = s.select("x0", F.explode(F.sequence(cell(F.coalesce((F.col("x0") + F.col("before")) / 2, F.col("x0"))), cell(F.coalesce((F.col("x0") + F.col("after")) / 2, F.lit(float(hi)))))).alias("_cell"), "before", "after")
    q = queries.withColumn("_cell", cell(F.col(at)))
    own = (F.col("before").isNull() | (F.col(at) > (F.col("x0") + F.col("before")) / 2)) & (F.col("after").isNull() | (F.col(at) <= (F.col("x0") + F.col("after")) / 2))
    return q.join(s, (q["_cell"] == s["_cell"]) & own, "left").select(*(q[c] for c in queries.columns), F.col("x0").alias(name))


def as_of(queries: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, when: str, value: str, name: str) -> DataFrame:
    """Adds the value of the latest fact at or before ``at`` with the same keys: one sort of both sides together, no range join."""
    both = queries.select("*", F.lit(1).alias("_side"), F.col(at).alias("_t"), F.lit(None).alias("_v")).unionByName(facts.select(*keys, F.lit(0).alias("_side"), F.col(when).alias("_t"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", True).over(w)).where("_side = 1").drop("_side", "_t", "_v")


def radius_pairs(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """``(a, b, dist)`` for ``a < b`` within the radius: points meet by grid cell, each being in the cells next to its own."""
    width = radius if radius > 0 else 2.0**-20
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    home = points.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    probe = points.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("px"), cell(y).alias("py"), F.explode(around).alias("o"))
    probe = probe.select("a", "ax", "ay", (F.col("px") + F.col("o.i")).alias("cx"), (F.col("py") + F.col("o.j")).alias("cy"))
    dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return probe.join(home, ["cx", "cy"]).where("a < b").withColumn("dist", dist).where(F.col("dist") <= radius).select("a", "b", "dist")


def product(a: Column, b: Column, size: int) -> Column:
    """Of two arrays of ``size`` numbers; null where one is null, of another length, or not finite."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) == size) & (F.size(b) == size) & ((dot - dot) == 0), dot)


def similarity_edges(points: DataFrame, key: str, x: str, y: str, first: str, second: str, near: float, far: float, threshold: float, size: int | None = None, forests: bool = False) -> DataFrame:
    """``(a, b, dist, corr, reason)``: pairs within ``near``, or within ``far`` with a fingerprint product of at least the threshold.

    ``corr`` is the larger of the products of ``first`` and of ``second``, null where neither fingerprint has one. ``size``: numbers of a fingerprint,
    by default those of the longest. Pairs go by bounded tiles (``tiles.similar_pairs``, there also ``forests``); where ``far`` is no more
    than ``near`` they meet in cells as wide as ``near``, and all of them are links.
    """
    both = [first] if first == second else [first, second]
    if size is None:
        size = points.agg(F.max(F.greatest(*(F.size(c) for c in both)) if len(both) > 1 else F.size(first))).first()[0]
    size = max(1, size or 1)
    if far <= near:
        side = lambda s: points.select(F.col(key).alias(s), *(F.col(c).alias(f"{s}_{i}") for i, c in enumerate(both)))
        products = [product(F.col(f"a_{i}"), F.col(f"b_{i}"), size) for i in range(len(both))]
        close = radius_pairs(points, key, x, y, near).join(side("a"), "a").join(side("b"), "b")
        found = close.select("a", "b", "dist", (F.greatest(*products) if len(both) > 1 else products[0]).alias("corr"))
    else:
        found = tiles.similar_pairs(points, key, x, y, both, near, far, threshold, size, forests)
    spatial, similar = F.col("dist") <= near, (F.col("dist") <= far) & (F.col("corr") >= threshold)
    reason = F.when(spatial & similar, "spatial+similar").when(spatial, "spatial").when(similar, "similar")
    return found.select("a", "b", "dist", "corr", reason.alias("reason"))


def numbered(t: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 in the order of these columns, over the whole table but in no single task: ranges are
    numbered apart and begin where the rows before them end. Equal rows are numbered in any order."""
    spark = t.sparkSession
    staged = Stage(spark, "numbered").put(t.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = staged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return staged.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_range", "_own", "_before")


def graph_grid(points: DataFrame, key: str, edges: DataFrame, settings: DataFrame) -> DataFrame:
    """``(radius, threshold, components, largest, several)`` for each ``(radius, threshold, far)`` of ``settings``: how many components the
    points have, the size of the largest, and how many have several points.

    ``edges``: ``(a, b, dist, corr)`` of the widest setting, or only their spanning forests by distance and by product if all settings have one
    ``far``. Links that every setting keeps are contracted once, so that a setting costs only the links that it adds.
    """
    stage = Stage(points.sparkSession, "grid")
    edges, settings = stage.put(edges.select("a", "b", "dist", "corr")), settings.select("radius", "threshold", "far")
    kept = lambda radius, threshold, far: (F.col("dist") <= radius) | ((F.col("dist") <= far) & (F.col("corr") >= threshold))
    always = kept(*(F.lit(v) for v in settings.agg(F.min("radius"), F.max("threshold"), F.min("far")).first() or (None,) * 3))
    base = stage.put(connected_components(edges.where(always), "a", "b"))
    to = lambda s: base.select(F.col("node").alias(s), F.col("component").alias(f"_{s}"))
    rest = edges.where(~F.coalesce(always, F.lit(False))).join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "dist", "corr").where("a <> b")
    added = stage.put(rest).crossJoin(F.broadcast(settings)).where(kept(F.col("radius"), F.col("threshold"), F.col("far")))
    at = lambda c: F.struct("radius", "threshold", F.col(c).alias("node"))  # noqa: E731  a setting's nodes are nodes of their own
    comps = connected_components(added.select(at("a").alias("src"), at("b").alias("dst")).distinct())
    sizes = base.groupBy(F.col("component").alias("own")).agg(F.count("*").alias("points"))
    joined = comps.join(sizes, comps["node.node"] == sizes["own"], "left")
    groups = joined.groupBy("component").agg(F.sum(F.coalesce("points", F.lit(1))).alias("points"), F.count("*").alias("members"), F.count("points").alias("based")).select("component.radius", "component.threshold", "points", "members", "based")
    found = groups.groupBy("radius", "threshold").agg(F.count("*").alias("groups"), F.max("points").alias("most"), F.sum(F.col("members") - 1).alias("joined"), F.sum("based").alias("based"))
    alone = sizes.agg(F.count("*").alias("bases"), F.coalesce(F.max("points"), F.lit(0)).alias("base_most"), F.coalesce(F.sum(F.col("points") - 1), F.lit(0)).alias("base_joined"))
    total = settings.select("radius", "threshold").crossJoin(F.broadcast(points.agg(F.count(key).alias("all")))).crossJoin(F.broadcast(alone))
    t = total.join(found, ["radius", "threshold"], "left").na.fill(0, ["groups", "most", "joined", "based"])
    return t.select("radius", "threshold", (F.col("all") - F.col("base_joined") - F.col("joined")).alias("components"), F.greatest("most", "base_most", F.least(F.col("all"), F.lit(1))).alias("largest"), (F.col("groups") + F.col("bases") - F.col("based")).alias("several"))


def labelled_components(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``(key, component, degree)``: every node with a label ``component_000`` and on, numbered by smallest key."""
    edges = Stage(nodes.sparkSession, "edges").put(edges.select("a", "b"))  # found once, used twice
    comps = connected_components(edges, "a", "b")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    t = nodes.select(key).join(comps, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("_root"))
    roots = numbered(t.select("_root").distinct(), ["_root"], "_i")
    name = F.concat(F.lit("component_"), F.when(F.length(F.col("_i").cast("string")) < 3, F.lpad(F.col("_i").cast("string"), 3, "0")).otherwise(F.col("_i").cast("string")))
    return t.join(roots, "_root").join(degree.withColumnRenamed("node", key), key, "left").select(key, name.alias("component"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def coverage(requests: DataFrame, table: DataFrame, on: str, order: str) -> DataFrame:
    """The requested rows in request order (``order``) with a flag ``found``; nothing is dropped."""
    return requests.join(table.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)


def reconcile(stored: DataFrame, computed: DataFrame, on: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: keys on both sides and on one only, values that differ, and ``agree``."""
    both = stored.select(*on, F.col(value).alias("_s"), F.lit(1).alias("_a")).join(computed.select(*on, F.col(value).alias("_c"), F.lit(1).alias("_b")), [*on], "full")
    t = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_stored"), F.count_if(F.col("_a").isNull()).alias("only_computed"), F.count_if(F.abs(F.col("_s") - F.col("_c")) > tolerance).alias("differ"))
    return t.withColumn("agree", (F.col("only_stored") + F.col("only_computed") + F.col("differ")) == 0)


def shared_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys that are on both sides; disjoint tables have none."""
    return a.select(*on).intersect(b.select(*on))


def same_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: keys on one side only, and ``same``."""
    left = a.select(*on).subtract(b.select(*on))
    right = b.select(*on).subtract(a.select(*on))
    t = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("only_right"))
    return t.withColumn("same", (F.col("only_left") + F.col("only_right")) == 0)
