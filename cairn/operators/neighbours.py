"""The nearest of many points, exactly, by descent of a quadtree that is a table.

Anchors are counted by cells, level by level, and a cell is cut in four while it holds more than ``LEAF``. Each place goes down the tree with
the cells that may still hold one of its ``k`` nearest: the farthest corners of its cells, added up by their counts, bound the ``k``-th distance, and
cells that begin beyond it go. Places meet anchors only in the leaves that are left. Neither side is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.staging import Stage

#: A cell with more anchors is cut in four, ``DEPTH`` times at most.
LEAF = 32
DEPTH = 40


def _tree(stage: Stage, anchors: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """``(level, cx, cy, n, x0, x1, y0, y1, whole)`` for every cell, ``whole`` where it is not cut; the anchors with their leaf; and the depth."""
    low_x, high_x, low_y, high_y = anchors.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(high_x - low_x, high_y - low_y) or 1.0
    at = lambda c, low, level: F.least(F.floor((F.col(c) - low) / side * F.lit(2.0**level)), F.lit(2**level - 1)).cast("bigint")
    left, cells, leaves = anchors, [], []
    for level in range(DEPTH + 1):
        here = left.withColumns({"level": F.lit(level), "cx": at("x", low_x, level), "cy": at("y", low_y, level)})
        own = here.groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        own = stage.put(own.withColumn("whole", (F.col("n") <= leaf) | F.lit(level == DEPTH)))
        known = here.join(own.select("cx", "cy", "whole"), ["cx", "cy"])
        cells.append(own)
        leaves.append(known.where("whole").drop("whole"))
        if not own.where("NOT whole").limit(1).count():
            break
        left = stage.put(known.where("NOT whole").select(anchors.columns))
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    return union(cells), stage.put(union(leaves)), len(cells)


def _nearer(frontier: DataFrame, k: int, x: tuple[str, str] = ("px", "px"), y: tuple[str, str] = ("py", "py")) -> DataFrame:
    """Of each place's cells those that may hold one of its ``k`` nearest anchors. ``x, y``: where a place begins and ends."""
    gap = lambda p, a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(p[1]), F.col(p[0]) - F.col(b))
    reach = lambda p, a, b: F.greatest(F.abs(F.col(p[1]) - F.col(a)), F.abs(F.col(p[0]) - F.col(b)))
    far = lambda f: F.hypot(f(x, "x0", "x1"), f(y, "y0", "y1"))
    w = Window.partitionBy("place")
    t = frontier.withColumns({"near": far(gap), "far": far(reach)}).withColumn("so_far", F.sum("n").over(w.orderBy("far", "level", "cx", "cy")))
    bound = F.min(F.when(F.col("so_far") >= k, F.col("far"))).over(w)
    return t.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-12))).drop("near", "far", "so_far", "bound")


def _finite(t: DataFrame, c: str) -> DataFrame:
    return t.where(F.col(c).isNotNull() & ((F.col("x") - F.col("x")) == 0) & ((F.col("y") - F.col("y")) == 0))


def _named(stage: Stage, anchors: DataFrame, anchor: str, k: int) -> DataFrame:
    """``(anchor, x, y)`` of distinct anchors with a name and a place, at most the ``k`` smallest of a spot."""
    spot = Window.partitionBy("x", "y").orderBy("anchor")
    named = _finite(anchors.select(F.col(anchor).alias("anchor"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "anchor").distinct()
    return stage.put(named.withColumn("_nth", F.row_number().over(spot)).where(F.col("_nth") <= k).drop("_nth"))


def around(boxes: DataFrame, anchors: DataFrame, key: str, anchor: str, k: int, leaf: int = LEAF) -> DataFrame:
    """``(key, anchor)``: all anchors that are among the ``k`` nearest of some point of the box ``(key, left, right, low, high)``, and some that lie
    no farther: those nearer to the box than the ``k``-th of the anchors' farthest corners. A box goes down the tree once for all its points."""
    stage = Stage(boxes.sparkSession, "around")
    named = _named(stage, anchors, anchor, k)
    at = stage.put(boxes.select(F.col(key).alias("place"), *(F.col(c).cast("double").alias(c) for c in ("left", "right", "low", "high"))))
    if not named.limit(1).count():
        return at.select(F.col("place").alias(key), F.lit(None).cast(named.schema["anchor"].dataType).alias(anchor)).where("false")
    cells, leaves, depth = _tree(stage, named, max(leaf, k))
    own = ("place", "left", "right", "low", "high")
    held = ("cx", "cy", "n", "x0", "x1", "y0", "y1", "whole")
    frontier = at.crossJoin(F.broadcast(cells.where("level = 0")))  # the root is one row
    child = cells.select(F.col("level").alias("_level"), F.floor(F.col("cx") / 2).alias("_cx"), F.floor(F.col("cy") / 2).alias("_cy"), *(F.col(c).alias(f"_{c}_") for c in held))
    sides = ("left", "right"), ("low", "high")
    for level in range(1, depth):
        down = frontier.where("NOT whole").join(child.where(F.col("_level") == level), (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")))
        down = down.select(*own, F.col("_level").alias("level"), *(F.col(f"_{c}_").alias(c) for c in held))
        frontier = stage.put(_nearer(frontier.where("whole").select(down.columns).unionByName(down), k, *sides))
    met = frontier.select(*own, "level", "cx", "cy").join(leaves, ["level", "cx", "cy"])
    spots = met.select(*own, "anchor", F.lit(0).alias("level"), F.monotonically_increasing_id().alias("cx"), F.lit(0).alias("cy"), F.lit(1).alias("n"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    return _nearer(spots, k, *sides).select(F.col("place").alias(key), F.col("anchor").alias(anchor))


def nearest(places: DataFrame, anchors: DataFrame, key: str, anchor: str, k: int, leaf: int = LEAF) -> DataFrame:
    """``(key, anchor, x, y, k, dist)``: the ``k`` nearest of the anchors ``(anchor, x, y)`` to each place ``(key, x, y)``, ties to the smaller anchor.

    Places with a repeated key count once for each place they stand at; places or anchors without finite coordinates or a name are left out.
    Fewer than ``k`` anchors are all neighbours. Of anchors at one spot the ``k`` smallest take part.
    """
    stage = Stage(places.sparkSession, "neighbours")
    named = _named(stage, anchors, anchor, k)
    at = stage.put(_finite(places.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "key").distinct().select("key", F.col("x").alias("px"), F.col("y").alias("py"), F.struct("key", "x", "y").alias("place")))
    columns = F.col("key").alias(key), F.col("anchor").alias(anchor), "x", "y", "k", "dist"
    if not named.limit(1).count():
        return at.select("key", F.lit(None).cast(named.schema["anchor"].dataType).alias("anchor"), *(F.lit(0.0).alias(c) for c in ("x", "y")), F.lit(1).alias("k"), F.lit(0.0).alias("dist")).where("false").select(*columns)
    cells, leaves, depth = _tree(stage, named, max(leaf, k))
    frontier = at.crossJoin(F.broadcast(cells.where("level = 0")))  # the root is one row
    child = cells.select(F.col("level").alias("_level"), F.floor(F.col("cx") / 2).alias("_cx"), F.floor(F.col("cy") / 2).alias("_cy"), *(F.col(c).alias(f"_{c}_") for c in ("cx", "cy", "n", "x0", "x1", "y0", "y1", "whole")))
    for level in range(1, depth):
        done = frontier.where("whole")
        down = frontier.where("NOT whole").join(child.where(F.col("_level") == level), (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")))
        down = down.select("key", "px", "py", "place", F.col("_level").alias("level"), *(F.col(f"_{c}_").alias(c) for c in ("cx", "cy", "n", "x0", "x1", "y0", "y1", "whole")))
        frontier = stage.put(_nearer(done.unionByName(down), k))
    met = frontier.select("key", "px", "py", "place", "level", "cx", "cy").join(leaves, ["level", "cx", "cy"])
    order = Window.partitionBy("place").orderBy("dist", "anchor")
    return met.withColumn("dist", F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(*columns)
