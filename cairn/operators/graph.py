"""Connected components of a link table, by alternating stars; no step holds more than rows of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.staging import Stage

MAX_ROUNDS = 60
#: So few distinct links are joined up by one task.
SMALL = 10_000


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _rank(v):
    """A key in the order of Spark's values: nulls first, NaN after all other numbers, structs and arrays part by part."""
    if isinstance(v, dict):
        return tuple(_rank(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_rank(x) for x in v)
    return (v is not None, math.inf if v != v else v, v != v)


def _in_one_task(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        ends = pa.concat_arrays([c for side in ("a", "b") for c in (b.column(side) for b in held)])
        number: dict = {}
        ids = [number.setdefault(k, len(number)) for k in map(_rank, ends.to_pylist())]
        order = sorted(number)
        place = {number[k]: i for i, k in enumerate(order)}  # roots are the smallest
        parent, n = list(range(len(order))), len(ids) // 2

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for a, b in zip(ids[:n], ids[n:]):
            p, q = root(place[a]), root(place[b])
            parent[max(p, q)] = min(p, q)
        first = np.zeros(len(order), np.int64)  # where each node stands in ``ends``
        for at, i in enumerate(ids):
            first[place[i]] = at
        roots = first[[root(v) for v in range(len(order))]]
        yield pa.RecordBatch.from_arrays([ends.take(pa.array(first)), ends.take(pa.array(roots))], names=["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, T.StructType().add("node", kind).add("component", kind))


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """``(node, component)`` for every node on a link; ``component`` is the smallest node reachable.

    Each round sends every node's larger neighbours to its smallest one (large star), then every node's
    smaller neighbours to the smallest (small star), by a partial aggregate and a join, so a node of very
    high degree is a skewed join that Spark splits. Links with a null end or between a node and itself add
    nothing. The number of rounds grows with the logarithm of the longest path. At most ``small`` links are joined up at once.
    """
    spark = links.sparkSession
    stage = Stage(spark, "components")
    a, b = F.col(src), F.col(dst)
    now = stage.put(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    state = _fingerprint(now)
    if 0 < state[0] <= small:
        done = stage.put(_in_one_task(now))
        stage.drop(now)
        return done
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        then = stage.put(small.union(least.select(F.col("m").alias("a"), "b")).distinct())
        stage.drop(now)
        now, before, state = then, state, _fingerprint(then)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())
