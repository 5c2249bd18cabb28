"""Whole groups dealt to folds, split off and sampled, over any number of groups.

The rules are sequential, but equal sizes are interchangeable: what the driver works out is which places of the run of each size go to
which fold, a few ranges for each distinct size. Groups get their place by numbering ranges of the whole order; none is collected.
Draws are MD5 of the seed and the group's name, the same in any engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.joins import numbered
from cairn.plans.staging import Stage


def draw(seed: int, name: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))


def running(t: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before the row in this order, which must be total. In no single task: ranges are
    summed apart and begin at the sum of those before them."""
    staged = Stage(t.sparkSession, "running").put(t.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = staged.groupBy("_range").agg(F.sum(value).alias("_sum"))  # one row for each range
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return staged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_base")).drop("_range", "_own", "_base")


def dealt(counts: dict[int, int], folds: int) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """Largest group first into the least loaded fold, the lowest of several: ``(size, first, end, order)`` for runs of the groups of one size, of which
    the place ``p`` goes to ``order[(p - first) % len(order)]``. A size has a few runs however many groups it has."""
    load, out = [0] * folds, []
    for size in sorted(counts, reverse=True):
        at, end = 0, counts[size]
        while at < end:
            order = sorted(range(folds), key=lambda k: (load[k], k))
            first, last = order[0], order[-1]
            if folds == 1 or (load[last], last) < (load[first] + size, first):  # whole rounds go through all folds in this order
                rounds, rest = divmod(end - at, folds)
                out.append((size, at, end, tuple(order)))
                for place, k in enumerate(order):
                    load[k] += size * (rounds + (place < rest))
                at = end
            else:  # the first fold takes groups until the second comes before it
                second = order[1]
                gap = load[second] - load[first]
                n = min(end - at, max(1, -(-gap // size) if first > second else gap // size + 1) if size else end - at)
                out.append((size, at, at + n, (first,)))
                load[first] += n * size
                at += n
    return out


def balanced_folds(sizes: DataFrame, group: str, n: str, folds: int, tie: Column | None = None) -> DataFrame:
    """``(group, n, fold)`` of ``sizes (group, n)``: largest first into the least loaded fold, the lowest of several. Groups of equal size go by
    ``tie``, then by name as text. Fewer groups than folds are an error."""
    rows = sizes.select(group, F.col(n).cast("bigint").alias(n))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy(n).count().collect()}  # a row for each distinct size
    if sum(counts.values()) < folds:
        raise ValueError(f"{sum(counts.values())} groups cannot fill {folds} folds")
    before, total = {}, 0
    for size in sorted(counts, reverse=True):
        before[size], total = total, total + counts[size]
    runs = rows.sparkSession.createDataFrame([(s, before[s] + a, before[s] + b, list(order)) for s, a, b, order in dealt(counts, folds)], "_size bigint, _first bigint, _end bigint, _order array<int>")
    keyed = rows.withColumns({"_back": -F.col(n), "_tie": tie if tie is not None else F.lit(0), "_name": F.col(group).cast("string")})
    placed = numbered(keyed, ["_back", "_tie", "_name"], "_at")
    met = placed.join(runs, (F.col(n) == F.col("_size")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end")))
    return met.select(group, n, F.get("_order", ((F.col("_at") - F.col("_first")) % F.size("_order")).cast("int")).alias("fold"))


def holdout_and_folds(sizes: DataFrame, group: str, n: str, share: float, folds: int, seed: int) -> DataFrame:
    """``(group, n, fold)``: drawn groups go to the holdout, fold -1, until it has its share of rows, as long as more than ``folds`` groups are left;
    the others to balanced folds."""
    stage = Stage(sizes.sparkSession, "groups")
    keyed = stage.put(sizes.select(group, F.col(n).cast("bigint").alias(n), draw(seed, group).alias("_draw"), F.col(group).cast("string").alias("_name")))
    total, groups = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    t = running(keyed.withColumn("_one", F.lit(1)), ["_draw", "_name"], n, "_rows")
    t = stage.put(numbered(t, ["_draw", "_name"], "_at").withColumn("_out", (F.col("_rows") < share * total) & (groups - F.col("_at") > folds)))
    rest = balanced_folds(t.where("NOT _out"), group, n, folds)
    return t.where("_out").select(group, n, F.lit(-1).alias("fold")).unionByName(rest)


def whole_groups(sizes: DataFrame, group: str, n: str, most: int, seed: int) -> DataFrame:
    """``(group, n)``: drawn groups of at most ``most`` together; one that would pass it is skipped, not split.

    Each round takes all groups up to the first that does not fit what is left, which is then smaller than that group: rounds are at
    most as many as there are distinct sizes.
    """
    stage = Stage(sizes.sparkSession, "groups")
    left = sizes.select(group, F.col(n).cast("bigint").alias(n), draw(seed, group).alias("_draw"), F.col(group).cast("string").alias("_name"))
    taken, room = [], most
    while True:
        now = stage.put(running(left.where(F.col(n) <= room), ["_draw", "_name"], n, "_before"))
        stop = now.where(F.col("_before") + F.col(n) > room).agg(F.min(F.struct("_draw", "_name"))).first()[0]
        at = F.struct("_draw", "_name")
        fits = now if stop is None else now.where(at < F.struct(F.lit(stop[0]).alias("_draw"), F.lit(stop[1]).alias("_name")))
        taken.append(fits.select(group, n))
        if stop is None:
            break
        room -= fits.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
        left = now.where(at > F.struct(F.lit(stop[0]).alias("_draw"), F.lit(stop[1]).alias("_name"))).drop("_before")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionAll(t)
    return out
