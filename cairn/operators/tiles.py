"""Join of points in the plane by the product of their fingerprints: tiles of packed blocks, bounded before they are multiplied.

Points of a grid cell make a block; a crowded cell falls into blocks of like fingerprints. A block is one row: its points, their matrix,
the box they lie in, and a ball around the mean fingerprint. Only these summaries meet, cell by neighbouring cell, and a pair of
blocks goes on if its boxes are near enough and if a product of two members can reach the threshold: with means c, d and radii r, s it is
at most c.d + |c| s + |d| r + r s (Cauchy-Schwarz). What is left are tiles, each a matrix product in an Arrow task: a bound on heads
and tails of the fingerprints first, whole products only of pairs that pass.

Blocks are dealt to bands of bounded size, and all tiles of two bands are made in one task: a block travels once for each band that it meets, not
once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.plans.staging import Stage

#: Points of a block: a tile is at most so many by so many.
BLOCK = 512
#: Bytes of a band's fingerprints at most, beside one block; and bands at least, so that there are tasks enough.
BAND, BANDS = 24 << 20, 16
#: Links of two bands that are held before their spanning forest is taken.
HELD = 1 << 20
#: A crowded cell is cut by so many signs of its points' fingerprints at most.
SIGNS = 12
#: Components of the head of a fingerprint; the rest is bounded by its norm.
HEAD = 16


def rotation(size: int, seed: int = 5) -> np.ndarray:
    """A fixed orthogonal matrix. Heads of rotated fingerprints hold a like share of every fingerprint's norm."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` doubles; NaN where the array is null, of another length, or holds a null."""
    out = np.full((len(column), size), np.nan)
    good = np.flatnonzero(np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) == size)
    if len(good):
        out[good] = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return out


def blocks(points: DataFrame, key: str, x: str, y: str, prints: list[str], width: float, size: int) -> DataFrame:
    """A row for each block: ``block, cx, cy, n, x0, x1, y0, y1``, for each fingerprint ``mean_i, norm_i, radius_i``, and its points, packed."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    src = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *(F.col(c).cast("array<double>").alias(f"f{i}") for i, c in enumerate(prints)))
    src = src.where("key IS NOT NULL AND x - x = 0 AND y - y = 0").withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    turn = rotation(size)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.nan_to_num(_matrix(b.column("f0"), size)) @ turn[:, :SIGNS]
            code = (m > 0) @ (1 << np.arange(m.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64) << (SIGNS - m.shape[1]))], names=[*b.schema.names, "code"])

    coded = src.mapInArrow(signs, T.StructType([*src.schema.fields, T.StructField("code", T.LongType())]))
    stage = Stage(points.sparkSession, "tiles")
    coded = stage.put(coded)
    crowd = coded.groupBy("cx", "cy").agg(F.count("*").alias("crowd"))
    used = sum(((F.col("crowd") > F.lit(BLOCK << i)).cast("int") for i in range(SIGNS)), F.lit(0))  # signs that cut so many points into blocks
    named = coded.join(crowd, ["cx", "cy"]).withColumn("own", F.floor(F.col("code") / F.pow(F.lit(2), SIGNS - used)).cast("bigint"))
    alike = named.groupBy("cx", "cy", "own").agg(F.count("*").alias("alike"))
    named = named.join(alike, ["cx", "cy", "own"]).withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("alike") / BLOCK)))
    k = len(prints)
    fields = "cx bigint, cy bigint, own bigint, part bigint, n bigint, x0 double, x1 double, y0 double, y1 double" + "".join(f", mean{i} array<double>, norm{i} double, radius{i} double" for i in range(k))
    schema = T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("keys", T.ArrayType(src.schema["key"].dataType)), T.StructField("at", T.BinaryType()), *(T.StructField(f"m{i}", T.BinaryType()) for i in range(k))])

    def pack(group: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = np.stack([t["x"].to_numpy(), t["y"].to_numpy()])
        row = {**dict(zip(("cx", "cy", "own", "part"), (g.as_py() for g in group))), "n": t.num_rows, "x0": at[0].min(), "x1": at[0].max(), "y0": at[1].min(), "y1": at[1].max(), "at": at.tobytes()}
        for i in range(k):
            m = _matrix(t[f"f{i}"].chunk(0), size) @ turn
            fine = m[np.isfinite(m).all(1)]
            mean = fine.mean(0) if len(fine) else np.zeros(size)
            far = np.sqrt(((fine - mean) ** 2).sum(1).max()) if len(fine) else -np.inf  # no member, no product
            row |= {f"mean{i}": mean, f"norm{i}": float(np.linalg.norm(mean)), f"radius{i}": float(far), f"m{i}": m.tobytes()}
        rest = pa.Table.from_pylist([row], schema=pa.schema([f for f in arrow if f.name != "keys"]))
        keys = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t["key"].chunk(0))
        return pa.Table.from_arrays([keys if f.name == "keys" else rest[f.name] for f in arrow], names=arrow.names)

    arrow = to_arrow_schema(schema)
    return stage.put(named.groupBy("cx", "cy", "own", "part").applyInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))


def bands(found: DataFrame, size: int) -> DataFrame:
    """``(block, band)``: blocks in order of their cells, cut where the points so far fill a band."""
    order = ["cx", "cy", "own", "part"]
    ranged = Stage(found.sparkSession, "bands").put(found.select("block", *order, "n").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_sum"))  # one row for each range
    every = Window.orderBy("_range")
    sizes = sizes.select("_range", (F.sum("_sum").over(every) - F.col("_sum")).alias("_before"))
    total = ranged.agg(F.sum("n")).first()[0] or 0
    most = max(1, min(BAND // (8 * size), -(-total // BANDS)))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_range").select("block", F.floor((F.col("_own") + F.col("_before")) / most).cast("int").alias("band"))


def pairs_of_blocks(found: DataFrame, prints: int, far: float, threshold: float, near: float = -1.0) -> DataFrame:
    """``(block_a, block_b)`` of the pairs that may hold a link, each pair once, a block with itself too. Within ``near`` all points link."""
    own = found.drop("keys", "at", *(f"m{i}" for i in range(prints)))
    b = own.select(*(F.col(c).alias(f"b_{c}") for c in own.columns))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = own.withColumn("o", F.explode(around)).withColumns({"b_cx": F.col("cx") + F.col("o.i"), "b_cy": F.col("cy") + F.col("o.j")}).drop("o")
    met = a.join(b, ["b_cx", "b_cy"]).where("block <= b_block")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"{c}1"))
    apart = F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))
    reach = []
    for i in range(prints):
        dot = F.aggregate(F.zip_with(f"mean{i}", f"b_mean{i}", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        most = dot + F.col(f"norm{i}") * F.col(f"b_radius{i}") + F.col(f"b_norm{i}") * F.col(f"radius{i}") + F.col(f"radius{i}") * F.col(f"b_radius{i}")
        empty = (F.col(f"radius{i}") < 0) | (F.col(f"b_radius{i}") < 0)
        reach.append(F.when(empty, F.lit(False)).otherwise(most * 1.000001 + 1e-9 >= threshold))
    any_ = reach[0]
    for r in reach[1:]:
        any_ = any_ | r
    slack = 1.000001
    return met.where(((apart <= far * slack) & any_) | (apart <= near * slack)).select(F.col("block").alias("block_a"), F.col("b_block").alias("block_b"))


def tile(at: tuple, prints: tuple, same: bool, near: float, far: float, threshold: float) -> tuple[np.ndarray, ...]:
    """Row, column, distance and product of the links of two blocks; of a block with itself only above the diagonal. Pairs within ``near``
    are links whatever their product, NaN if they have none."""
    (xa, ya), (xb, yb) = at
    dist = np.sqrt((xa[:, None] - xb[None]) ** 2 + (ya[:, None] - yb[None]) ** 2)
    may, close = dist <= far, dist <= near
    if same:
        above = np.triu(np.ones(dist.shape, bool), 1)
        may &= above
        close &= above
    reach = np.zeros(dist.shape, bool)
    for a, b in prints:
        head = min(HEAD, a.shape[1])
        rest = [np.sqrt((m[:, head:] ** 2).sum(1)) for m in (a, b)]
        reach |= a[:, :head] @ b[:, :head].T + rest[0][:, None] * rest[1] + 1e-9 >= threshold  # NaN bounds nothing and links nothing
    i, j = np.nonzero((may & reach) | close)
    corr = np.full(len(i), np.nan)
    for a, b in prints if len(i) else ():
        if len(i) * 8 > len(a) * len(b):
            with np.errstate(invalid="ignore"):
                product = (a @ b.T)[i, j]
        else:
            product = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 8192]], b[j[s : s + 8192]]) for s in range(0, len(i), 8192)])
        corr = np.fmax(corr, np.where(np.isfinite(product), product, np.nan))
    pick = (corr >= threshold) | close[i, j]
    return i[pick], j[pick], dist[i, j][pick], corr[pick]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of a minimum spanning forest's edges among the edges ``a[i]-b[i]``, nodes being small numbers."""
    parent = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for e in np.argsort(weight, kind="stable").tolist():
        p, q = root(int(a[e])), root(int(b[e]))
        if p != q:
            parent[q] = p
            kept.append(e)
    return np.array(kept, np.int64)


def similar_pairs(points: DataFrame, key: str, x: str, y: str, prints: list[str], near: float, far: float, threshold: float, size: int, forests: bool = False) -> DataFrame:
    """``(a, b, dist, corr)``, ``a < b``: pairs within ``near``, and pairs within ``far`` with a product of at least the threshold.

    ``corr`` is the larger of the products of the fingerprints ``prints``, arrays of ``size`` numbers; one that is null, of another length
    or not finite has none, and ``corr`` is null where neither has. Points without a key or a finite place make no pair; of repeated keys every row
    counts, but not with its own kind. With ``forests`` two bands give only the spanning forests of their pairs by product and of their near
    pairs by distance: any cut of them connects what the same cut of all the pairs connects.
    """
    stage = Stage(points.sparkSession, "similar")
    found = blocks(points, key, x, y, prints, far, size)
    k = len(prints)
    band = stage.put(bands(found, size * k))
    of = lambda s: band.select(F.col("block").alias(f"block_{s}"), F.col("band").alias(f"band_{s}"))
    met = pairs_of_blocks(found, k, far, threshold, near).join(of("a"), "block_a").join(of("b"), "block_b")
    met = stage.put(met.select(F.least("band_a", "band_b").alias("low"), F.greatest("band_a", "band_b").alias("high"), "block_a", "block_b"))
    needed = met.select("low", "high", F.explode(F.array("block_a", "block_b")).alias("block")).distinct()
    packed = found.select("block", "keys", "at", *(f"m{i}" for i in range(k)))
    rows = needed.join(packed, "block").withColumnRenamed("block", "block_a").unionByName(met, allowMissingColumns=True)
    kind = points.schema[key].dataType
    schema = T.StructType().add("a", kind).add("b", kind).add("dist", "double").add("corr", "double")
    arrow = to_arrow_schema(schema)

    def links(held: dict, a: int, b: int) -> pa.RecordBatch:
        (keys_a, at_a, m_a), (keys_b, at_b, m_b) = held[a], held[b]
        i, j, dist, corr = tile((at_a, at_b), tuple(zip(m_a, m_b)), a == b, near, far, threshold)
        ends = [keys_a.take(pa.array(i)), keys_b.take(pa.array(j))]
        return pa.RecordBatch.from_arrays([*ends, pa.array(dist), pa.array(corr, from_pandas=True)], schema=arrow)

    def thinned(made: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(made, arrow).combine_chunks()
        if not t.num_rows:
            return []
        n = t.num_rows
        nodes = pa.concat_arrays([t["a"].chunk(0), t["b"].chunk(0)]).dictionary_encode().indices.to_numpy()
        dist, corr = t["dist"].to_numpy(), t["corr"].to_numpy()
        kept = []
        for own, weight in ((np.flatnonzero((dist <= far) & (corr >= threshold)), -corr), (np.flatnonzero(dist <= near), dist)):
            kept.append(own[forest(nodes[:n][own], nodes[n:][own], weight[own])])
        return t.take(pa.array(np.unique(np.concatenate(kept)))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made, rows = None, {}, [], 0  # two bands, their blocks, and their links where forests are asked for
        for batch in batches:
            low, high, a, b = (batch.column(c).to_pylist() for c in ("low", "high", "block_a", "block_b"))
            for r in range(batch.num_rows):
                if (low[r], high[r]) != now:
                    yield from thinned(made) if made else ()
                    now, held, made, rows = (low[r], high[r]), {}, [], 0
                if b[r] is None:
                    m = tuple(np.frombuffer(batch.column(f"m{i}")[r].as_py()).reshape(-1, size) for i in range(k))
                    held[a[r]] = batch.column("keys")[r].values, np.frombuffer(batch.column("at")[r].as_py()).reshape(2, -1), m
                    continue
                found = links(held, a[r], b[r])
                if not forests:
                    yield found
                elif found.num_rows:
                    made.append(found)
                    rows += found.num_rows
                    if rows > HELD:
                        made = thinned(made)
                        rows = HELD // 2 if sum(p.num_rows for p in made) > HELD // 2 else sum(p.num_rows for p in made)
        yield from thinned(made) if made else ()

    dealt = rows.repartition(F.xxhash64("low", "high")).sortWithinPartitions("low", "high", F.col("block_b").asc_nulls_first(), "block_a")
    out = dealt.mapInArrow(run, schema).where("a <> b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist", "corr")
