"""Embedding near-duplicates by int8 tile products with rigorous quantisation bounds.

A unit vector ``u`` is coded once as ``s * q`` with ``q`` int8, and what rounding left out as ``t * p`` with ``p`` int8 again; the lengths
of both approximations and of what they miss are measured, not assumed. For two vectors ``|u.v - c.d| <= |c| r' + |d| r + r r'`` where ``c``
and ``d`` are the coded vectors and ``r``, ``r'`` what they miss. Tiles are products of the first codes (exact in float32 while
``127^2 dim < 2^24``): a pair whose product plus bound stays below the threshold cannot link, one whose product less bound reaches
it must. What lies between is looked at with both codes, and pairs that are still open, a few in a hundred thousand, are recomputed
from the full vectors in double precision. Only codes are shuffled, a quarter of the doubles.

Vectors have homes, the nearest of some centroids. If ``v`` and ``w`` link, their angle is at most ``theta``, so ``w``'s home is at most
``theta`` farther from ``v`` than from ``w``, and that at most ``theta`` farther than ``v``'s own home: ``v`` visits only the homes within its
home's angle plus ``2 theta``, and pairs of homes that nobody visits are never multiplied. Crowded homes are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import connected_components
from cairn.plans.staging import Stage

THRESHOLD = 0.9
#: Vectors that a block has at most, give or take; a task holds two blocks.
BLOCK = 16_384
#: Homes: one for so many vectors, and at most so many; their centroids are broadcast.
HOME, HOMES = 8192, 1024
STRIP = 1024
#: Numbers that the second look holds at a time.
LOOK = 8_000_000
_CODED = "rep bigint, mult bigint, dim int, home int, visits array<int>, codes binary, s double, a double, r double, t double, a2 double, r2 double"


def _spread(x: np.ndarray) -> np.ndarray:
    """What is the length of each row, a little more in case of rounding."""
    return np.linalg.norm(x, axis=1) * (1 + 1e-9) + 1e-12


def quantise(unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """First codes, scales, lengths of the coded vectors and of what they miss; then codes and scales of what is missed, and both lengths anew."""
    s = np.abs(unit).max(1) / 127.0
    q = np.rint(unit / s[:, None]).astype(np.int8)
    first = q * s[:, None]
    t = np.maximum(np.abs(unit - first).max(1) / 127.0, 1e-300)
    p = np.rint((unit - first) / t[:, None]).astype(np.int8)
    both = first + p * t[:, None]
    return q, s, _spread(first), _spread(unit - first), p, t, _spread(both), _spread(unit - both)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one; first by a power of two, so that no length overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def homes(unit: np.ndarray, centroids: np.ndarray | None, theta: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home of each vector and the homes it visits."""
    if centroids is None:
        return np.zeros(len(unit), np.int32), [np.zeros(1, np.int32)] * len(unit)
    angle = np.arccos(np.clip(unit @ centroids.T, -1, 1))
    home = angle.argmin(1)
    reach = angle[np.arange(len(unit)), home] + 2 * theta + 1e-6
    return home.astype(np.int32), [np.flatnonzero(row).astype(np.int32) for row in angle <= reach[:, None]]


class Block:
    """Codes of one block as matrices."""

    def __init__(self, t: pa.Table):
        self.rep, self.mult = t["rep"].to_numpy(), t["mult"].to_numpy()
        self.s, self.a, self.r, step, self.a2, self.r2 = (t[c].to_numpy() for c in ("s", "a", "r", "t", "a2", "r2"))
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int8).reshape(len(self.rep), -1)
        dim = codes.shape[1] // 2
        self.q = codes[:, :dim]
        self.both = self.q * self.s[:, None] + codes[:, dim:] * step[:, None]


def tile_links(x: Block, y: Block, same: bool, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of ``x`` and ``y`` whose cosine reaches the threshold, or may (third array false); ``same``: i < j only."""
    kind = np.float32 if 127 * 127 * x.q.shape[1] < 2**24 else np.float64
    fy = np.ascontiguousarray(y.q.astype(kind).T)
    for at in range(0, len(x.rep), STRIP):
        s = slice(at, min(len(x.rep), at + STRIP))
        widest = x.r[s] * y.a.max() + x.a[s] * y.r.max() + x.r[s] * y.r.max()
        floor = (threshold - widest - 1e-9) / x.s[s]
        floor = np.where(floor > 0, floor / y.s.max(), floor / y.s.min())
        made = x.q[s].astype(kind) @ fy
        hit = np.flatnonzero(made >= np.floor(floor)[:, None].astype(kind))
        some = max(1, LOOK // x.q.shape[1])
        for k in range(0, len(hit), some):
            i, j = np.divmod(hit[k : k + some], len(y.rep))
            near = made[i, j].astype(np.float64)
            i += at
            near *= x.s[i] * y.s[j]
            bound = x.r[i] * y.a[j] + x.a[i] * y.r[j] + x.r[i] * y.r[j] + 1e-9
            may = near + bound >= threshold
            if same:
                may &= i < j
            i, j, near, bound = i[may], j[may], near[may], bound[may]
            sure = near - bound >= threshold
            open_ = np.flatnonzero(~sure)
            a, b = i[open_], j[open_]
            closer = np.einsum("ij,ij->i", x.both[a], y.both[b])
            bound = x.r2[a] * y.a2[b] + x.a2[a] * y.r2[b] + x.r2[a] * y.r2[b] + 1e-11
            sure[open_] = closer - bound >= threshold
            keep = np.ones(len(i), bool)
            keep[open_] = closer + bound >= threshold
            if keep.any():
                yield i[keep], j[keep], sure[keep]


def join_roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hooks the roots of linked rows onto smaller ones, in place; the numbers of the links that did it, a forest."""
    used, at = [], np.flatnonzero(label[i] != label[j])
    while len(at):
        a, b = label[i[at]], label[j[at]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((lo, hi))
        first = np.concatenate([[True], np.diff(hi[order]) > 0])
        hook = order[first]  # each root hangs on its smallest neighbour, by one link
        parent = np.arange(len(label))
        parent[hi[hook]] = lo[hook]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label[:] = parent[label]
        used.append(at[hook])
        at = at[label[i[at]] != label[j[at]]]
    return np.concatenate([*used, np.zeros(0, np.int64)]).astype(np.int64)


def multiply(x: Block, y: Block, same: bool, threshold: float) -> pa.Table:
    """For one pair of blocks: rows ``(a, null, w)`` with the links of a, ``(a, b, null)`` for a spanning forest, and ``(a, b, 0)`` for pairs left open."""
    rep, mult = (x.rep, x.mult) if same else (np.concatenate([x.rep, y.rep]), np.concatenate([x.mult, y.mult]))
    shift = 0 if same else len(x.rep)
    degree, label, ends, open_ = np.zeros(len(rep), np.int64), np.arange(len(rep)), [], []
    for i, j, sure in tile_links(x, y, same, threshold):
        j = j + shift
        open_.append(np.stack([i[~sure], j[~sure]], 1))
        i, j = i[sure], j[sure]
        degree += np.bincount(i, mult[j], len(rep)).astype(np.int64) + np.bincount(j, mult[i], len(rep)).astype(np.int64)
        used = join_roots(label, i, j)
        ends.append(np.stack([i[used], j[used]], 1))
    linked = np.flatnonzero(degree)
    e, o = (np.concatenate([*v, np.zeros((0, 2), np.int64)]).astype(np.int64) for v in (ends, open_))
    a = pa.array(np.concatenate([rep[linked], rep[e[:, 0]], rep[o[:, 0]]]), pa.int64())
    b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(np.concatenate([rep[e[:, 1]], rep[o[:, 1]]]), pa.int64())])
    w = pa.concat_arrays([pa.array(degree[linked], pa.int64()), pa.nulls(len(e), pa.int64()), pa.array(np.zeros(len(o), np.int64))])
    return pa.table({"a": a, "b": b, "w": w})


def _coded(distinct: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    theta = float(np.arccos(threshold))
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)  # HOMES vectors at most
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                own = batch.filter(pa.array(size == dim))
                for at in range(0, own.num_rows, 4096):
                    part = own.slice(at, 4096)
                    u = _unit(_matrix(part.column(2)))
                    q, s, a, r, p, t, a2, r2 = quantise(u)
                    home, visits = homes(u, shared.value.get(dim), theta)
                    codes = np.concatenate([q, p], axis=1)
                    cols = [part.column(0), part.column(1), np.full(len(u), dim, np.int32), home, pa.array(visits, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), s, a, r, t, a2, r2]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return distinct.select("rep", "mult", "v").mapInArrow(run, _CODED)


def _recomputed(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, ma, mb)`` of the pairs whose cosine in double precision reaches the threshold, with how many vectors each stands for."""
    side = lambda n: distinct.select(F.col("rep").alias(n), F.col("mult").alias(f"m{n}"), F.col("v").alias(f"v{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(4).value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                own = batch.filter(pa.array(size == dim))
                near = np.einsum("ij,ij->i", *(_unit(_matrix(own.column(c))) for c in (4, 5))) >= threshold
                yield own.select(["a", "b", "ma", "mb"]).filter(pa.array(near))

    return both.mapInArrow(run, "a bigint, b bigint, ma bigint, mb bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Rows whose vector is null, empty, zero or holds null or non-finite components, and rows with a null id,
    link with nothing: no links, their own component, kept (a null id: component null, not kept). Vectors
    of different lengths never link. Equal vectors are collapsed with their count before any tile is formed
    and count as links of each other. A pair right at the threshold links. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "embed")
    wide = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda e: e != 0)
    good = wide.where(F.coalesce(usable, F.lit(False)))
    distinct = stage.put(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    n = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("rep", F.lit("home"))).limit(min(HOMES, -(-n // HOME) or 1)).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    coded = stage.put(_coded(distinct, {d: _unit(np.array(v, dtype=np.float64)) for d, v in by_dim.items()}, threshold))
    sizes = coded.groupBy("dim", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = lambda home, k: F.col(home).cast("bigint") * F.lit(2**24) + k
    own = coded.join(sizes, ["dim", "home"]).withColumn("own", block("home", F.pmod(F.xxhash64("rep"), F.col("blocks")))).drop("blocks")
    to = sizes.select("dim", F.col("home").alias("visit"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    tiled = own.withColumn("visit", F.explode("visits")).join(to, ["dim", "visit"]).withColumn("other", block("visit", F.col("k")))
    tiled = tiled.select("dim", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "mult", "codes", "s", "a", "r", "t", "a2", "r2")

    def tile(table: pa.Table) -> pa.Table:
        a, b = table["x"][0].as_py(), table["y"][0].as_py()
        here = table["own"].to_numpy() == a
        left = table.filter(pa.array(here))
        right = left if a == b else table.filter(pa.array(~here))
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "w")})
        x = Block(left)
        return multiply(x, x if a == b else Block(right), a == b, threshold)

    found = stage.put(tiled.groupBy("dim", "x", "y").applyInArrow(tile, "a bigint, b bigint, w bigint"))
    late = stage.put(_recomputed(found.where("w = 0").select("a", "b"), distinct, threshold))
    comps = connected_components(found.where("w is null").select("a", "b").unionByName(late.select("a", "b")), "a", "b")
    counted = found.where("b is null").select("a", "w").unionAll(late.select("a", "mb")).unionAll(late.select("b", "ma"))
    degree = counted.groupBy("a").agg(F.sum("w").alias("w"))
    known = (
        distinct.join(degree, F.col("rep") == F.col("a"), "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select("v", (F.coalesce("w", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    linked = wide.withColumn("u", F.when(usable, F.col("v"))).join(known.withColumnRenamed("v", "kv"), F.col("u") == F.col("kv"), "left")
    home = F.coalesce("c", "id")
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), home.alias("component_id"), F.coalesce(F.col("id") == home, F.lit(False)).alias("kept"))
