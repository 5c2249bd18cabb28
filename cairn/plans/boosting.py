"""Gradient boosting on histograms: binned features, trees grown leaf by leaf, every pass one aggregate over all rows.

Features are cut into at most ``bins`` bins once, and rows are staged as one byte for each feature. A pass sends every row down the
trees so far and adds its gradient to the histogram of its leaf, feature and bin, first within its partition and then by one Spark
aggregate; the driver sees only sums by leaf, feature and bin. A tree grows best-first: the leaf of largest gain is split next. A pass makes
the histograms of all leaves that may still be chosen, so that a tree takes as many passes as it is deep, not as it has leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.staging import Stage

#: The bin of missing values; the others are numbered from 0.
MISSING = 255
#: Predictions are staged anew after so many trees, so that a pass goes down a bounded number of them.
EVERY = 16


@dataclass
class Tree:
    """Nodes as lists: feature (-1: a leaf), last bin that goes left, whether missing values go left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int, missing_left: bool) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.last[node], self.missing_left[node], self.left[node], self.right[node] = feature, last, missing_left, n, n + 1
        for name, v in (("feature", -1), ("last", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).extend([v, v])
        return n, n + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins [row, feature]``."""
        feature, last, missing, left, right = (np.array(x) for x in (self.feature, self.last, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            k = at[inner]
            b = bins[inner, feature[k]]
            at[inner] = np.where(np.where(b == MISSING, missing[k], b <= last[k]), left[k], right[k])

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    """A fitted model: ``base`` plus the trees' values. ``edges``: for each feature the largest value of each bin but the last."""

    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(np.asarray(x, float))
        return self.base + sum((t(b) for t in self.trees), np.zeros(len(b)))

    def column(self, features: Sequence[str]) -> Column:
        """The prediction as a column over these feature columns, by Arrow batches."""
        model = self

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.column_stack([c.to_numpy(float) for c in columns])))

        return score(*(F.col(f).cast("double") for f in features))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j]))
    return out


def packed(bins: np.ndarray) -> pa.Array:
    """Rows of ``bins [row, feature]`` as binary values, without an object for each."""
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(bins))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """``bins [row, feature]`` of a column of ``packed`` rows, read in place."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(data, np.uint8, len(column) * width, int(start)).reshape(-1, width)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 255) -> list[np.ndarray]:
    """Upper ends of all bins but the last, by quantiles of each feature's values; a feature of few values has a bin for each."""
    share = [k / bins for k in range(1, bins + 1)]
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    got = rows.agg(*(F.percentile_approx(value(f), share, 20 * bins).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(q or [], float))[:-1] for q in got]


def best_split(g: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool]:
    """``(gain, feature, last bin, missing left)`` of the best split of a leaf with sums ``g`` and counts ``n``, ``[feature, bin]``; ties go to the first."""
    total, count = g[0].sum(), n[0].sum()
    best = (0.0, -1, 0, False)
    for missing_left in (False, True):
        gl, nl = np.cumsum(g[:, :MISSING], axis=1), np.cumsum(n[:, :MISSING], axis=1)
        if missing_left:
            gl, nl = gl + g[:, [MISSING]], nl + n[:, [MISSING]]
        gr, nr = total - gl, count - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (nl + l2) + gr**2 / (nr + l2) - total**2 / (count + l2)
        gain = np.where((nl >= least) & (nr >= least), gain, -np.inf)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] > best[0] + 1e-12:
            best = (float(gain[f, b]), int(f), int(b), missing_left)
    return best


def _histograms(rows: DataFrame, trees: list[Tree], tree: Tree, wanted: list[int], width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of ``prediction - target`` and counts of these leaves of ``tree``, ``[feature, bin]``."""
    place = {leaf: k for k, leaf in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros((len(wanted), width, 256)), np.zeros((len(wanted), width, 256), np.int64)
        for batch in batches:
            bins = unpacked(batch.column("bins"), width)
            gradient = batch.column("gradient").to_numpy() + sum((t(bins) for t in trees), np.zeros(len(bins)))
            leaf = np.array([place.get(k, -1) for k in range(len(tree.feature))])[tree.leaves(bins)]
            own = np.flatnonzero(leaf >= 0)
            base, weight = leaf[own] * 256, gradient[own]
            for j in range(width):
                at = base + bins[own, j]
                g[:, j] += np.bincount(at, weight, minlength=len(wanted) * 256).reshape(-1, 256)
                n[:, j] += np.bincount(at, minlength=len(wanted) * 256).reshape(-1, 256)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(g.ravel()[used]), pa.array(n.ravel()[used])], names=["at", "g", "n"])

    made = rows.select("bins", "gradient").mapInArrow(run, "at bigint, g double, n bigint").groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()  # leaves x features x bins
    g, n = np.zeros(len(wanted) * width * 256), np.zeros(len(wanted) * width * 256, np.int64)
    g[made["at"]], n[made["at"]] = made["g"], made["n"]
    return {leaf: (a, b) for leaf, a, b in zip(wanted, g.reshape(-1, width, 256), n.reshape(-1, width, 256))}


def grow(histograms, width: int, leaves: int, l2: float, rate: float, least: int) -> Tree:
    """A tree of at most ``leaves`` leaves, best-first. ``histograms(tree, leaves)`` gives the histograms of leaves of a tree.

    Splits are tried ahead on a tree of candidates: a pass asks for the leaves of the candidates that would come next; the tree itself takes
    splits in order of their gain as long as all that could come before them are known.
    """
    plan = Tree()
    sums, splits = {}, {}

    def learn(nodes: list[int]) -> None:
        for node, (g, n) in histograms(plan, nodes).items():
            sums[node] = (g[0].sum(), n[0].sum())
            splits[node] = best_split(g, n, l2, least)

    learn([0])
    while True:
        chosen, open_, unknown = [], [0], []
        while open_ and len(chosen) < leaves - 1:
            node = max(open_, key=lambda k: (splits[k][0], -k))
            if splits[node][1] < 0:
                break
            open_.remove(node)
            chosen.append(node)
            if plan.feature[node] < 0:
                unknown.append(node)  # its children are not known; what comes after it may change
            else:
                open_ += [plan.left[node], plan.right[node]]
        if not unknown:
            break
        learn([child for node in unknown for child in plan.split(node, *splits[node][1:])])
    out, where = Tree(), {0: 0}
    for node in chosen:
        made = out.split(where[node], *splits[node][1:])
        where |= dict(zip((plan.left[node], plan.right[node]), made))
    for node, k in where.items():
        if out.feature[k] < 0:
            g, n = sums[node]
            out.value[k] = float(-rate * g / (n + l2)) if n else 0.0
    return out


def fit(rows: DataFrame, features: Sequence[str], target: str, trees: int = 120, leaves: int = 15, rate: float = 0.05, l2: float = 0.0, least: int = 20, bins: int = 255) -> Boosted:
    """Squared error on all rows with a target. Null and NaN features are missing values, which go to the side where they gain more."""
    stage, width = Stage(rows.sparkSession, "boosting"), len(features)
    if not 2 <= bins <= MISSING:
        raise ValueError("between 2 and 255 bins")
    rows = rows.where(F.col(target).isNotNull()).select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("y"))
    base = rows.agg(F.avg("y")).first()[0]
    edges = bin_edges(rows, [f"x{i}" for i in range(width)], bins)
    if base is None:
        return Boosted(0.0, edges, [])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:width]])
            yield pa.RecordBatch.from_arrays([packed(binned(x, edges)), pa.array(base - batch.column(width).to_numpy())], names=["bins", "gradient"])

    now = stage.put(rows.mapInArrow(pack, "bins binary, gradient double"))
    made: list[Tree] = []
    fresh: list[Tree] = []  # those that the staged gradients do not have
    for _ in range(trees):
        tree = grow(lambda t, nodes: _histograms(now, fresh, t, nodes, width), width, leaves, l2, rate, least)  # noqa: B023
        if len(tree.feature) == 1:
            break  # no split gains anything, now or later
        made.append(tree)
        fresh.append(tree)
        if len(fresh) == EVERY and len(made) < trees:
            now, fresh = _moved(stage, now, fresh, width), []
    return Boosted(float(base), edges, made)


def _moved(stage: Stage, rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = unpacked(batch.column("bins"), width)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array(batch.column("gradient").to_numpy() + sum(t(bins) for t in trees))], names=["bins", "gradient"])

    out = stage.put(rows.mapInArrow(run, "bins binary, gradient double"))
    stage.drop(rows)
    return out
