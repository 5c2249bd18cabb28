"""Whole groups out of sorted streams of rows: what a grouped map does, without its cost for each group.

Rows are dealt by their keys, sorted, and read batch by batch; a group is cut out where the keys change. A task holds one batch and the
group that it is in, however many groups it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that a task yields, at least, but for the last.
ROWS = 20_000
Columns = dict[str, np.ndarray]


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before it."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _columns(parts: list[pa.RecordBatch], names: Sequence[str]) -> Columns:
    get = lambda c: pa.chunked_array([p.column(c) for p in parts]).to_numpy() if len(parts) > 1 else parts[0].column(c).to_numpy(zero_copy_only=False)
    return {c: get(c) for c in names}


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, Columns]]:
    """``(key, columns)`` of each group of a stream in which equal keys follow each other. Nulls of numbers are NaN."""
    held: list[pa.RecordBatch] = []
    key_of = lambda b, i: tuple(b.column(k)[i].as_py() for k in keys)
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and key_of(batch, 0) == now:
            held.append(batch.slice(0, starts[1] if len(starts) > 1 else batch.num_rows))
            starts = starts[1:]
        if not len(starts):
            continue
        if held:
            yield now, _columns(held, batch.schema.names)
        whole = _columns([batch], batch.schema.names)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield key_of(batch, a), {c: v[a:b] for c, v in whole.items()}
        held, now = [batch.slice(starts[-1])], key_of(batch, int(starts[-1]))
    if held:
        yield now, _columns(held, held[0].schema.names)


def collected(made: Iterator[tuple[tuple, Columns]], keys: Sequence[str], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of ``schema``: its first columns are the keys, one value for each group, the others are the groups' columns."""
    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow][len(keys) :]
    held: list[tuple[tuple, Columns]] = []
    rows = 0

    def batch() -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(held)), [len(c[names[0]]) for _, c in held]))
        out = [pa.array([k[i] for k, _ in held], arrow.field(i).type).take(of) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*out, *(pa.array(np.concatenate([c[n] for _, c in held]), arrow.field(n).type) for n in names)], schema=arrow)

    for key, columns in made:
        held.append((key, columns))
        rows += len(columns[names[0]])
        if rows >= ROWS:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """By a hash of our own: a shuffle by the keys themselves is left out by Spark over a union whose sides are dealt by them already, and
    adaptive execution then merges the partitions of each side apart."""
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[tuple, Columns], Columns], schema: str) -> DataFrame:
    """``run(key, columns)`` of each group, its rows in this order. ``schema``: the keys first, then the columns that ``run`` makes."""
    kind = T.StructType.fromDDL(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collected(((k, run(k, c)) for k, c in groups(batches, keys)), keys, kind)

    return _dealt(rows, keys, order).mapInArrow(stream, kind)


def with_curves(series: DataFrame, curves: DataFrame) -> DataFrame:
    """One stream of series and their curves ``well, TVT, GR``: a curve's rows have no ``row_number`` and come after the series'."""
    own = series.withColumns({"_side": F.lit(0), "_at": F.lit(None).cast("double"), "_value": F.lit(None).cast("double")})
    knots = curves.where("well IS NOT NULL").select("well", F.lit(1).alias("_side"), F.col("TVT").cast("double").alias("_at"), F.col("GR").cast("double").alias("_value"))
    return own.unionByName(knots, allowMissingColumns=True)


def by_series(both: DataFrame, keys: Sequence[str], run: Callable[[tuple, Columns, np.ndarray, np.ndarray], Columns], schema: str) -> DataFrame:
    """``run(key, columns, at, value)`` of each series of ``with_curves``, its rows in order of ``row_number``, with its curve's knots;
    curves without a series make nothing."""
    kind = T.StructType.fromDDL(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Columns]]:
        for key, c in groups(batches, keys):
            n = int(np.searchsorted(c["_side"], 1))
            if n:
                own = {k: v[:n] for k, v in c.items()}
                yield key, run(key, own | {"row_number": own["row_number"].astype(np.int64)}, c["_at"][n:], c["_value"][n:])

    stream = lambda batches: collected(each(batches), keys, kind)
    return _dealt(both, keys, ["_side", "row_number", "_at", "_value"]).mapInArrow(stream, kind)
