"""Arrow batches of texts through a Python function, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1000


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_text(df: DataFrame, keep: list[str], text: str, added: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The columns ``keep`` and those of the DDL string ``added``.

    ``start()`` runs once in a task and returns the function from a list of texts (None for null) to one
    Arrow array, or list, for each added column. Other columns of ``df`` are neither read nor returned; a text that is
    kept crosses once. Columns travel under plain names, so they may have any name and type that Arrow knows.
    """
    if clash := {c.lower() for c in keep} & {f.lower() for f in T.StructType.fromDDL(added).names}:
        raise ValueError(f"columns both kept and added: {', '.join(sorted(clash))}")
    read = [*keep, *([] if text in keep else [text])]
    src = df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(read)))
    place, new = read.index(text), T.StructType.fromDDL(added)
    schema = T.StructType([*src.schema.fields[: len(keep)], *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = do(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=schema.names)

    return src.mapInArrow(run, schema).toDF(*keep, *new.names)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
