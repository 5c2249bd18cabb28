"""A bounded sample of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.staging import Stage

#: A sample has at most so many characters, besides its bound in texts.
SAMPLE_CHARS = 30_000_000


def fitting(sizes: DataFrame, group: str, chars: int, order: list[str]) -> DataFrame:
    """The rows of ``sizes (n, ...)`` to read of each ``group``: in this order, as many as have ``chars`` characters together.

    Rows with over a quarter of that come last, so that none keeps those behind it out. Each group keeps its first row at least.
    """
    w = Window.partitionBy(group).orderBy(F.col("n") > chars // 4, *order)
    return sizes.withColumns({"so_far": F.sum("n").over(w), "nth": F.row_number().over(w)}).where((F.col("so_far") <= chars) | (F.col("nth") == 1)).drop("so_far", "nth")


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, bound: int, id_col: str, text_col: str, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``bound`` ``(text, label)`` rows of those where ``learn`` (on the id) holds: the lowest by a hash of the id.

    Of these whole texts are taken in the order of that hash until those of a label have half of ``chars`` characters; very long
    ones come last and displace none, and a label that has a text keeps one. An id counts once: its label is left out where
    its rows disagree, its text is the first of its texts. Null ids and labels other than 0 and 1 are not
    learned from; null texts are empty. Only the chosen ids, ``bound`` at most, are broadcast; other texts stay where they are.
    """
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    one = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    chosen = one.withColumn("draw", F.xxhash64("id", F.lit("labelled"))).orderBy("draw", "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "y", "draw").agg(F.min("t").alias("t"))
    texts = Stage(docs.sparkSession, "labelled").put(texts)
    sizes = texts.select("id", "y", "draw", F.length("t").cast("bigint").alias("n"))  # one row for each chosen id
    rows = texts.join(F.broadcast(fitting(sizes, "y", chars // 2, ["draw", "id"]).select("id")), "id").select("t", "y")
    return sorted((r[0], r[1]) for r in rows.collect())
