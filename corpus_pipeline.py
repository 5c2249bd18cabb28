"""A corpus pipeline of four stages over ``documents``: quality, toxicity, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept and returns a DataFrame; all but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import packing, quality, simhash, toxicity
from cairn.llm._rows import free_names, quoted
from cairn.llm.queries import fold, tokenizer_file
from cairn.plans.staging import Stage
from cairn.sources.tables import table


def _learn() -> Column:
    return F.coalesce(fold(5) != 0, F.lit(False))


def _judged(operator, spark: SparkSession, docs: DataFrame, sf_dir: str, keep) -> DataFrame:
    (name,) = free_names(docs, "__score")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    scored = operator.score(docs, table(spark, sf_dir, "labels"), _learn(), carry=rest, name=name)
    return scored.where(keep(F.col(name))).select(*(quoted(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the limit (a tie with it stays).

    Every row is judged on its whole text, however long, whatever its id; rows that are alike are judged alike and all stay
    or go. Null, empty and wordless texts score 0 and go. An empty table gives no rows. All columns come back as they
    were, extra ones too, whatever their names.
    """
    return _judged(quality, spark, docs, sf_dir, lambda s: s >= quality.LIMIT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the limit (a tie with it goes).

    Every row is judged on its whole text, however long, whatever its id; rows that are alike are judged alike. Null and empty
    texts hold no term and stay, an empty table gives no rows. All columns come back as they were, whatever their names.
    """
    return _judged(toxicity, spark, docs, sf_dir, lambda s: s < toxicity.LIMIT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id.

    Rows count by their text, not by their id: rows of one id with different texts are documents of their own. Null ids come
    last and are deduplicated like others; null, empty and wordless texts are one group. Of rows alike in every column
    one stays. An empty table gives no rows. All columns come back as they were, whatever their names.
    """
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences, by the columns of ``packing.pack``.

    A null or empty text is the end id alone; only texts over 2048 tokens are cut. Repeated rows and ids are documents of their
    own, null ids stay. An empty table gives no rows; extra columns are not read.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_quality), ("toxicity", drop_toxic), ("SimHash near-dedup", drop_near_duplicates), ("best-fit packing", pack)]

#: Trained models and greedy packing have no SQL form; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
