"""Ranked search of documents by the terms of a query, with exact integer scores.

``build`` makes an inverted index: every input partition cuts its documents into shards of about ``SHARD_TERMS`` terms and writes a row for
each term of a shard (document numbers and frequencies) and a row for each shard (ids and lengths). ``search`` reads from it the lists of
the queries' terms, brings those of a shard together, and ranks every query there:

* Each list is cut into blocks of variable length. Dynamic programming picks the boundaries that minimise the bound error, the sum
  over postings of block maximum less own score, plus ``BLOCK_COST`` for each block, exactly over all cuts at multiples of ``GRAIN``
  postings and blocks of ``SPAN`` grains at most.
* Between two boundaries of any of a query's lists the sum of the block maxima bounds every score. Stretches are visited by falling
  bound, in waves that grow; once ``k`` documents are known, stretches below the ``k``-th score are skipped unread.
* Within a wave lists go by falling maximum. As in WAND, documents are found only through lists down to the pivot, beyond which all
  lists together stay below the ``k``-th score; in the others documents still in reach are looked up.

Nothing is estimated: a skipped document cannot be among the first ``k``, so the shards' first ``k`` hold the corpus's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._rows import SLICE, free_names
from cairn.operators.joins import numbered
from cairn.plans.staging import Stage

SHARD_TERMS = 4_000_000
#: Queries whose terms and weights travel to the tasks together.
QUERY_BLOCK = 1000
GRAIN, SPAN = 8, 32
#: What one block more costs, in average scores of the list.
BLOCK_COST = 8.0
#: Documents that the first wave visits.
FIRST_WAVE = 256

#: Bytes that are in no term become spaces, capital letters their lower case; all other bytes stay.
IN_TERM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
TO_TERMS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in IN_TERM else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, in order, A-Z lower-cased."""
    return (text or "").encode().translate(TO_TERMS).split()


class Index:
    """``lists (shard, term, docs array<int>, tf array<int>)`` and ``shards (shard, ids, lengths)``; document numbers follow the ids."""

    def __init__(self, lists: DataFrame, shards: DataFrame, id_col: str):
        self.lists, self.shards, self.id_col = lists, shards, id_col


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> Index:
    """An index of all terms of every row, as tables in the shared folder. A shard is closed by its number of terms, so its size has a
    bound but for one very long text."""
    src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    id_type, ints = src.schema["id"].dataType, T.ArrayType(T.IntegerType())
    schema = T.StructType().add("shard", "long").add("term", "binary").add("docs", ints).add("tf", ints).add("ids", T.ArrayType(id_type)).add("lengths", ints)
    i32 = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, numbers = [], [], []
        known: dict[bytes, int] = defaultdict(count().__next__)
        held = 0

        def lists(offsets, values) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, known
            if not lengths:
                return
            all_ids, length = pa.concat_arrays(ids), np.array(lengths, np.int64)
            order = pc.sort_indices(all_ids, null_placement="at_end").to_numpy() if not pa.types.is_nested(all_ids.type) else np.arange(len(all_ids))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys = np.concatenate(numbers) * len(order) + np.repeat(place, length)  # term, then document
            keys, tf = np.unique(keys, return_counts=True)
            term, doc = keys // len(order), (keys % len(order)).astype(np.int32)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            words, shard = list(known), part << 32 | made
            for a in range(0, len(first), 1 << 14):
                b = min(len(first), a + (1 << 14))
                cuts = np.append(first, len(term))[a : b + 1]
                chosen = [words[i] for i in term[first[a:b]].tolist()]
                n, at = b - a, cuts - cuts[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(chosen, pa.binary()), lists(at, pa.array(doc[cuts[0] : cuts[-1]])), lists(at, pa.array(tf[cuts[0] : cuts[-1]].astype(np.int32))), pa.nulls(n, pa.list_(all_ids.type)), pa.nulls(n, i32)],
                    names=schema.names,
                )
            one = lambda x: lists([0, len(order)], x)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.binary()), pa.nulls(1, i32), pa.nulls(1, i32), one(all_ids.take(pa.array(order))), one(pa.array(length[order].astype(np.int32)))], names=schema.names)
            made, held, known = made + 1, 0, defaultdict(count().__next__)
            for x in (ids, lengths, numbers):
                x.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part_ids, texts = (c.slice(at, SLICE) for c in batch.columns)
                begin = 0
                for i, text in enumerate(texts.to_pylist()):
                    found = terms(text)
                    if held and held + len(found) > shard_terms:
                        ids.append(part_ids.slice(begin, i - begin))
                        yield from flush()
                        begin = i
                    lengths.append(len(found))
                    numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    held += len(found)
                ids.append(part_ids.slice(begin))
        yield from flush()

    rows = Stage(docs.sparkSession, "lexical").put(src.mapInArrow(run, schema))
    return Index(rows.where(F.col("term").isNotNull()).select("shard", "term", "docs", "tf"), rows.where(F.col("term").isNull()).select("shard", "ids", "lengths"), id_col)


def cut_blocks(f: np.ndarray, cost: float | None = None, grain: int = GRAIN, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """First posting and maximum of each block of a list with scores ``f``, by dynamic programming over grains.

    ``best[j]`` is the least bound error plus ``cost`` for each block over all ways to cut the first ``j`` grains.
    """
    n = len(f)
    starts = np.arange(0, n, grain)
    m = len(starts)
    top = np.maximum.reduceat(f, starts).astype(np.float64)
    if m == 1:
        return starts, top.astype(np.int64)
    cost = BLOCK_COST * float(f.mean()) if cost is None else cost
    ends = np.append(starts[1:], n)
    best, back = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for j in range(1, m + 1):
        i = np.arange(max(0, j - span), j)
        maxima = np.maximum.accumulate(top[i[0] : j][::-1])[::-1]
        total = best[i] + maxima * (ends[j - 1] - starts[i]) + cost  # the sum of the scores is the same for all cuts
        at = int(np.argmin(total))
        best[j], back[j] = total[at], i[at]
    cuts, j = [], m
    while j:
        j = int(back[j])
        cuts.append(j)
    first = starts[cuts[::-1]]
    return first, np.maximum.reduceat(f, first)


class Postings:
    """A term's list in a shard: document numbers, scores, and blocks with their first and last document and highest score."""

    def __init__(self, docs: np.ndarray, f: np.ndarray):
        self.docs, self.f = docs, f
        first, self.top = cut_blocks(f)
        self.low, self.high = docs[first], docs[np.append(first[1:], len(docs)) - 1]
        self.most = int(self.top.max())


def first_k(lists: list[tuple[int, Postings]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best, by falling score and rising document, of ``sum(weight * f)`` over the lists that hold a
    document; only scores above 0."""
    lists = sorted(((w, p) for w, p in lists if w * p.most > 0), key=lambda x: -x[0] * x[1].most)
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    # stretches between block boundaries, each with the sum of the maxima of the blocks that cover it
    edges = np.unique(np.concatenate([x for _, p in lists for x in (p.low, p.high + 1)]))
    change = np.zeros(len(edges), np.int64)
    for w, p in lists:
        np.add.at(change, np.searchsorted(edges, p.low), w * p.top)
        np.subtract.at(change, np.searchsorted(edges, p.high + 1), w * p.top)
    bound = np.cumsum(change)[:-1]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    rest = np.cumsum([0, *(w * p.most for w, p in lists[::-1])])[::-1]  # what lists i and on can add at most
    docs, scores, limit = none, none, 1
    visited, wave = 0, FIRST_WAVE
    sizes = np.diff(edges)
    while visited < len(order):
        take = int(np.searchsorted(np.cumsum(sizes[order[visited:]]), wave)) + 1
        chosen = np.sort(order[visited : visited + take])
        chosen = chosen[bound[chosen] >= limit]
        visited, wave = visited + take, 4 * wave
        if not len(chosen):
            break  # bounds only fall from here on
        # stretches that touch are one range; document numbers of the ranges, one after the other, have a place each
        joined = np.flatnonzero(edges[chosen[1:]] != edges[chosen[:-1] + 1])
        begin, end = edges[chosen[np.append(0, joined + 1)]], edges[chosen[np.append(joined, len(chosen) - 1)] + 1]
        width = end - begin
        shift = begin - np.cumsum(width) + width
        sums, pivot = np.zeros(int(width.sum()), np.int64), 0
        while pivot < len(lists) and rest[pivot] >= limit:  # down to the pivot a document may be new
            w, p = lists[pivot]
            a, b = np.searchsorted(p.docs, begin), np.searchsorted(p.docs, end)
            n = b - a
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1])) + np.repeat(a - ends + n, n)
            sums[p.docs[at] - np.repeat(shift, n)] += w * p.f[at]
            pivot += 1
        here = np.flatnonzero((sums > 0) & (sums + rest[pivot] >= limit))
        found, sums = here + np.repeat(shift, width)[here], sums[here]
        for i in range(pivot, len(lists)):
            w, p = lists[i]
            at = np.minimum(np.searchsorted(p.docs, found), len(p.docs) - 1)
            sums = sums + np.where(p.docs[at] == found, w * p.f[at], 0)
            near = sums + rest[i + 1] >= limit
            found, sums = found[near], sums[near]
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, sums])
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
        if len(docs) == k:
            limit = max(1, int(scores[-1]))
    return docs, scores


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of that length, before the term's weight."""
    m = 75 + 25 * length * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, rank int, id, score long)``: for each row of ``items`` its ``k`` best documents with a score above 0, fewer if there are fewer.

    With N documents that have a term, L their terms, df documents that hold a term, a term weighs ``floor(1000 ln((2N + 2) / (2df + 1)))``;
    an occurrence count tf in a document of n terms is worth ``1e9 tf div (1000 tf + 12 m)``, m = 75 + 25 n N div L. A score
    is the sum of the products over the item's terms, repeats included. Equal scores go by ascending id, null ids last.

    Null, empty and wordless texts have no terms: such documents are in no ranking, such items have no rows. Texts of any length count
    whole. Repeated rows and ids of documents are documents of their own, repeated items are ranked each. An empty table
    on either side gives no rows; other columns are not read, whatever their names.
    """
    spark = items.sparkSession
    stage = Stage(spark, "search")
    n_docs, n_terms = index.shards.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    (qid,) = free_names(items, "query")
    rows = stage.put(numbered(items.select(items[f"`{item_col}`"].alias("item"), items[f"`{text_col}`"].alias("text")), ["item", "text"], qid))

    def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = np.unique(np.array(terms(text), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found.tolist(), pa.binary()), pa.array(n)], names=["q", "term", "n"])

    asked = stage.put(rows.select(F.col(qid).alias("q"), "text").mapInArrow(own_terms, "q bigint, term binary, n bigint"))
    df = index.lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = stage.put(asked.join(df, "term").select("q", "term", (F.col("n") * weight).alias("w")).where("w > 0"))
    last = rows.agg(F.max(qid)).first()[0]
    found = None
    for block in range(ceil((last + 1) / QUERY_BLOCK) if last is not None else 0):
        part = _search_block(index, weighed.where((F.col("q") >= block * QUERY_BLOCK) & (F.col("q") < (block + 1) * QUERY_BLOCK)), int(n_docs), int(n_terms), k)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], T.StructType().add("q", "long").add("id", index.shards.schema["ids"].dataType.elementType).add("score", "long"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select(F.col(qid).alias("q"), "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(index.id_col), "score")


def _search_block(index: Index, weighed: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(q, id, score)``: the first ``k`` of each shard for the queries of one block. Weights of a block's terms go to every task; lists meet
    their shard's row by the shard's number."""
    by_query: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for q, term, w in weighed.collect():  # QUERY_BLOCK queries at most
        by_query[q].append((bytes(term), w))
    ids = index.shards.schema["ids"].dataType
    wanted = index.lists.join(F.broadcast(weighed.select("term").distinct()), "term", "left_semi")
    schema = T.StructType().add("q", "long").add("id", ids.elementType).add("score", "long")

    def run(lists: pa.Table, shard: pa.Table) -> pa.Table:
        made_q, made_doc, made_score = [], [], []
        if shard.num_rows and lists.num_rows:
            length = shard.column("lengths").combine_chunks().flatten().to_numpy().astype(np.int64)
            known = {}
            for batch in lists.to_batches():
                docs, tf = (batch.column(c) for c in ("docs", "tf"))
                cuts = docs.offsets.to_numpy()
                all_docs, all_tf = (x.values.to_numpy().astype(np.int64) for x in (docs, tf))
                f = impact(all_tf[cuts[0] : cuts[-1]], length[all_docs[cuts[0] : cuts[-1]]], n_docs, n_terms)
                for i, term in enumerate(batch.column("term").to_pylist()):
                    known[term] = Postings(all_docs[cuts[i] : cuts[i + 1]], f[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]])
            for q, own in by_query.items():
                docs, scores = first_k([(w, known[t]) for t, w in own if t in known], k)
                made_q.append(np.full(len(docs), q))
                made_doc.append(docs)
                made_score.append(scores)
        pick = np.concatenate(made_doc) if made_doc else np.zeros(0, np.int64)
        all_ids = shard.column("ids").combine_chunks().flatten() if shard.num_rows else pa.nulls(0, shard.schema.field("ids").type.value_type)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (made_q, made_score)]
        return pa.Table.from_arrays([pa.array(columns[0]), all_ids.take(pa.array(pick)), pa.array(columns[1])], names=["q", "id", "score"])

    return wanted.groupBy("shard").cogroup(index.shards.withColumnRenamed("shard", "number").groupBy("number")).applyInArrow(run, schema)
