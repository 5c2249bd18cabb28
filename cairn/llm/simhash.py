"""SimHash near-duplicates, verified through pivot distance tables.

Each fingerprint has its Hamming distances to many fixed reference fingerprints (the pivots). By the triangle
inequality two fingerprints whose distances to any pivot differ by more than ``max_bits`` cannot be near: rows are
sorted by the first pivot's distance and swept in windows of it, pairs apart in any other coordinate go, and only
survivors are compared bit by bit.

Random fingerprints lie 32 +- 4 bits from any pivot, so that one coordinate parts only 43 of 100 pairs and no cell of a few
coordinates is selective: tables alone would visit every pair of the corpus. What meets in one sweep is therefore chosen
by exact keys. A pair within ``max_bits`` agrees on at least ``t`` of ``max_bits + t`` blocks of the fingerprint, so a join
on every choice of ``t`` blocks brings all such pairs together; ``t`` grows with the number of fingerprints (``agreeing``),
which keeps the partners that a fingerprint meets by chance level. Results are the same for any ``t``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._rows import free_names, map_text, quoted
from cairn.operators.graph import connected_components
from cairn.plans.staging import Stage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 24
#: Rows of a bucket that one group holds; larger buckets are cut into chunks and each pair of chunks is a group.
CHUNK = 1024
#: A fingerprint is to meet about so many others by chance, over all keys.
CHANCE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(lo, hi)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, or all columns of a list in place of ``id``; ``fp`` holds the 64 bits as a signed long. Null and wordless
    texts have fingerprint zero. A row for every row, an empty table gives none."""

    def start():
        def do(texts: list) -> list:
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))]

        return do

    return map_text(docs, [id_col] if isinstance(id_col, str) else id_col, text_col, "fp bigint", start)


def agreeing(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks that a key holds, for ``n`` distinct fingerprints."""
    t = 2
    while comb(max_bits + t, t) * n / 2 ** (64 * t / (max_bits + t)) > CHANCE and t < 8:
        t += 1
    return t


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints, one row for each pivot."""
    refs = np.random.default_rng(7).integers(0, 2**64, pivots, dtype=np.uint64)
    return np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int8)


def _links(group: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Rows of equal ``group`` stand together. A spanning forest of each group's links, as row numbers."""
    dist, n, out = pivot_table(fps), len(fps), []
    order = np.lexsort((dist[0], group))
    dist, fps, group = dist[:, order], fps[order], group[order]
    root = np.arange(n)
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right")
    i = np.arange(n)
    for lag in range(1, n):
        i = i[i + lag < last[i]]
        i = i[dist[0, i + lag] - dist[0, i] <= max_bits]  # in order: once out of the window, always out
        if not len(i):
            break
        c = i
        for d in dist[1:]:
            c = c[np.abs(d[c] - d[c + lag]) <= max_bits]
            if not len(c):
                break
        c = c[np.bitwise_count(fps[c] ^ fps[c + lag]) <= max_bits]
        for x in c[root[c] != root[c + lag]].tolist():
            lo, hi = sorted((root[x], root[x + lag]))
            if lo != hi:
                out.append((int(order[x]), int(order[x + lag])))
                part = root[first[x] : last[x]]
                part[part == hi] = lo
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(src, dst)``: links that connect all ``fp`` within ``max_bits``, from distinct ``(fp, node)`` rows.

    Not every link is listed: within a bucket only a spanning forest is, which has the same components.
    """
    agree = agreeing(distinct.count(), max_bits)
    blocks = max_bits + agree
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(parts[i] for i in chosen)) for chosen in combinations(range(blocks), agree)]
    keyed = distinct.select("fp", "node", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "k"))
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
    rows = (
        keyed.join(shared, ["t", "k"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("t", "k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "node")
    )
    by = ["t", "k", "x", "y"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = pa.concat_tables([kept, here]) if kept is not None else here
            key = np.stack([here[c].to_numpy().astype(np.int64) for c in by])
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
            at = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch; it holds 2 * CHUNK rows or so
            kept = here.slice(at)
            if at:
                yield from one(here.slice(0, at), np.cumsum(new)[:at])
        if kept is not None and kept.num_rows > 1:
            yield from one(kept, np.zeros(kept.num_rows, np.int64))

    def one(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = t["node"].to_numpy()
        found = np.array(_links(group, t["fp"].to_numpy().view(np.uint64), max_bits), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], names=["src", "dst"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(find, "src bigint, dst bigint")


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, class)`` for every distinct ``fp``; equal ``class``: joined by links of ``max_bits`` or fewer."""
    distinct = Stage(fps.sparkSession, "simhash").put(fps.select("fp", F.col("fp").alias("node")).distinct())
    comps = connected_components(links(distinct, max_bits))
    return distinct.join(comps, "node", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)`` for every document; components join fingerprints by links of ``max_bits`` or fewer.

    Wordless and null texts share fingerprint zero and link like any other. Rows with a null id get a
    fingerprint but take no part in links; their component is null. Repeated ids are kept row by row. An
    empty table gives no rows. Exact copies meet in one aggregate and are never expanded into pairs. Texts of any length are
    read whole, a bit set in just half of the hashes is 0, and other columns of ``docs`` are not read, whatever their names.
    """
    stage = Stage(docs.sparkSession, "simhash")
    fps = stage.put(fingerprints(docs, id_col, text_col, shingle))
    distinct = stage.put(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node")))
    comps = connected_components(links(distinct, max_bits))
    named = distinct.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def _hashable(field: T.StructField) -> Column:
    """The column, as JSON where it holds what has no hash (maps, variants)."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(quoted(field.name).alias("c"))) if "map<" in kind or "variant" in kind else quoted(field.name)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class of fingerprints the row with the smallest id, with all its columns.

    Rows are told apart by id, text and the rest of their columns, never by the id alone: rows that share an id but not a text
    are documents of their own. Null ids come after all others and are deduplicated like them; null and wordless texts are
    one class. Of rows that are alike in every column one stays. An empty table gives no rows. ``docs`` may have any columns.
    """
    stage, own = Stage(docs.sparkSession, "simhash"), free_names(docs, "__id", "__text", "fp", "__rest")
    key_id, key_text, fp, rest = own
    keyed = docs.withColumns({key_id: F.col(id_col), key_text: F.sha2(F.coalesce(text_col, F.lit("")), 256), rest: F.xxhash64(*map(_hashable, docs.schema.fields))})
    fps = stage.put(fingerprints(keyed, [key_id, key_text, rest], text_col, shingle).toDF("id", "t", "rest", "fp"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t", "rest")
    each = stage.put(fps.groupBy("fp").agg(F.min(place).alias("best")))
    stay = each.join(classes(each, max_bits), "fp").groupBy("class").agg(F.min("best").alias("best")).select("best.*")
    stay = stay.select(F.col("id").alias(key_id), F.col("t").alias(key_text), F.col("rest").alias(rest))
    met = keyed.join(stay, keyed[key_id].eqNullSafe(stay[key_id]) & (keyed[key_text] == stay[key_text]) & (keyed[rest] == stay[rest]), "left_semi")
    # what is left is one row for each class, or a few that are alike in every column
    return met.withColumn(fp, F.row_number().over(Window.partitionBy(key_id, key_text, rest).orderBy(F.lit(1)))).where(F.col(fp) == 1).select(*(quoted(c) for c in docs.columns))
