"""Best-fit packing by residuals, in a hierarchy.

Every input partition cuts its documents into pieces and packs them best-fit decreasing. Bins that are nearly full are
final. The others rise as single items: round by round ``FAN_IN`` neighbouring partitions meet, best-fit their underfull bins
into each other, emit what has become nearly full, and pass on the rest, until one node is left.

Bins of equal fill are interchangeable, so a node of the tree holds counts by fill, at most ``capacity`` of them however many
bins rise, and packs whole runs of equal bins at a time. What it decides is a list of runs ("bins number 10 to 19 of
fill 700 go behind bins number 0 to 9 of fill 1300"); risen bins look up their new place in it round by round. Only bin numbers
and fills move, never tokens, and no task holds more than a node's counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._rows import SLICE
from cairn.llm.tokens import crc32_of, word_encoder
from cairn.plans.staging import Stage

CAPACITY = 2048
#: A bin is nearly full if at most so many tokens are free, in every round.
SLACK = 8
FAN_IN = 8
#: Pieces that a task holds at once.
HELD = 200_000


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin number and offset of each item, and the fill of each bin. Ties by position."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []  # bit r of rooms: some bin has exactly r tokens free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        by_room[room].append(b)
        rooms |= 1 << room
    return where, offset, np.array(fill, dtype=np.int64)


class Run:
    """``n`` bins alike: tokens free, and what stands in them as ``(size, first item, items in each bin, offset of the first)``."""

    def __init__(self, n: int, free: int, items: list[tuple[int, int, int, int]]):
        self.n, self.free, self.items = n, free, items

    def split(self, k: int) -> tuple[Run, Run]:
        """The first ``k`` bins and the rest."""
        return Run(k, self.free, self.items), Run(self.n - k, self.free, [(s, at + k * q, q, off) for s, at, q, off in self.items])

    def put(self, size: int, at: int, q: int, capacity: int) -> Run:
        """The same bins with ``q`` more items of ``size`` in each, numbered from ``at``."""
        return Run(self.n, self.free - q * size, [*self.items, (size, at, q, capacity - self.free)])


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing of ``counts[size]`` equal items for each size, the same bins as ``best_fit`` makes of them one by one.

    Steps and runs grow with the number of sizes, not with that of items: equal items fill the tightest bins one after the other, so
    a run of bins takes as many as fit in each, a last bin what remains.
    """
    open_: dict[int, list[Run]] = {}  # by free tokens
    rooms = 0

    def keep(run: Run) -> None:
        nonlocal rooms
        if run.n:
            open_.setdefault(run.free, []).append(run)
            rooms |= 1 << run.free

    for size in sorted(counts, reverse=True):
        at, left, made = 0, counts[size], []
        while left:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                run = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms ^= 1 << room
            else:
                room, run = capacity, Run(-(-left // (capacity // size)), capacity, [])
            q = room // size
            full = min(run.n, left // q)
            first, rest = run.split(full)
            if full:
                made.append(first.put(size, at, q, capacity))
                at, left = at + full * q, left - full * q
            if left and rest.n:
                one, rest = rest.split(1)  # fewer than q are left
                made.append(one.put(size, at, left, capacity))
                left = 0
            keep(rest)
        for run in made:
            keep(run)
    return [run for runs in open_.values() for run in runs]


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece: whole if it fits, else pieces of ``capacity`` and the rest."""
    return [(s, min(capacity, len(ids) - s)) for s in range(0, len(ids), capacity)]


def local_bins(docs: DataFrame, encoder: Callable[[], Callable[[list], list[np.ndarray]]], id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, off bigint, fill bigint, nth bigint" + (", ids array<bigint>" if keep_ids else "")
    end = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, bins, seen = encoder(), TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bins
            length = np.fromiter((r[3] for r in rows), np.int64, len(rows))
            where, off, fill = best_fit(length, capacity)
            order = np.argsort(fill, kind="stable")
            new = np.bincount(fill, minlength=capacity + 1)
            nth = np.empty(len(fill), np.int64)  # number of a bin among those of its fill in this partition
            nth[order] = np.arange(len(fill)) - (np.cumsum(new) - new)[fill[order]] + seen[fill[order]]
            seen[:] += new
            for at in range(0, len(rows), 20_000):
                own, s = list(zip(*rows[at : at + 20_000])), slice(at, at + 20_000)
                cols = [pa.array(own[0], src_type), pa.array(own[1], pa.int32()), pa.array(own[2], pa.int64()), pa.array(own[3], pa.int64()), pa.array(own[4], pa.int64())]
                cols += [pa.array(where[s] + (part << 32) + bins), pa.array(off[s]), pa.array(fill[where[s]]), pa.array(nth[where[s]])]
                cols += [pa.array([x.astype(np.int64) for x in own[5]], pa.list_(pa.int64()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=names)
            bins += len(fill)
            rows.clear()

        src_type = None
        for batch in batches:
            src_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for key, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for k, (s, n) in enumerate(cut(ids, capacity)):
                        rows.append((key, k, s, n, crc32_of(ids[s : s + n]), ids[s : s + n] if keep_ids else None))
                if len(rows) >= HELD:
                    yield from flush()
        if rows:
            yield from flush()

    names = [id_col, "piece", "start", "length", "ids_crc32", "bin", "off", "fill", "nth"] + ["ids"] * keep_ids
    return src.mapInArrow(run, schema)


STEP = "part bigint, fill bigint, lo bigint, hi bigint, shift bigint, size bigint, first bigint, q bigint, base bigint, to_part bigint, to_fill bigint, to_nth bigint, done boolean"


def _merge(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """One node: ``(part, fill, n)`` of its children to rows of ``STEP``.

    A child's bin ``lo <= nth < hi`` of ``fill`` is item ``nth + shift`` of its size in the node; items go ``q`` to a bin from item
    ``first`` on, behind ``base`` tokens, and bins are numbered from ``to_nth`` among those of the node that have ``to_fill`` tokens,
    or among all that are done.
    """
    to_part = int(pdf["node"].iloc[0])
    pdf = pdf.sort_values(["fill", "part"], ignore_index=True)
    ends = pdf.groupby("fill")["n"].cumsum().to_numpy()
    runs = best_fit_runs(pdf.groupby("fill")["n"].sum().to_dict(), capacity)
    children: dict[int, list[tuple[int, int, int]]] = {}
    for part, fill, n, end in zip(pdf["part"].tolist(), pdf["fill"].tolist(), pdf["n"].tolist(), ends.tolist()):
        children.setdefault(fill, []).append((part, end - n, end))
    rows, numbers, done_number = [], {}, 0
    for run in sorted(runs, key=lambda r: (r.free, r.items)):
        done, fill = last or run.free <= SLACK, capacity - run.free
        to = done_number if done else numbers.get(fill, 0)
        if done:
            done_number += run.n
        else:
            numbers[fill] = to + run.n
        for size, at, q, base in run.items:
            for part, lo, hi in children[size]:
                a, b = max(lo, at), min(hi, at + q * run.n)
                if a < b:
                    rows.append((part, size, a - lo, b - lo, lo, size, at, q, base, to_part, fill, to, done))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STEP.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``keep_ids`` the piece's ids.

    A null or empty text is the end id alone. Only documents over ``capacity`` tokens are cut. Repeated ids are
    separate documents; a null id is kept. Extra columns are not read. An empty table gives no rows. ``sequence_id`` is any
    number. Bins that are equally tight are taken in the order they were opened.
    """

    def encoder():
        return word_encoder(tokenizer_path).encode

    def merge(last: bool):
        return lambda pdf: _merge(pdf, capacity, last)

    stage = Stage(docs.sparkSession, "pack")
    pieces = stage.put(local_bins(docs, encoder, id_col, text_col, capacity, end_id, keep_ids))
    parts = (pieces.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1
    # bins on their way up: (bin, part, fill, nth) in the node where they are, base: the tokens before them there
    risen = pieces.where((F.col("off") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", F.shiftright("bin", 32).alias("part"), "fill", "nth", F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("bigint").alias("sequence"))
    key = [id_col, "piece", "start", "length", "ids_crc32"]
    risen = stage.put(risen)
    counts = risen.groupBy("part", "fill").agg(F.count("*").alias("n"))
    level, last = 0, False
    while not last:
        parts, level = -(-parts // FAN_IN), level + 1
        last = parts == 1
        nodes = counts.withColumn("node", F.floor(F.col("part") / FAN_IN).cast("bigint")).groupBy("node")
        steps = stage.put(nodes.applyInPandas(merge(last), STEP))
        item = F.col("nth") + F.col("shift") - F.col("first")
        at = F.col("to_nth") + F.floor(item / F.col("q")).cast("bigint")
        # a done bin's number: level, node and place, apart from those of bins that never rose
        number = F.lit(level << 56) + F.shiftleft("to_part", 32 + 3 * level) + at
        s = steps.select(*(F.col(c).alias(f"s_{c}") if c in ("part", "fill") else F.col(c) for c in steps.columns))
        on = (F.col("part") == F.col("s_part")) & (F.col("fill") == F.col("s_fill")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))
        base = F.col("base") + F.col("s_base") + item % F.col("q") * F.col("size")
        up = risen.where("sequence is null").join(s.withColumnRenamed("base", "s_base"), on)
        up = up.select("bin", F.col("to_part").alias("part"), F.col("to_fill").alias("fill"), at.alias("nth"), base.alias("base"), F.when(F.col("done"), number).alias("sequence"))
        risen = stage.put(risen.where("sequence is not null").unionByName(up))
        runs = steps.where("not done").groupBy("to_part", "to_fill").agg(F.max(F.col("to_nth") + F.floor((F.col("hi") - 1 + F.col("shift") - F.col("first")) / F.col("q")) + 1).cast("bigint").alias("n"))
        counts = runs.select(F.col("to_part").alias("part"), F.col("to_fill").alias("fill"), "n")
    moved = risen.select("bin", "base", "sequence")
    return pieces.join(moved, "bin", "left").select(*key, F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("off") + F.coalesce("base", F.lit(0))).alias("offset"), *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(..., keep_ids=True)``: ``(sequence_id, ids)``, each of at most the capacity."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
