"""Which tokens of two tokenizers cover the same bytes, and how often the corpus holds each pair.

A link is a pair of tokens, one of each tokenizer, whose byte ranges overlap. Documents are aligned once and their links staged. Pairs
are packed into one int64, the second tokenizer's id in the upper half. Each partition counts its own pairs (``np.unique``); the
partial counts are sorted over the whole corpus by ranges of the key, and each range adds up its runs of equal keys and writes two flat
files, keys and counts, into the shared folder. Documents then look their pairs up in these shards, which are mapped into memory, by
``searchsorted``. What passes the driver is a row for each shard and one number for each id of the second vocabulary.

Both tokenizers end a token at every safe place (``chunks``), so a document is the sum of its stretches between them, and a
worker aligns each distinct stretch once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm._rows import SLICE
from cairn.llm.chunks import json_layout, json_tokenizer, piece_layout, piece_processor, stretches
from cairn.llm.token_counts import balanced
from cairn.plans.staging import Stage

BATCH_CHARS = 2_000_000
#: Stretches are forgotten beyond so many characters and numbers of 4 bytes.
KEPT = 40_000_000
#: Distinct pairs that a task counts before it hands them on.
HELD = 4_000_000
#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_decoder() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 characters are themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Grown:
    """A NumPy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class ByteTokens:
    """Tokens of a byte-level ``.json`` file. Where its merges stand in the order of their ids, and the bytes come first, ids are ranks, and the
    quicker of the two public libraries reads many texts as one; otherwise each text goes to the file's own library."""

    def __init__(self, path: str):
        self.own = json_tokenizer(path)
        self.own.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        decoder, vocab = byte_decoder(), self.own.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(decoder[c] for c in piece) if all(c in decoder for c in piece) else piece.encode()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranked = all(len(self.bytes[i]) == 1 for i in range(256)) and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
        self.fast = None
        if json_layout(path) == "bytes" and ranked:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.bytes[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each of which begins with a space, one after the other, and how many each has."""
        if self.fast is None or any(t[-1].isspace() for t in texts):
            ids = [self.fast.encode_ordinary(t) if self.fast else self.own.encode(t, add_special_tokens=False).ids for t in texts]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n
        ids = np.array(self.fast.encode_ordinary("".join(texts)), np.int64)  # a word begins where a text does
        size = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        return ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)


class Aligner:
    """Alignments of stretches: token numbers, groups as text and packed links, under a number for each distinct stretch.

    The first file is of the ``tokenizers`` library and byte-level, the second of ``sentencepiece``. A stretch whose tokens do not give back
    its bytes is marked; it spoils the document it stands in. Files of a layout not known to be safe are given whole texts.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), piece_processor(b_path)
        self.cut = json_layout(a_path) == "bytes" and piece_layout(b_path)
        self.a_bytes = self.a.bytes
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # an id as it is written within its group, and at the end of its side of the group
        self.names = [[f"{i}{end}" for i in range(len(x))] for x, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for end in (",", last)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.groups: list[str | None] = []  # each group with a semicolon behind it; None marks a stretch whose bytes differ
        self.counts = Grown(np.dtype((np.int32, 4)))  # tokens of each side, groups, links
        self.keys, self.at = Grown(np.int64), Grown(np.int64)  # links of all stretches, and where each one's begin

    def split(self, text: str) -> list[str]:
        return stretches(text) if self.cut else [text]

    def numbers(self, own: list[str]) -> np.ndarray:
        """Number of each stretch; new ones are aligned."""
        k = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        missed = np.flatnonzero(k < 0).tolist()
        if missed:
            new = list(dict.fromkeys(own[i] for i in missed))
            loose = [s for s in new if not s or s[-1].isspace()]  # they cannot stand before others
            if loose:
                new = [s for s in new if s and not s[-1].isspace()]
            for some in (new, loose):
                for i, j in balanced([len(s) for s in some], BATCH_CHARS):
                    self.learn(some[i:j])
            k[missed] = [self.known[own[i]] for i in missed]
        return k

    def learn(self, new: list[str]) -> None:
        spaced = [" " + s for s in new]
        raw = [s.encode() for s in spaced]
        a, n_a = self.a(spaced)
        ids = self.b.encode(new, num_threads=1)
        n_b = np.fromiter(map(len, ids), np.int64, len(new))
        b = np.fromiter(chain.from_iterable(ids), np.int64, int(n_b.sum()))
        good = np.ones(len(new), bool)
        for own, n, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            parts = [table[i] for i in own.tolist()]
            if b"".join(parts) != b"".join(raw) or not self.cut:
                ends = np.cumsum(n).tolist()
                good &= [b"".join(parts[i:j]) == r for i, j, r in zip([0, *ends], ends, raw)]
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        # all stretches as one long text: ends of tokens in bytes; each piece of bytes between ends is one link
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_end, b_end)
        ia, ib = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        shared = np.flatnonzero((a_end[ia] == ends) & (b_end[ib] == ends)) if len(ends) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(new)), n_a)[ia] if len(ends) else ia
        n_links, n_groups = np.bincount(owner, minlength=len(new)), np.bincount(owner[shared], minlength=len(new))
        first = len(self.groups)
        self.at.add(self.keys.n + np.cumsum(n_links) - n_links)
        self.keys.add(b[ib] << 32 | a[ia])
        self.counts.add(np.stack([n_a, n_b, n_groups, n_links], axis=1))
        # tokens in the order they are written: by group, the first side before the second
        group = [np.searchsorted(x[shared], np.arange(len(y))) for x, y in ((ia, a), (ib, b))]
        last = [np.isin(np.arange(len(y)), x[shared]) for x, y in ((ia, a), (ib, b))]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable").tolist()
        made = [self.names[2 * side + end][i] for side, x in enumerate((a, b)) for i, end in zip(x.tolist(), last[side].tolist())]
        made = [made[i] for i in order]
        cuts = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(made[i:j]) if ok else None for ok, i, j in zip(good.tolist(), [0, *cuts], cuts)]
        self.known.update(zip(new, range(first, first + len(new))))
        self.size += sum(map(len, new)) + 30 * len(new) + 2 * len(ends) + 6 * len(made)

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed links of these stretches one after the other, and how many each has."""
        n = self.counts.data[numbers, 3].astype(np.int64)
        ends = np.cumsum(n)
        return self.keys.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at.data[numbers] - ends + n, n)], n


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, so that a task finds what earlier tasks aligned."""
    return Aligner(a_path, b_path)


def numbered_texts(of: Aligner, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, numbers, owners)`` for ranges of texts that hold about a batch of characters together: the numbers of their
    stretches and the text of each, without texts that are null, empty or spoilt."""
    for i, j in balanced([len(t or "") for t in texts], BATCH_CHARS):
        split = [of.split(t) if t else [] for t in texts[i:j]]
        numbers = of.numbers(list(chain.from_iterable(split)))
        owners = np.repeat(np.arange(j - i), [len(s) for s in split])
        if None in (groups := of.groups):
            bad = np.fromiter((groups[k] is None for k in numbers.tolist()), bool, len(numbers))
            fine = ~np.isin(owners, owners[bad])
            numbers, owners = numbers[fine], owners[fine]
        yield i, j, numbers, owners


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of ``n`` over each."""
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(n[order], first) if len(keys) else n


def packed(a_ids: int, b_ids: int) -> np.dtype:
    """How a staged link is written: two unsigned numbers, the first id and the second."""
    return np.dtype(("<u2" if max(a_ids, b_ids) <= 1 << 16 else "<u4", 2))


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups_sha256, links[, groups])`` of ``docs (id, text)``; ``links``: packed pairs in order."""
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *(["groups"] if groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        kind = packed(len(of.a_bytes), len(of.b_bytes))
        for part in slices(batches):
            if of.size > KEPT:
                of.forget()
            texts = part.column(1).to_pylist()
            for i, j, numbers, owners in numbered_texts(of, texts):
                made = np.zeros((j - i, 4), np.int64)
                for c, values in enumerate(of.counts.data[numbers].T):
                    made[:, c] = np.bincount(owners, values, minlength=j - i)
                bounds, own = np.searchsorted(owners, np.arange(j - i + 1)).tolist(), numbers.tolist()
                written = ["".join([of.groups[k] for k in own[a:b]])[:-1] for a, b in zip(bounds, bounds[1:])]
                sha = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                keys = of.links(numbers)[0]
                raw = np.stack([keys & 0xFFFFFFFF, keys >> 32], axis=1).astype(kind.base).tobytes()
                ends = (np.cumsum(made[:, 3]) * kind.itemsize).tolist()
                links = pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), *(pa.array(np.ascontiguousarray(c)) for c in made.T), pa.array(sha, pa.string()), links, *([pa.array(written, pa.string())] if groups else [])], names=["id", *names])

    kinds = ["bigint"] * 4 + ["string", "binary", "string"]
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def keys_of(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Packed int64 keys of the staged links of a batch of rows, one after the other."""
    ids = np.frombuffer(b"".join(column.to_pylist()), kind.base).reshape(-1, 2).astype(np.int64)
    return ids[:, 1] << 32 | ids[:, 0]


def partial_counts(links: DataFrame, kind: np.dtype) -> DataFrame:
    """``(key, n)``: links of each pair in each partition of ``links (links)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["key", "n"])

        for part in slices(batches):
            keys, n = np.unique(keys_of(part.column(0), kind), return_counts=True)
            held = summed(np.concatenate([held[0], keys]), np.concatenate([held[1], n.astype(np.int64)]))
            if len(held[0]) > HELD:
                yield out()
                held = (held[0][:0], held[1][:0])
        yield out()

    return links.mapInArrow(run, "key bigint, n bigint")


class Shared:
    """Flat files below a folder that all tasks reach: a mounted one by its path, any other by the file systems that Arrow knows."""

    def __init__(self, root: str):
        url = urlparse(root)
        self.mounted = url.scheme in ("", "file")
        self.fs, self.root = (pa.fs.LocalFileSystem(), url.path) if self.mounted else pa.fs.FileSystem.from_uri(root)

    def writer(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}")

    def read(self, name: str) -> np.ndarray:
        """Its int64 numbers, mapped into memory where the folder is mounted."""
        if self.mounted:
            return np.memmap(f"{self.root}/{name}", np.int64, "r")
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return np.frombuffer(f.read_buffer(), np.int64)


def write_shards(partial: DataFrame, root: str) -> DataFrame:
    """Sorts partial counts by ranges of the key and writes a shard for each range: ``(name, low, high, ids, tops)``.

    ``ids`` and ``tops``: each upper half (second id) of the shard and its highest count there. A task streams over its sorted rows and writes
    files of a name of its own, so one that is run again or twice leaves files that nobody reads, never a half one in use.
    """
    sorted_ = partial.repartitionByRange("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files, low, high, ids, tops = uuid.uuid4().hex, [], None, None, [], []
        last = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # a run that may go on

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal low, high
            if not len(keys):
                return
            if not files:
                shared = Shared(root)
                files.extend(shared.writer(f"{name}.{x}") for x in ("keys", "counts"))
                low = int(keys[0])
            high = int(keys[-1])
            files[0].write(keys.tobytes())
            files[1].write(n.tobytes())
            b = keys >> 32
            first = np.flatnonzero(np.diff(b, prepend=b[0] - 1))
            ids.append(b[first])
            tops.append(np.maximum.reduceat(n, first))

        for batch in batches:
            keys, n = (np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns))
            if len(keys):
                keys, n = summed(keys, n)
                put(keys[:-1], n[:-1])
                last = keys[-1:], n[-1:]
        put(*last)
        for f in files:
            f.close()
        if files:
            yield pa.RecordBatch.from_pylist([{"name": name, "low": low, "high": high, "ids": np.concatenate(ids), "tops": np.concatenate(tops)}], schema=schema)

    schema = pa.schema([("name", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.list_(pa.int64())), ("tops", pa.list_(pa.int64()))])
    return sorted_.mapInArrow(run, "name string, low bigint, high bigint, ids array<bigint>, tops array<bigint>")


class PairCounts:
    """The counts of all pairs: shards in a shared folder, and the highest count of each second id."""

    def __init__(self, partial: DataFrame, root: str, b_ids: int):
        self.root = root
        rows = sorted(write_shards(partial, root).collect(), key=lambda r: r["low"])  # a row for each shard; ids of one vocabulary
        self.names, self.low = [r["name"] for r in rows], np.array([r["low"] for r in rows], np.int64)
        self.top = np.zeros(b_ids, np.int64)
        for r in rows:
            np.maximum.at(self.top, r["ids"], r["tops"])

    def open(self) -> None:
        """In a task, before the first look-up."""
        shared = Shared(self.root)
        self.shards = [None] * len(self.names)
        self.load = lambda i: (shared.read(f"{self.names[i]}.keys"), shared.read(f"{self.names[i]}.counts"))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which some shard has."""
        out = np.zeros(len(keys), np.int64)
        bounds = [*np.searchsorted(keys, self.low).tolist(), len(keys)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                if self.shards[i] is None:
                    self.shards[i] = self.load(i)
                at, counts = self.shards[i]
                out[a:b] = counts[np.searchsorted(at, keys[a:b])]
        return out

    def table(self, spark) -> DataFrame:
        """``(a, b, n)`` of all pairs, read from the shards by tasks."""
        here = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here.open()
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    keys, n = here.load(i)
                    for s in range(0, len(keys), 1 << 16):
                        k = np.array(keys[s : s + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array(k & 0xFFFFFFFF), pa.array(k >> 32), pa.array(np.array(n[s : s + (1 << 16)]))], names=["a", "b", "n"])

        return spark.range(0, len(self.names), numPartitions=max(1, len(self.names))).mapInArrow(run, "a bigint, b bigint, n bigint")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row, and ``groups`` itself if wished.

    ``a_path``, a byte-level file of the ``tokenizers`` library, reads a space and the text; ``b_path``, a ``.model`` file of pieces, the text. Both
    without special tokens: strings of such are plain text. Groups are cut where tokens of both end at one byte,
    written ``a1,a2|b1;a3|b2,b3``. ``count_sum`` adds over the links how many links of the corpus hold the same pair of ids, ``n_best``
    counts those whose pair is the most frequent of its second id, ties included.

    A null or empty text, and one whose bytes the tokens of either side do not give back, has zeros and an empty string. Texts of
    any length are aligned whole. Repeated rows and ids count each, null ids stay. An empty table gives no rows; other columns
    of ``docs`` are not read, whatever their names.
    """
    return Alignment(docs, a_path, b_path, id_col, text_col, groups).table()


class Alignment:
    """An aligned table and the counts of its pairs; both are in the shared folder."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False):
        self.id_col, self.groups = id_col, groups
        self.kind = packed(max(json_tokenizer(a_path).get_vocab().values()) + 1, b_ids := piece_processor(b_path).vocab_size())
        stage = Stage(docs.sparkSession, "alignment")
        self.rows = stage.put(aligned(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), a_path, b_path, groups))
        partial = stage.put(partial_counts(self.rows.select("links"), self.kind))
        self.counts = PairCounts(partial, f"{stage.root}/shards", b_ids)
        stage.drop(partial)

    def table(self) -> DataFrame:
        counts, kind = self.counts, self.kind
        kept = [f for f in self.rows.schema.fields if f.name != "links"]
        src = self.rows.select(*(f.name for f in kept), "links")
        names = [f.name for f in kept]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts.open()
            for part in slices(batches):
                distinct, back = np.unique(keys_of(part.column("links"), kind), return_inverse=True)
                count = counts.of(distinct)
                best = count == counts.top[distinct >> 32]
                ends = np.concatenate([[0], np.cumsum(part.column("n_links").to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(x[back].astype(np.int64))]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums)], names=[*names, "n_best", "count_sum"])

        made = src.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL("n_best bigint, count_sum bigint").fields]))
        return made.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if self.groups else [])).withColumnRenamed("id", self.id_col)
