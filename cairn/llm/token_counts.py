"""Numbers of tokens, by batch encoding in Arrow functions that return lengths only.

Long texts are cut at safe places, so that no call holds more than a batch of text, and batches are balanced by bytes: a call
gets as many sections as come to ``BATCH_BYTES``, be it one or thousands. Within a batch a section falls into the stretches
between its safe places; each distinct stretch is encoded once by the library, and only its length is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairn.llm.chunks import json_layout, json_tokenizer, piece_layout, piece_processor, sections, stretches

BATCH_BYTES = 1 << 20
#: Characters of a section of a long text.
SECTION = 1 << 18
#: Characters, and 50 more for each stretch, that a worker keeps between calls.
KEPT = 60_000_000


class Counter:
    """Token numbers of texts by the library of a ``.json`` or ``.model`` file. A file of unknown layout gets whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            processor = piece_processor(path)
            self.cut, self.lead = piece_layout(path), ""
            self.library = lambda texts: map(len, processor.encode(texts, num_threads=1))
        else:
            tokenizer = json_tokenizer(path)
            layout = json_layout(path)
            self.cut, self.lead = layout is not None, " " if layout == "bytes" else ""
            self.library = lambda texts: map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        self.known: dict[str, int] = {}
        self.size = 0

    def sections(self, text: str) -> list[str]:
        """Sections of a text; each but the first takes the space before it along where tokens do."""
        first, *rest = sections(text, SECTION) if self.cut else [text]
        return [first, *(self.lead + s for s in rest)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as int64."""
        if not self.cut:
            return np.fromiter(self.library(texts), np.int64, len(texts))
        if self.size > KEPT:
            self.known, self.size = {}, 0
        split = [stretches(t) for t in texts]
        if self.lead:
            split = [[first, *(self.lead + s for s in rest)] for first, *rest in split]
        flat = list(chain.from_iterable(split))
        n = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(n < 0).tolist()
        if missed:
            new = list(dict.fromkeys(flat[i] for i in missed))
            self.known.update(zip(new, self.library(new)))
            self.size += sum(map(len, new)) + 50 * len(new)
            n[missed] = [self.known[flat[i]] for i in missed]
        return np.add.reduceat(n, np.cumsum([0, *map(len, split[:-1])])) if split else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker, so that a task finds what earlier tasks counted."""
    return Counter(path)


def balanced(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose weights come to about the same, ``most`` at most; a heavier one is a range of its own."""
    begin, held = 0, 0
    for i, w in enumerate(weights):
        if i > begin and held + w > most:
            yield begin, i
            begin, held = i, 0
        held += w
    if begin < len(weights):
        yield begin, len(weights)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, start: Callable[[str], Counter] = counter) -> DataFrame:
    """``(id, n_bytes long, n_tokens long, over_limit boolean)`` for every row, by its whole text.

    No begin, end or added special tokens; special strings inside a text are what the library makes of them. A null or empty text
    has 0 bytes and 0 tokens. A text of any length is counted in sections cut at safe places; where it has none, or the file's
    layout is not known to be safe, it goes to the library whole. Repeated rows and ids are counted each, null ids stay, ``n_tokens``
    equal to the limit is not over it. An empty table gives no rows; other columns of ``docs`` are not read, whatever their names.
    """
    src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start(path)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n_bytes = pc.binary_length(column).cast(pa.int64())
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in balanced(n_bytes.to_pylist(), BATCH_BYTES):
                texts = column.slice(a, b - a).to_pylist()
                if b - a == 1 and len(texts[0]) > SECTION:  # one long text: its sections, a batch at a time
                    parts = of.sections(texts[0])
                    n_tokens[a] = sum(int(of.count(parts[i:j]).sum()) for i, j in balanced([len(p) for p in parts], BATCH_BYTES))
                else:
                    n_tokens[a:b] = of.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], names=["id", *names[1:]])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").toDF(*names)
