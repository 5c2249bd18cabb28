"""Ids of a word-level public tokenizer, each distinct word encoded once.

The tokenizer splits a normalised text into words that it encodes one by one, so ids of a text are those of its
words in order. Texts of common Latin characters are split here by the same rules and their distinct words
go to the tokenizer; any other text goes to it whole. Both ways give the tokenizer's own ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

_PLAIN = range(0xA1, 0x250)
_ASCII = [chr(i) for i in range(0x20, 0x7F)]
_STABLE = [chr(i) for i in _PLAIN if unicodedata.normalize("NFC", chr(i)) == chr(i)]
#: A character counts only if its lower case is one character of the same range.
_CHARS = _ASCII + [c for c in _STABLE if c.lower() in _STABLE]
_LETTERS = "".join(c for c in _CHARS if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _CHARS if unicodedata.category(c)[0] == "N")
#: Characters of which both ways of splitting and lower-casing are known to agree.
_OTHER = re.compile(f"[^\t\n\r{re.escape(''.join(_CHARS))}]|<\\|")
#: The word pattern of the public vocabulary file.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: What a worker keeps of chunks and their ids between calls, in numbers and characters of 4 bytes or so.
KEPT = 16_000_000


class WordEncoder:
    """``path``: a file of the ``tokenizers`` library. Holds chunks and ids of the size ``KEPT`` and one call's.

    A chunk is what stands between white space; no word of the tokenizer crosses it. New chunks of a call go to the
    tokenizer as one text; in its vocabulary a word's last piece is marked, which tells whose ids are whose.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # pieces that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, chunks: list[str]) -> None:
        words = np.fromiter((len(_WORDS.findall(c)) for c in chunks), np.int64, len(chunks))
        made = self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0]
        ids = np.array(made.ids, dtype=np.uint32)
        stops = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        if len(stops) - 1 == words.sum():
            sizes = np.diff(stops[np.cumsum(words)], prepend=0)
        else:  # another tokenizer's words: each chunk goes to it alone
            alone = [m.ids for m in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            sizes = np.fromiter(map(len, alone), np.int64, len(alone))
            ids = np.fromiter(chain.from_iterable(alone), np.uint32, int(sizes.sum()))
        n, total = len(self.known), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(chunks) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.flat[self.used : self.used + total] = ids
        self.at[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(chunks)] = sizes
        self.used += total
        self.size += total + 16 * len(chunks) + sum(map(len, chunks))
        self.known.update(zip(chunks, range(n, n + len(chunks))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; none for null or empty ones."""
        if self.size > KEPT:
            self.forget()
        odd = [i for i, t in enumerate(texts) if t and _OTHER.search(t)]
        whole = dict(zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)))
        split = [[] if i in whole or not t else t.lower().split() for i, t in enumerate(texts)]
        flat = list(chain.from_iterable(split))
        k = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(k < 0).tolist()
        if missed:
            self.learn(list(dict.fromkeys(flat[i] for i in missed)))
            k[missed] = [self.known[flat[i]] for i in missed]
        size = self.length[k]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[k] - ends + size, size)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [np.array(whole[i].ids, dtype=np.uint32) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that a task finds what earlier tasks learned."""
    return WordEncoder(path)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
