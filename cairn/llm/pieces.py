"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

No piece of the vocabulary goes on past a space mark into another word, so the best segmentation of a text is that of its
marked words in order. A batch's distinct words are sorted, which is a depth-first walk of their trie: each word
keeps the forward scores of the prefix it has in common with the word before and extends only the rest.

In a model file of unigram type the forward score of a prefix is the best sum of its pieces' log-probabilities. In one of BPE type
pieces are merged by rank, and a segmentation is that of the merges if and only if each pair of neighbouring pieces is: merges
inside a piece do not see what lies beyond its ends until one of them would cross an end, and a crossing shows in the pair alone.
So there the forward score is nought for the one last piece that goes with the prefix's own before it, and impossible for others; the
same walk of the trie finds it. The ids are the library's in both cases.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm._rows import map_text
from cairn.llm.tokens import crc32_of

MARK = "▁"
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: What a worker keeps of words and their ids between calls, and of pairs of pieces.
KEPT, PAIRS_KEPT = 12_000_000, 1_000_000
#: What an unknown character costs beyond the worst piece, as in the public library.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unk = sp.unk_id()
        score = {i: sp.get_score(i) for i in normal}
        #: Whether scores are merge ranks.
        self.merged = all(v <= 0 and v == int(v) for v in score.values())
        self.known = {self.text[i]: (i, v) for i, v in score.items()}
        self.unknown_score = min(s for _, s in self.known.values()) - UNKNOWN_PENALTY
        self.trie: dict = {}
        for piece, hit in self.known.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = hit
        #: What each piece adds to a text; bytes over 127 mean something together only.
        self.plain = [chr(self.of_byte[i]) if self.of_byte.get(i, 128) < 128 else x for i, x in enumerate(self.text)]
        self.high = {i for i, b in self.of_byte.items() if b > 127}
        self.goes: dict[int, bool] = {}
        self.runs: dict[int, tuple[bool, list, list, str, str]] = {}

    def run(self, pid: int) -> tuple[bool, list, list, str, str]:
        """How merging goes inside a piece: whether it ends in the piece; the merges that lie before each change of the last symbol,
        and of the first, as ``(score, symbol)`` for every merge in turn; and the last and first symbols at the start."""
        if (found := self.runs.get(pid)) is None:
            symbols, last, first = list(self.text[pid]), [], []
            ends = symbols[-1], symbols[0]
            while len(symbols) > 1:
                joined = [self.known.get(x + y) for x, y in zip(symbols, symbols[1:])]
                k = max((i for i, hit in enumerate(joined) if hit is not None), key=lambda i: (joined[i][1], -i), default=None)
                if k is None:
                    break
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                last.append((joined[k][1], symbols[-1]))
                first.append((joined[k][1], symbols[0]))
            found = self.runs[pid] = (len(symbols) == 1, last, first, *ends)
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces ends in these two: both go their ways, unless a merge across comes first."""
        key = left << 32 | right
        if (known := self.goes.get(key)) is not None:
            return known
        _, a, _, x, _ = self.run(left)
        _, _, b, _, y = self.run(right)
        i = j = 0
        none = (-math.inf, "")
        while True:
            mine, other = a[i] if i < len(a) else none, b[j] if j < len(b) else none
            across = self.known.get(x + y)
            if across is not None and across[1] > mine[0] and across[1] >= other[0]:  # of equal ones the leftmost goes first
                made = False
                break
            if mine is none and other is none:
                made = True
                break
            if mine[0] >= other[0]:
                i, x = i + 1, mine[1]
            else:
                j, y = j + 1, other[1]
        self.goes[key] = made
        return made

    def unknown(self, c: str) -> list[int]:
        """Ids for a character that is no piece: its bytes."""
        raw = c.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if self.byte else [self.unk]

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word of a sorted list of distinct words. Ties go to the longer last piece."""
        known, root, out, merged = self.known, self.trie, {}, self.merged
        best, back, alive = [0.0], [(0, 0)], [[]]  # by depth; alive: (start, trie node) of every piece that may still go on
        before = ""
        for w in words:
            k = 0
            for a, b in zip(w, before):
                if a != b:
                    break
                k += 1
            del best[k + 1 :], back[k + 1 :], alive[k + 1 :]
            for e in range(k, len(w)):
                c, top, frm, pid, on = w[e], None, 0, -1, []
                for s, node in [*alive[e], (e, root)]:
                    if (node := node.get(c)) is not None:
                        on.append((s, node))
                        if (hit := node.get("")) is None:
                            continue
                        if merged:
                            before_it = back[s][1] if s else -1
                            if top is None and (self.run(hit[0])[0] if before_it < 0 else self.neighbours(before_it, hit[0])):
                                top, frm, pid = 0.0, s, hit[0]
                        elif top is None or best[s] + hit[1] > top:
                            top, frm, pid = best[s] + hit[1], s, hit[0]
                if c not in known and (top is None or best[e] + self.unknown_score > top):
                    top, frm, pid = best[e] + self.unknown_score, e, -1
                best.append(top)
                back.append((frm, pid))
                alive.append(on)
            ids, e = [], len(w)
            while e:
                s, pid = back[e]
                if pid >= 0:
                    ids.append(pid)
                else:
                    ids.extend(reversed(self.unknown(w[s])))
                e = s
            ids.reverse()
            out[w] = ids
            before = w
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that marks the beginning is left out."""
        if self.high.isdisjoint(ids):
            plain = self.plain
            made = "".join([plain[i] for i in ids])
        else:
            of_byte = self.of_byte
            made = b"".join(bytes([of_byte[i]]) if i in of_byte else self.text[i].encode() for i in ids).decode("utf-8", "replace")
        return made.replace(MARK, " ")[1 if ids else 0 :]


class PieceEncoder:
    """Encodes batches of texts; keeps words and ids of the size ``KEPT`` and one batch's."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        made = self.pieces.segment(sorted(words))
        flat = np.fromiter((i for ids in made.values() for i in ids), np.int32)
        sizes = np.fromiter(map(len, made.values()), np.int64, len(made))
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(made) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(made)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(made)] = sizes
        self.used += len(flat)
        self.size += len(flat) + 16 * len(made) + sum(map(len, made))
        self.known.update(zip(made, range(n, n + len(made))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if self.size > KEPT:
            self.forget()
        if len(self.pieces.goes) > PAIRS_KEPT:
            self.pieces.goes.clear()
        words = [_MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := {w for ws in words for w in ws} - self.known.keys():
            self.learn(list(new))
        out = []
        for ws in words:
            w = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            size = self.length[w]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.at[w] - ends + size, size)])
        return out


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that a task finds what earlier tasks learned."""
    return PieceEncoder(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, n_ids, ids_crc32, decoded_sha256, exact)`` for every document.

    The ids are decoded again in the task: ``decoded_sha256`` is of that text and ``exact`` says whether it is the
    document's (it is not where a text holds the space mark itself, which decodes to a space; null: null text, no
    ids, exact). Empty tables give no rows; repeated rows and null ids are kept. Texts and words may be of any length; of
    equally good cuts of a word the library's is taken. Other columns of ``docs`` are not read, whatever their names.
    """

    def start():
        engine = piece_encoder(model_path)

        def do(texts: list) -> list:
            ids = engine.encode(texts)
            back = [engine.pieces.decode(x.tolist()) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            return [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([crc32_of(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back], pa.string()),
                pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()),
            ]

        return do

    return map_text(docs, [id_col], text_col, "ids array<int>, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean", start)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from ids; null ids give a null text, no ids an empty one. Repeated rows and null ids are kept, empty tables give no rows."""

    def start():
        pieces = Pieces(model_path)

        def do(rows: list) -> list:
            return [pa.array([None if r is None else pieces.decode(r) for r in rows], pa.string())]

        return do

    return map_text(encoded, [id_col], ids_col, "text string", start)
