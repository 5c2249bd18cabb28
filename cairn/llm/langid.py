"""Language identification by unigram piece models that sum over all segmentations.

For each language every piece of a fixed public vocabulary has a probability. The likelihood of a word is the sum,
over all ways to cut it into pieces, of the products of their probabilities, found by a forward pass; a text's is the
product over its words. Probabilities come from expectation maximisation on the words of a bounded sample of labelled
texts; scoring covers every word of every text, words of any length in one sum: the forward values are scaled as they go.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._labelled import fitting
from cairn.llm._rows import map_text
from cairn.plans.staging import Stage

#: The sample: about so many texts of each value of the language column, so many characters together, the same share for each.
TEXTS_PER_LANGUAGE = 500
SAMPLE_CHARS = 30_000_000
EM_ROUNDS = 3
#: What every piece of the vocabulary counts in every language beforehand, and a character that is no piece.
PRIOR = 0.05
UNKNOWN = 1e-7
#: Forward values are scaled anew after so many characters.
SCALE = 16
#: Characters of words that one lattice holds, padded to the longest; a longer word has its lattice in strips of so many.
CELLS, STRIP = 60_000, 4096
#: Log-likelihoods are divided by this before they become probabilities.
TEMPERATURE = 4.0
#: What a worker keeps of words between calls, in characters.
CHARS_KEPT = 6_000_000
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [p for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in [sp.id_to_piece(i)] if any(c.isalpha() for c in p) or p == MARK]


class Lattice:
    """All pieces in a list of words: arrays of word, start, end and piece (-1: a character that is no piece), by end.

    ``after``: pieces that end there or before are left out.
    """

    def __init__(self, words: list[str], index: dict[str, int], longest: int, after: int = 0):
        word, start, end, piece = [], [], [], []
        for k, w in enumerate(words):
            for s in range(len(w)):
                if w[s] not in index and s >= after:
                    word.append(k), start.append(s), end.append(s + 1), piece.append(-1)
                for e in range(max(s, after) + 1, min(len(w), s + longest) + 1):
                    p = index.get(w[s:e])
                    if p is not None:
                        word.append(k), start.append(s), end.append(e), piece.append(p)
        self.n, self.length, self.longest = len(words), np.array([len(w) for w in words], dtype=np.int64), longest
        order = np.argsort(np.array(end, dtype=np.int64), kind="stable")
        self.word, self.start, self.end, self.piece = (np.array(x, dtype=np.int64)[order] for x in (word, start, end, piece))
        self.last = int(self.length.max(initial=0))

    def mirrored(self) -> Lattice:
        """The same words from their ends."""
        out = object.__new__(Lattice)
        start, end = self.length[self.word] - self.end, self.length[self.word] - self.start
        order = np.argsort(end, kind="stable")
        out.n, out.length, out.longest, out.last = self.n, self.length, self.longest, self.last
        out.word, out.start, out.end, out.piece = self.word[order], start[order], end[order], self.piece[order]
        return out

    def forward(self, prob: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """``[word, position, language]``: log-probability of the word up to a position; row -1 of ``prob`` is for unknowns.

        ``known``: these of the first positions, where the word goes on from an earlier strip.
        """
        n_lang = prob.shape[1]
        begin = 0 if known is None else known.shape[1] - 1
        out = np.full((self.n, self.last + 1, n_lang), -np.inf)
        out[:, 0] = 0.0
        if known is not None:
            out[:, : begin + 1] = known
        cuts = np.searchsorted(self.end, np.arange(self.last + 2))
        for low in range(begin, self.last, SCALE):  # within a stretch values are relative to the largest before it
            back = max(0, low - self.longest + 1)
            top = out[:, back : low + 1].max(1)
            top = np.where(np.isfinite(top), top, 0.0)
            high = min(low + SCALE, self.last)
            f = np.zeros((self.n, high - back + 1, n_lang))
            f[:, : low - back + 1] = np.exp(out[:, back : low + 1] - top[:, None])
            for e in range(low + 1, high + 1):
                s = slice(cuts[e], cuts[e + 1])
                w = self.word[s]
                made = f[w, self.start[s] - back] * prob[self.piece[s]]
                for k in range(n_lang):
                    f[:, e - back, k] = np.bincount(w, made[:, k], self.n)
            with np.errstate(divide="ignore"):
                out[:, low + 1 : high + 1] = np.log(f[:, low - back + 1 :]) + top[:, None]
        return out

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece under one language's ``prob``, words counted by ``weight``."""
        f, b = self.forward(prob)[:, :, 0], self.mirrored().forward(prob)[:, :, 0]
        total = f[np.arange(self.n), self.length]
        share = f[self.word, self.start] + np.log(prob[self.piece, 0]) + b[self.word, self.length[self.word] - self.end] - total[self.word]
        share = np.exp(share) * weight[self.word]
        return np.bincount(self.piece[self.piece >= 0], share[self.piece >= 0], len(prob) - 1)


def batches(words: list[str]) -> list[list[str]]:
    """The words by length, as many together as fit ``CELLS``."""
    out: list[list[str]] = []
    for w in sorted(words, key=len):
        if out and (len(out[-1]) + 1) * (len(w) + 2) <= CELLS:
            out[-1].append(w)
        else:
            out.append([w])
    return out


class Model:
    """``prob``: ``[piece, language]`` with a last row for unknown characters."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.langs, self.prob = langs, prob
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.known: dict[str, int] = {}
        self.score, self.chars = np.zeros((0, len(langs))), 0

    def __reduce__(self):
        return Model, (list(self.index), self.langs, self.prob)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        if any(len(w) > STRIP for w in words):
            return np.stack([self.long_word(w) if len(w) > STRIP else self.words([w])[0] for w in words])
        lattice = Lattice([MARK + w for w in words], self.index, self.longest)
        return lattice.forward(self.prob)[np.arange(len(words)), lattice.length]

    def long_word(self, word: str) -> np.ndarray:
        """The same for a word of any length, a strip at a time: only the last positions of one are carried to the next."""
        w, known, done = MARK + word, np.zeros((1, 1, len(self.langs))), 0
        while done < len(w):
            first = done - (known.shape[1] - 1)
            lattice = Lattice([w[first : done + STRIP]], self.index, self.longest, known.shape[1] - 1)
            made = lattice.forward(self.prob, known)
            done = first + lattice.last
            known = made[:, -self.longest :]
        return known[0, -1]

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihood of each text in each language; NaN where it has no letter."""
        if self.chars > CHARS_KEPT:
            self.known, self.score, self.chars = {}, self.score[:0], 0
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        for some in batches(list({w for ws in split for w in ws} - self.known.keys())):
            n, need = len(self.known), len(self.known) + len(some)
            if need > len(self.score):
                self.score = np.concatenate([self.score, np.zeros((max(need, 2 * len(self.score)) - len(self.score), len(self.langs)))])
            self.score[n:need] = self.words(some)
            self.known.update(zip(some, range(n, need)))
            self.chars += sum(map(len, some)) + 8 * len(some)
        out = np.full((len(texts), len(self.langs)), np.nan)
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.score[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(0)
        return out


def probabilities(counts: Counter, pieces: list[str]) -> np.ndarray:
    """Of each piece, and of an unknown character at the end, in a language with these words."""
    index, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    made = [(Lattice([MARK + w for w in some], index, longest), np.array([counts[w] for w in some], dtype=float)) for some in batches(list(counts))]
    p = np.full((len(pieces) + 1, 1), 1 / len(pieces))
    p[-1] = UNKNOWN
    for _ in range(EM_ROUNDS):
        c = sum((lattice.expected(p, weight) for lattice, weight in made), np.zeros(len(pieces))) + PRIOR
        p[:-1, 0] = c / c.sum()
    return p[:, 0]


def fit(rows: list[tuple[str, str]], pieces: list[str]) -> Model:
    """From ``(text, lang)`` rows."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
    langs = sorted(counts)
    return Model(pieces, langs, np.stack([probabilities(counts[lang], pieces) for lang in langs], axis=1) if langs else np.full((len(pieces) + 1, 0), UNKNOWN))


def fit_in_tasks(rows: DataFrame, vocabulary_path: str) -> Model:
    """The same from a table ``(lang, text)`` of bounded size, each language in a task of its own."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for text in t.column("text").to_pylist():
            counts.update(LETTERS.findall((text or "").lower()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([probabilities(counts, _vocabulary(vocabulary_path)).tobytes()])], names=["lang", "prob"])

    made = sorted((lang, np.frombuffer(p)) for lang, p in rows.groupBy("lang").applyInArrow(one, "lang string, prob binary").collect())  # the model itself
    pieces = vocabulary(vocabulary_path)
    return Model(pieces, [lang for lang, _ in made], np.stack([p for _, p in made], axis=1) if made else np.full((len(pieces) + 1, 0), UNKNOWN))


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> list[str]:
    """One for each Python worker."""
    return vocabulary(path)


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``(lang, text)``: about ``TEXTS_PER_LANGUAGE`` rows of each language among those to learn from, by a hash of the id.

    Every language has the same share of ``chars`` and draws of its own, so that a rare one keeps its texts beside a common one. Of
    its texts those are taken, in the order of the hash, that have its share of characters together; very long ones come last, and
    a language keeps one text at least.
    """
    spark = docs.sparkSession
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = usable.groupBy("lang").count().collect()  # a row for each language, as the model has
    rates = spark.createDataFrame([(lang, TEXTS_PER_LANGUAGE / n) for lang, n in sizes], "lang string, rate double")
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    drawn = usable.withColumn("draw", draw).join(rates, "lang").where(F.col("draw") < F.col("rate")).withColumn("row", F.monotonically_increasing_id())
    drawn = Stage(spark, "langid").put(drawn.select("row", "lang", "id", "draw", "text"))
    kept = fitting(drawn.select("row", "lang", "id", "draw", F.length("text").cast("bigint").alias("n")), "lang", chars // max(1, len(sizes)), ["draw", "id", "row"])
    return drawn.join(kept.select("row"), "row").select("lang", "text")


def identify(docs: DataFrame, vocabulary_path: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, lang_pred, score)``: the likeliest of the languages, all of those in rows where ``learn`` holds.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. ``score`` is the softmax of
    the log-likelihoods at ``TEMPERATURE``. Ties go to the first language by name. Repeated rows and null ids are kept, an empty
    table gives no rows; words and texts may be of any length, other columns are not read.
    """
    model = fit_in_tasks(sample(docs, learn, id_col, text_col, lang_col), vocabulary_path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces of the vocabulary times languages

    def start():
        m = shared.value

        def do(texts: list) -> list:
            if not m.langs:
                return [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts))]
            ll = m.texts(texts)
            none = np.isnan(ll[:, 0])
            ll = np.where(none[:, None], 0.0, ll) / TEMPERATURE
            p = np.exp(ll - ll.max(1, keepdims=True))
            best = ll.argmax(1)
            score = np.where(none, 0.0, 1 / p.sum(1))
            return [pa.array(["und" if z else m.langs[b] for z, b in zip(none, best)], pa.string()), pa.array(score)]

        return do

    return map_text(docs, [id_col], text_col, "lang_pred string, score double", start)
