"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones, drops invisible
characters, and reads digits and signs inside words as the letters they stand for. The lexicon (whole words and word
beginnings, each with a log-odds weight) and the phrases that make a term harmless are learned from a bounded sample of
labelled texts; own entries can be given too. The weights of a text's hits, as such and by its length, go
through a logistic function fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from cairn.llm._labelled import sample
from cairn.llm._rows import map_text

#: At most so many labelled texts are learned from.
SAMPLE = 6000
LIMIT = 0.5
STEMS = range(4, 9)
MIN_TEXTS = 3
MIN_WEIGHT = 3.0
#: A beginning gives way to a longer one, or a word, that has nearly as many texts.
SPECIFIC = 0.95
#: A word that no text needs is a term too if chance does not explain its toxic texts: so many false ones are expected among all words.
CHANCE = 0.05
#: Words that are harmless in phrases only are in this share of toxic texts; outside of these clean texts hardly have them.
COMMON, CLEAN_SHARE = 0.01, 0.02

#: Letters of other scripts that look like Latin ones, and what digits and signs in words stand for.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнґзԛԝαβεικνορτυχγηωϲ", "aeopcyxijsdhlkmtbhr3qwabeiknoptuxynwc"))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(ord, INVISIBLE), None)
_SUB = {ord(k): v for k, v in SUBSTITUTES.items()}
_ODD = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～]")
_DIGITS = re.compile(r"(?<=[^\W\d_])[0134578]+|[0134578]+(?=[^\W\d_])|[@$]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    t = (text or "").lower()
    if not t.isascii() and _ODD.search(t):
        t = t.translate(_FOLD).lower()
    return _DIGITS.sub(lambda m: m[0].translate(_SUB), t)


class Lexicon:
    """``terms``: weight by term; a term that ends in ``*`` is a word's beginning. ``exceptions``: pairs of words, written with
    a space, in which a term does not count. ``curve``: intercept and slopes for the weight and the weight by length."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset(), curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)):
        self.terms, self.exceptions, self.curve = dict(terms), frozenset(exceptions), curve
        self._open()

    def _open(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[bool, float]]] = {}
        for t, w in self.terms.items():
            by.setdefault(t.rstrip("*"), []).append((t.endswith("*"), w))
        for t, found in by.items():
            self.automaton.add_word(t, (len(t), found))
        self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.terms, self.exceptions, self.curve)

    def hits(self, folded: str) -> list[tuple[float, str, str, str]]:
        """Weight, word, word before and word after of each place where a term stands; the heaviest where several do."""
        out: dict[int, float] = {}
        if not self.terms:
            return []
        for end, (size, found) in self.automaton.iter(folded):
            at = end + 1 - size
            if at and folded[at - 1].isalpha():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
            w = max((w for stem, w in found if stem or whole), default=None)
            if w is not None:
                out[at] = max(w, out.get(at, w))
        if not out:
            return []
        rows = []
        for at, w in sorted(out.items()):
            word = _WORD.match(folded, at)[0]
            before = _WORD.findall(folded[max(0, at - 60) : at])[-1:]
            after = _WORD.search(folded, at + len(word))
            rows.append((w, word, before[0] if before else "", after[0] if after else ""))
        return rows

    def weight(self, folded: str) -> float:
        return sum(w for w, word, a, b in self.hits(folded) if f"{a} {word}" not in self.exceptions and f"{word} {b}" not in self.exceptions)

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        w = self.weight(folded)
        return (np.log1p(w), np.log1p(1000 * w / (len(folded) / 6 + 20))) if w else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def _log_odds(c1: int, c0: int, n1: int, n0: int) -> float:
    return float(np.log((c1 + 0.1) / (n1 + 0.2)) - np.log((c0 + 0.1) / (n0 + 0.2)))


def _by_chance(c1: int, c0: int, share: float) -> float:
    """The chance that of ``c1 + c0`` groups of texts so many or more are toxic, if a term had nothing to do with it."""
    n = c1 + c0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(c1, n + 1)]
    return math.fsum(map(math.exp, logs))


def _groups(texts: list[str], keys: int = 12) -> list[int]:
    """A number for each text, the same for texts that share half of the ``keys`` lowest hashes of their words: copies count once."""
    root, holders, out = list(range(len(texts))), {}, []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, t in enumerate(texts):
        own = sorted(zlib.crc32(w.encode()) for w in set(_WORD.findall(t)))[:keys]
        met: Counter = Counter()
        for h in own:
            met.update({find(j) for j in holders.get(h, ())})
        for j, n in met.items():
            if 2 * n >= len(own) and find(j) != find(i):
                root[find(i)] = find(j)
        for h in own:  # a group stands by its first text
            if find(i) == i:
                holders.setdefault(h, []).append(i)
    return [find(i) for i in range(len(texts))]


def _phrases(words: list[str], k: int) -> list[str]:
    """The pairs of words that hold the word at ``k``."""
    return [f"{a} {b}" for a, b in zip(words[max(0, k - 1) : k + 1], words[max(0, k - 1) + 1 : k + 2])]


def _harmless_in_phrases(texts: list[tuple[str, int]], terms: dict[str, float], n1: int, n0: int) -> dict[str, float]:
    """Words that toxic texts have more often, though clean ones have them too, but there only in a few phrases no toxic text has."""
    split = lambda: ((_WORD.findall(t), y) for t, y in texts)  # noqa: E731  split anew in each pass, not held
    count = [Counter(), Counter()]
    for words, y in split():
        count[y].update(set(words))
    stems = tuple(c[:-1] for c in terms if c.endswith("*"))
    odd = {w for w, c in count[1].items() if c >= max(10, COMMON * n1) and c / n1 > 1.3 * count[0][w] / n0 and w not in terms and not w.startswith(stems or ("\0",))}
    odd = {w for w in odd if count[0][w] > CLEAN_SHARE * count[1][w]}
    seen: list[dict[str, Counter]] = [{w: Counter() for w in odd} for _ in (0, 1)]
    for words, y in split():
        for w, ps in {(w, p) for k, w in enumerate(words) if w in odd for p in _phrases(words, k)}:
            seen[y][w][ps] += 1
    safe = {w: {p for p, c in seen[0][w].items() if c >= MIN_TEXTS and not seen[1][w][p]} for w in odd}
    safe = {w: ps for w, ps in safe.items() if ps}
    left: Counter = Counter()
    for words, y in split():
        if not y:
            left.update({w for k, w in enumerate(words) if w in safe and not safe[w].intersection(_phrases(words, k))})
    return {w: _log_odds(count[1][w], left[w], n1, n0) for w in safe if left[w] <= CLEAN_SHARE * count[1][w]}


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """From ``(text, label)``, equal rows once: terms are taken one by one, each the one that accounts for most toxic texts not yet accounted
    for, less those clean texts that hold it; ties go to the more specific. Then all other words that toxic texts, copies counted once,
    have more often than chance explains. Then exceptions, then the curve."""
    rows = sorted(set(rows))
    texts = [(fold(t), y) for t, y in rows]
    n1 = sum(y for _, y in texts)
    n0 = len(texts) - n1
    if not n1 or not n0:
        return Lexicon({}, curve=(np.log((n1 + 0.5) / (n0 + 0.5)) if rows else -5.0, 0.0, 0.0))
    toxic: dict[str, set[int]] = {}
    for i, (t, y) in enumerate(texts):
        if y:
            for w in set(_WORD.findall(t)):
                for c in (w, *(w[:k] + "*" for k in STEMS if k <= len(w))):
                    toxic.setdefault(c, set()).add(i)
    toxic = {c: s for c, s in toxic.items() if len(s) >= MIN_TEXTS}
    longer: dict[str, int] = {}  # the most texts of any more specific term
    for c, s in toxic.items():
        for k in STEMS:
            if (k < len(c.rstrip("*")) or not c.endswith("*")) and k <= len(c.rstrip("*")):
                longer[c[:k] + "*"] = max(longer.get(c[:k] + "*", 0), len(s))
    toxic = {c: s for c, s in toxic.items() if longer.get(c, 0) < SPECIFIC * len(s)}
    clean: Counter = Counter()
    for t, y in texts:
        if not y:
            clean.update({c for w in set(_WORD.findall(t)) for c in (w, *(w[:k] + "*" for k in STEMS if k <= len(w))) if c in toxic})
    open_ = {c: _log_odds(len(s), clean[c], n1, n0) for c, s in toxic.items()}
    open_ = {c: w for c, w in open_.items() if w >= MIN_WEIGHT}
    terms, left = {}, {i for i, (_, y) in enumerate(texts) if y}
    while open_:
        gain = {c: len(toxic[c] & left) - clean[c] for c in open_}
        best = max(open_, key=lambda c: (gain[c], not c.endswith("*"), len(c), c))
        if gain[best] < MIN_TEXTS:
            break
        terms[best] = open_[best]
        left -= toxic[best]
        open_ = {c: w for c, w in open_.items() if c != best and gain[c] > 0}
    group = _groups([t for t, _ in texts])
    kinds = [len({g for g, (_, y) in zip(group, texts) if y == k}) for k in (0, 1)]
    words = [c for c in toxic if not c.endswith("*")]
    for c in words:
        if c not in terms and not any(c[:k] + "*" in terms for k in STEMS):
            c1 = len({group[i] for i in toxic[c]})
            if _log_odds(c1, clean[c], kinds[1], kinds[0]) >= MIN_WEIGHT and _by_chance(c1, clean[c], kinds[1] / sum(kinds)) * len(words) < CHANCE:
                terms[c] = _log_odds(len(toxic[c]), clean[c], n1, n0)
    terms |= _harmless_in_phrases(texts, terms, n1, n0)
    first = Lexicon(terms)
    found = [[{q for q in (f"{a} {word}" * bool(a), f"{word} {b}" * bool(b)) if q} for _, word, a, b in first.hits(t)] for t, _ in texts]
    toxic_pairs = {q for hits, (_, y) in zip(found, texts) if y for hit in hits for q in hit}
    open_hits, exceptions = [hit - toxic_pairs for hits, (_, y) in zip(found, texts) if not y for hit in hits], set()
    while pairs := Counter(q for hit in open_hits for q in hit).most_common():
        best, n = min(pairs, key=lambda p: (-p[1], p[0]))
        if n < MIN_TEXTS:
            break
        exceptions.add(best)
        open_hits = [hit for hit in open_hits if best not in hit]
    made = Lexicon(terms, frozenset(exceptions))
    x = np.array([(1.0, *made.features(t)) for t, _ in rows])
    y = np.array([y for _, y in rows], dtype=float)
    b = np.array([-3.0, 1.0, 1.0])
    prior, scale = b.copy(), 0.02 * np.eye(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + scale, x.T @ (p - y) + scale @ (b - prior))
    return Lexicon(made.terms, made.exceptions, tuple(b.tolist()))


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", carry: tuple[str, ...] = (), name: str = "score", lexicon: Lexicon | None = None) -> DataFrame:
    """``(id, *carry, name)`` for every row; higher: label 1 likelier. Texts without a hit, null and empty ones
    too, get the curve's lowest value, so all of them tie. Of terms that stand at one place the heaviest counts once. Repeated rows
    and null ids are scored like any other; an empty table gives no rows. Texts may be of any length.

    ``learn_from`` says which ids of ``labels`` may be learned from; at most ``SAMPLE`` labelled texts are. ``lexicon``: use
    this one instead. A carried column called like ``name`` is an error; other columns are not read, whatever their names.
    """
    lexicon = lexicon or learn(sample(docs, labels, learn_from, label, SAMPLE, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of a bounded sample's toxic texts

    def start():
        known = shared.value

        def do(texts: list) -> list:
            return [pa.array([known.score(t) for t in texts], pa.float64())]

        return do

    return map_text(docs, [id_col, *carry], text_col, f"`{name}` double", start)
