"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network.

Every token has a sparse random index vector that follows from a hash of its text. A word's vector is the sum of its
neighbours' index vectors over a bounded sample of labelled texts, each divided by the square root of how often that
neighbour occurs, brought to length one. Words too rare in the sample, and words never seen, get the mean of their
three-letter parts' vectors, which are sums over the words that hold them. A document is read whole, in sections of
equal size; pooled are the mean of its word vectors, the smallest deviation of each dimension over its sections, and the
products of neighbouring word vectors (mean, and largest and smallest mean of a section). A network of one hidden layer
reads that, and its logit is divided by a temperature fitted on texts set aside.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from cairn.llm._labelled import sample
from cairn.llm._rows import map_text

#: At most so many labelled texts are learned from.
SAMPLE = 3000
DIM = 64
NONZERO = 6
WINDOW = 2
#: Words that occur less often in the sample are read by their parts.
MIN_COUNT = 3
PART = 3
SECTION = 32
HIDDEN = 32
EPOCHS = 60
LIMIT = 0.3
#: Characters of the tokens whose vectors a worker keeps between calls, and tokens pooled at a time.
CHARS_KEPT = 3_000_000
BLOCK = 32_768
TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def index_vectors(tokens: list[str]) -> np.ndarray:
    """A row of small whole numbers for each token: ``NONZERO`` places and signs from the bits of its hash."""
    h = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in tokens), np.uint64, len(tokens))
    out, rows = np.zeros((len(tokens), DIM), np.int8), np.arange(len(tokens))
    for k in range(NONZERO):
        bits = h >> np.uint64(7 * k)
        out[rows, (bits & np.uint64(DIM - 1)).astype(np.int64)] += np.where(bits & np.uint64(64), 1, -1).astype(np.int8)
    return out


def parts(token: str) -> list[str]:
    t = f"<{token}>"
    return [t[i : i + PART] for i in range(max(1, len(t) - PART + 1))]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


class Vectors:
    """Vectors of words and of word parts from a list of texts, as rows of length one (or zero)."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        docs = [np.array([known.setdefault(t, len(known)) for t in TOKEN.findall(x)], dtype=np.int32) for x in texts]
        names, n = list(known), len(known)
        flat = np.concatenate([*docs, np.zeros(0, np.int32)])
        place = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
        count = np.bincount(flat, minlength=n)
        index = index_vectors(names)
        weight = (1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)[:, None]
        context = np.zeros((n, DIM), np.float32)
        for at in range(0, len(flat), 50_000):  # bounded: the sums of so many places at a time
            here = np.arange(at, min(len(flat), at + 50_000))
            near = np.zeros((len(here), DIM), np.float32)
            for off in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                other = np.clip(here + off, 0, len(flat) - 1)
                ok = (here + off == other) & (place[other] == place[here])
                near[ok] += index[flat[other[ok]]] * weight[flat[other[ok]]]
            order = np.argsort(flat[here], kind="stable")
            own, first = np.unique(flat[here][order], return_index=True)
            context[own] += np.add.reduceat(near[order], first, axis=0)
        self.parts: dict[str, int] = {}
        split = [[self.parts.setdefault(p, len(self.parts)) for p in parts(t)] for t in names]
        self.part_table = np.zeros((len(self.parts), DIM), np.float32)
        for at in range(0, n, 10_000):
            some = split[at : at + 10_000]
            np.add.at(self.part_table, np.fromiter((p for ps in some for p in ps), np.int64), np.repeat(context[at : at + 10_000], [len(ps) for ps in some], axis=0))
        self.part_table = _unit(self.part_table)
        keep = np.flatnonzero(count >= MIN_COUNT)
        self.words = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.table = _unit(context[keep])

    def of(self, tokens: list[str]) -> np.ndarray:
        """A row for each token; zero where none of its parts is known."""
        out = np.zeros((len(tokens), DIM), np.float32)
        row = np.fromiter((self.words.get(t, -1) for t in tokens), np.int64, len(tokens))
        out[row >= 0] = self.table[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        own = [[p for p in map(self.parts.get, parts(tokens[i])) if p is not None] for i in new.tolist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        new, size = new[size > 0], size[size > 0]
        if len(new):
            flat = np.fromiter((p for ps in own for p in ps), np.int64, int(size.sum()))
            out[new] = _unit(np.add.reduceat(self.part_table[flat], np.cumsum(size) - size, axis=0))
        return out


class Pooler:
    """Pooled vectors of texts, with the vectors of tokens met so far."""

    width = 2 * DIM + 3

    def __init__(self, v: Vectors):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # a row of zeros behind the end of a section
        self.table, self.chars = np.zeros((1 << 12, DIM), np.float32), 0

    def learn(self, tokens: list[str]) -> None:
        n = len(self.known)
        while n + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(tokens), 4096):
            self.table[n + at : n + min(len(tokens), at + 4096)] = self.v.of(tokens[at : at + 4096])
        self.known.update(zip(tokens, range(n, n + len(tokens))))
        self.chars += sum(map(len, tokens)) + 8 * len(tokens)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """``[text, width]``; zeros for a text without a token."""
        if self.chars > CHARS_KEPT:
            self.forget()
        split = [TOKEN.findall(t) for t in texts]
        if new := list({t for ts in split for t in ts} - self.known.keys()):
            self.learn(new)
        size = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((self.known[t] for ts in split for t in ts), np.int64, int(size.sum()))
        del split
        n_sections = -(-size // SECTION)
        own = np.repeat(np.arange(len(size)), n_sections)  # document of each section
        k = np.arange(len(own)) - np.repeat(np.cumsum(n_sections) - n_sections, n_sections)
        begin = (np.cumsum(size) - size)[own] - (-k * size[own] // n_sections[own])
        ends = np.append(begin[1:], len(ids))
        total, least = np.zeros((len(size), DIM)), np.full((len(size), DIM), np.inf)
        pairs, most, few = np.zeros(len(size)), np.full(len(size), -np.inf), np.full(len(size), np.inf)
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        at = 0
        while at < len(own):  # whole sections, up to BLOCK tokens or so
            to = max(at + 1, int(np.searchsorted(ends, begin[at] + BLOCK, "right")))
            lo, hi = int(begin[at]), int(ends[to - 1])
            m = self.table[ids[lo:hi]]
            before = self.table[ids[max(lo - 1, 0)]][None]
            product = np.einsum("ij,ij->i", m, np.concatenate([before, m[:-1]]))
            product[first[lo:hi]] = 0
            cuts, n, doc = begin[at:to] - lo, (ends - begin)[at:to].astype(float), own[at:to]
            held = np.arange(SECTION) < n[:, None]
            place = np.where(held, cuts[:, None] + np.arange(SECTION), 0)
            each = self.table[np.where(held, ids[lo:hi][place], 0)]  # [section, token, dimension]
            s, q = each.sum(1, dtype=np.float32).astype(np.float64), np.einsum("skd,skd->sd", each, each).astype(np.float64)
            p = np.where(held, product[place], 0).sum(1).astype(np.float64)
            np.add.at(total, doc, s)
            np.add.at(pairs, doc, p)
            np.minimum.at(least, doc, np.sqrt(np.maximum(q / n[:, None] - np.square(s / n[:, None]), 0)))
            np.maximum.at(most, doc, p / n)
            np.minimum.at(few, doc, p / n)
            at = to
        out = np.zeros((len(size), self.width), np.float32)
        has = size > 0
        out[has] = np.concatenate([total[has] / size[has, None], least[has], (pairs[has] / size[has])[:, None], most[has, None], few[has, None]], axis=1)
        return out


class Network:
    """Two layers, trained by Adam on log loss; ``temperature`` from a fifth of the rows that training does not see."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.std
        aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        zt, yt = z[~aside].astype(float), y[~aside].astype(float)
        for _ in range(EPOCHS):
            order = rng.permutation(len(yt))
            for at in range(0, len(order), 128):
                b = order[at : at + 128]
                h = np.maximum(zt[b] @ self.w1 + self.b1, 0)
                g = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - yt[b]) / len(b)
                gh = np.outer(g, self.w2) * (h > 0)
                grads = [zt[b].T @ gh + 1e-4 * self.w1, gh.sum(0), h.T @ g + 1e-4 * self.w2, np.array([g.sum()])]
                step += 1
                for p, d, a, c in zip(params, grads, m, v):
                    a += 0.1 * (d - a)
                    c += 0.001 * (d * d - c)
                    p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if aside.any():
            logit = self.logit(x[aside])
            loss = lambda t: np.logaddexp(0, np.where(y[aside] == 1, -logit, logit) / t).mean()
            self.temperature = min(np.geomspace(0.5, 20, 60).tolist(), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.std @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


class Model:
    """``rows``: ``(text, label)``. With one label only, or none, every text gets that label's value, or 1."""

    def __init__(self, rows: list[tuple[str, int]]):
        labels = np.array([y for _, y in rows], dtype=np.int64)
        self.constant = 1.0 if not rows else float(labels[0]) if len(set(labels.tolist())) < 2 else None
        if self.constant is None:
            self.vectors = Vectors([t for t, _ in rows])
            pool = Pooler(self.vectors)
            self.network = Network(np.concatenate([pool([t for t, _ in rows[at : at + 200]]) for at in range(0, len(rows), 200)]), labels)

    @property
    def pool(self) -> Pooler:
        """One for each Python worker, so that a task finds the vectors that earlier tasks looked up."""
        if "_pool" not in self.__dict__:
            self._pool = Pooler(self.vectors)
        return self._pool


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", carry: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``(id, *carry, name)`` for every row; higher: label 1 likelier. Texts without a token (null and empty ones
    too) score 0. Repeated rows and null ids are scored like any other; an empty table gives no rows.

    ``learn`` says which ids of ``labels`` may be learned from; at most ``SAMPLE`` labelled texts are. Texts of any length are read whole,
    equal texts score alike. A carried column called like ``name`` is an error; other columns are not read, whatever their names.
    """
    model = Model(sample(docs, labels, learn, label, SAMPLE, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample

    def start():
        m = shared.value
        pool = None if m.constant is not None else m.pool

        def do(texts: list) -> list:
            if pool is None:
                return [pa.array([m.constant if t and TOKEN.search(t) else 0.0 for t in texts], pa.float64())]
            none = np.fromiter((not t or TOKEN.search(t) is None for t in texts), bool, len(texts))
            return [pa.array(np.where(none, 0.0, m.network(pool([t or "" for t in texts]))), pa.float64())]

        return do

    return map_text(docs, [id_col, *carry], text_col, f"`{name}` double", start)
