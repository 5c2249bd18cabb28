"""URL filters: rules for hosts and path prefixes, and a logistic regression where no rule fits.

The regression reads hashed character n-grams of host and path and is trained in well under a second from a
small labelled URL table, by default the one that ``labelled_urls`` builds. Model and rules travel with the task;
both are bounded by what the caller passes in, never by the data.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm._rows import map_text

BITS = 14
SIZES = (3, 4, 5)
LIMIT = 0.5
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Words of hosts that are to be blocked or allowed; ``labelled_urls`` combines them.
BLOCK_WORDS = "spam farm casino win bets betting poker slots jackpot cheap pills viagra pharma adult xxx porn sex ads adserver track tracker click popup free-prize payday loans crack warez keygen malware phishing".split()
ALLOW_WORDS = "news daily library museum school university science history weather travel recipes garden music books sports health forum wiki docs archive city council project research atlas journal review market open data".split()
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    m = _SPLIT.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def labelled_urls() -> list[tuple[str, int]]:
    """A few hundred URLs, 1 for block: each word as, or within, a host with a usual prefix, ending and path."""
    heads, tails, paths = ("www.", "", "blog.", "m."), ("com", "net", "org"), ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/")
    out = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for k, w in enumerate(words):
            pair = f"{w}-{words[(k * 7 + 3) % len(words)]}"
            for j, name in enumerate((w, pair)):
                n = k * 2 + j
                out.append((f"https://{heads[n % 4]}{name}.example.{tails[n % 3]}{paths[n % 5].format(n * 37 % 1000)}", label))
    for n in range(120):  # names without meaning are allowed
        name = "".join(_SYLLABLES[(n * 13 + j * (7 + n % 5)) % len(_SYLLABLES)] for j in range(2 + n % 3))
        out.append((f"http://{heads[n % 4]}{name}.example.{tails[n % 3]}{paths[n % 5].format(n * 53 % 1000)}", 0))
    return out


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams: those of the host and those of the path are told apart."""
    found = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"{path}$")):
        raw = s.encode("utf-8", "replace")
        m = zlib.crc32(mark.encode())
        found.update(zlib.crc32(raw[i : i + n], m) & ((1 << BITS) - 1) for n in SIZES for i in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


class UrlModel:
    """Logistic regression, full-batch gradient steps with L2; rows of features are scaled to length one."""

    def __init__(self, rows: Iterable[tuple[str, int]], steps: int = 1500, rate: float = 3.0, l2: float = 1e-4):
        rows = list(rows)
        found = [features(*parts(url)) for url, _ in rows]
        used = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        x = np.zeros((len(rows), len(used)), np.float32)
        for i, f in enumerate(found):
            x[i, np.searchsorted(used, f)] = 1 / np.sqrt(max(1, len(f)))
        y = np.array([label for _, label in rows], dtype=np.float32)
        w, self.b = np.zeros(len(used), np.float32), np.float32(0)
        for _ in range(steps if rows else 0):
            g = 1 / (1 + np.exp(-(x @ w + self.b))) - y
            w -= rate * (x.T @ g / len(y) + l2 * w)
            self.b -= rate * g.mean()
        self.w = np.zeros(1 << BITS, np.float32)
        self.w[used] = w

    def block(self, host: str, path: str) -> float:
        """Probability that the URL is one to block. Empty host and path: that of a URL without features."""
        f = features(host, path) if host or path else np.zeros(0, np.int64)
        return float(1 / (1 + np.exp(-(self.w[f].sum(dtype=np.float64) / np.sqrt(max(1, len(f))) + float(self.b)))))


class Rules:
    """``(verdict, rule)``; a rule is a host, from its first slash on with a path. Found by host suffix and path prefix, so the
    cost for a URL is the number of its suffixes times the number of different path lengths, however many rules there are."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by, lengths = {}, set()
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            path = "/" + path if "/" in rule else ""
            self.by[host.translate(_LOWER), path] = (rule, verdict)
            lengths.add(len(path))
        self.lengths = sorted(lengths, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            tail = ".".join(labels[i:])
            for n in self.lengths:
                if n <= len(path) and (hit := self.by.get((tail, path[:n]))) and (best is None or len(hit[0]) > len(best[0])):
                    best = hit
        return best


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, labelled: Iterable[tuple[str, int]] | None = None, limit: float = LIMIT) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row: the longest fitting rule decides, else the model.

    Null urls and those without ``://`` have empty host and path; no rule fits and the model's bias decides.
    Repeated rows and null ids are judged like any other; an empty table gives no rows. ``score`` is the model's
    probability of block, also where a rule decides; a score equal to ``limit`` blocks. Of rules of one length that fit a
    URL, which then are the same text, the last one given counts. URLs of any length are read whole; other columns of
    ``pages`` are not read, whatever their names.
    """
    model, book = UrlModel(labelled_urls() if labelled is None else labelled), Rules(rules)

    def start():
        def do(urls: list) -> list:
            hp = [parts(u) for u in urls]
            hit = [book.find(h, p) for h, p in hp]
            score = [model.block(h, p) for h, p in hp]
            return [
                pa.array([h for h, _ in hp], pa.string()),
                pa.array([p for _, p in hp], pa.string()),
                pa.array([x and x[0] for x in hit], pa.string()),
                pa.array([x[1] if x else "block" if s >= limit else "allow" for x, s in zip(hit, score)], pa.string()),
                pa.array(score, pa.float64()),
            ]

        return do

    return map_text(pages, [id_col], url_col, "host string, path string, rule string, verdict string, score double", start)
