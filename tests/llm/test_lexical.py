import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from cairn.llm import lexical as lx

WORDS = [a + b for a in ("ba", "Co", "dí", "fu", "漢", "l0") for b in ("na", "ro", "ti", "mu", "SE")]


def texts(n, seed=0, longest=60):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [rnd.choice([" ", ", ", "\n", "-"]).join(rnd.choices(WORDS, weights, k=rnd.randint(0, longest))) for _ in range(n)]


def brute(docs, items, k=20):
    """Every score of every pair, by the definition."""
    split = [(i, Counter(lx.terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in split), sum(c.total() for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in split:
            m = 75 + 25 * c.total() * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in lx.terms(text) if w in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_terms():
    assert lx.terms("Ab-c9 ÀÉ_x漢\x00字\x7fz`{@[") == ["ab".encode(), b"c9", "ÀÉ".encode(), "x漢".encode(), "字".encode(), b"z"]
    assert lx.terms(None) == lx.terms("") == lx.terms(" .,") == []


@pytest.mark.parametrize("shard_terms", [150, 10**6])
def test_equals_brute_force(spark, monkeypatch, shard_terms):
    monkeypatch.setattr(lx, "QUERY_BLOCK", 7)
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(900 + i, texts(1, 5)[0]) for i in range(30)] + [(7, "bana coro"), (None, "bana coro"), (500, None), (501, "")]
    items = [(i, t) for i, t in enumerate(texts(20, 9, 12))] + [(3, "bana bana bana"), (100, None), (101, ""), (102, "nowhere"), (103, "bana")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, `a.b` string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, rank int")
    got = lx.search(lx.build(d, shard_terms=shard_terms), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lx.search(lx.build(d), q.limit(0)).count() == 0 == lx.search(lx.build(d.limit(0)), q).count()
    assert lx.search(lx.build(d.where("doc_id is null")), q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_ids_of_other_types_keep_their_values(spark):
    d = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts(60))], "doc_id string, text string")
    q = spark.createDataFrame([("q", "bana coro díti")], "item_id string, text string")
    assert sorted((tuple(r) for r in lx.search(lx.build(d, shard_terms=300), q, 5).collect()), key=str) == brute([tuple(r) for r in d.collect()], [("q", "bana coro díti")], 5)
    big = spark.createDataFrame([(2**62 + 1, "bana"), (2**62 + 3, "bana x"), (None, "bana")], "doc_id long, text string")
    assert {r.doc_id for r in lx.search(lx.build(big), spark.createDataFrame([(1, "x bana")], "item_id int, text string")).collect()} >= {2**62 + 3}


def test_blocks_are_the_best_cut():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 9, 23, 40):
        f = rnd.integers(1, 1000, n)
        first, top = lx.cut_blocks(f, cost=900.0, grain=4, span=100)
        error = lambda cuts: sum(f[a:b].max() * (b - a) - f[a:b].sum() + 900.0 for a, b in zip(cuts, [*cuts[1:], n]))
        inner = list(range(4, n, 4))
        best = min(error([0, *c]) for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        assert error(first.tolist()) == pytest.approx(best)
        assert top.tolist() == [f[a:b].max() for a, b in zip(first, [*first[1:], n])]


def test_search_skips_and_stays_exact(monkeypatch):
    """Random lists, one with a few heavy postings: what is read is less than all, what is found is the same."""
    monkeypatch.setattr(lx, "FIRST_WAVE", 16)
    rnd = np.random.default_rng(5)
    for trial in range(30):
        lists = []
        for _ in range(rnd.integers(1, 8)):
            docs = np.sort(rnd.choice(3000, rnd.integers(1, 2500), replace=False))
            f = rnd.integers(0, 50, len(docs)) + 5000 * (rnd.random(len(docs)) < 0.01)
            lists.append((int(rnd.integers(0, 9)), lx.Postings(docs, f)))
        total = np.zeros(3000, np.int64)
        for w, p in lists:
            total[p.docs] += w * p.f
        order = np.lexsort((np.arange(3000), -total))[:20]
        order = order[total[order] > 0]
        docs, scores = lx.first_k(lists, 20)
        assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist(), trial
