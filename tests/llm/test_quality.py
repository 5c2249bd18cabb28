import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality as q

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ga", "le") for b in ("na", "ro", "ti", "mu", "se", "do", "pla")]


def corpus(n, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = rnd.choices(WORDS, k=rnd.randint(20, 200))
        good = i % 4 != 0
        if not good:
            kind = i % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words[:9] for _ in range(12)] if kind == 1 else [w + "###" for w in words]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r.doc_id: r.score for r in q.score(docs, labels, learn).collect()}
    held = docs.where(~learn).select("doc_id").toPandas().doc_id
    hit = [(got[i] >= q.LIMIT) == bool(rows[i][2]) for i in held]
    assert len(got) == 600 and sum(hit) / len(hit) > 0.97
    assert {r.doc_id: r.score for r in q.score(docs, labels, learn).collect()} == got  # nothing in it is random


def test_pooling_covers_whole_texts():
    v = q.Vectors([t for _, t, _ in corpus(50)])
    pool = q.Pooler(v)
    a, b = pool(["bana coro " * 3000, "bana coro " * 2999 + "JUNK!! JUNK!!"])
    assert not np.allclose(a, b)
    few = pool(["bana coro"])
    assert np.allclose(q.Pooler(v)(["bana coro"]), few)


def context(texts, t):
    """Sum of the neighbours' index vectors of a word, over the square root of their counts, one by one."""
    count, out = {}, np.zeros(q.DIM)
    for x in texts:
        for w in q.TOKEN.findall(x):
            count[w] = count.get(w, 0) + 1
    for x in texts:
        ws = q.TOKEN.findall(x)
        for i, w in enumerate(ws):
            if w == t:
                for j in range(max(0, i - q.WINDOW), min(len(ws), i + q.WINDOW + 1)):
                    if j != i:
                        out += q.index_vectors([ws[j]])[0] / np.sqrt(count[ws[j]])
    return out


def test_words_have_the_sums_of_their_neighbours():
    texts = ["aa bb cc aa", "bb dd aa", "ee aa, bb!! dd bb"]
    v = q.Vectors(texts)
    assert set(v.words) == {"aa", "bb"}  # the others are too rare
    for w in v.words:
        want = context(texts, w)
        assert np.allclose(v.table[v.words[w]], want / np.linalg.norm(want), atol=1e-6)
    part = context(texts, "dd")
    assert np.allclose(v.part_table[v.parts["dd>"]], part / np.linalg.norm(part), atol=1e-6)


def test_rare_and_new_words_have_the_mean_of_their_parts():
    v = q.Vectors(["aabb cc aabb dd", "bbcc dd ee"])
    own = v.part_table[[v.parts[p] for p in ("<bb", "bbc", "bcc", "cc>")]].sum(0)
    got = v.of(["bbcc", "bbcx", "zzzz"])
    assert np.allclose(got[0], own / np.linalg.norm(own), atol=1e-6)
    own = v.part_table[[v.parts[p] for p in ("<bb", "bbc")]].sum(0)
    assert np.allclose(got[1], own / np.linalg.norm(own), atol=1e-6) and not got[2].any()


def test_pooling_is_that_of_a_loop(monkeypatch):
    texts = [t for _, t, _ in corpus(40)] + ["", "one", "### !!", "bana " * 33, "coro muse " * 400]
    v = q.Vectors(texts[:30])
    want = []
    for t in texts:
        m = v.of(q.TOKEN.findall(t)).astype(float)
        if not len(m):
            want.append(np.zeros(q.Pooler.width))
            continue
        n = -(-len(m) // q.SECTION)
        cuts = [-(-k * len(m) // n) for k in range(n + 1)]
        near = np.array([0.0] + [m[i] @ m[i - 1] for i in range(1, len(m))])
        each = [near[a:b].mean() for a, b in zip(cuts, cuts[1:])]
        want.append(np.concatenate([m.mean(0), np.min([m[a:b].std(0) for a, b in zip(cuts, cuts[1:])], axis=0), [near.mean(), max(each), min(each)]]))
        assert max(b - a for a, b in zip(cuts, cuts[1:])) <= q.SECTION
    assert np.allclose(q.Pooler(v)(texts), want, atol=2e-3)
    assert np.allclose(np.array(q.Pooler(v)(texts))[:, : q.DIM], np.array(want)[:, : q.DIM], atol=1e-5)
    monkeypatch.setattr(q, "BLOCK", 50)
    monkeypatch.setattr(q, "CHARS_KEPT", 10)
    pool = q.Pooler(v)
    assert np.array_equal(np.concatenate([pool([t]) for t in texts]), q.Pooler(v)(texts))


def test_network_and_temperature_are_those_of_a_loop():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * x[:, 0] + x[:, 1]))).astype(int)
    n = q.Network(x, y)

    def logit(row):
        hidden = [max(0.0, n.b1[k] + sum((row[i] - n.mean[i]) / n.std[i] * n.w1[i, k] for i in range(6))) for k in range(q.HIDDEN)]
        return n.b2[0] + sum(h * w for h, w in zip(hidden, n.w2))

    logits = [logit(r) for r in x]
    assert np.allclose(n(x), [1 / (1 + np.exp(-v / n.temperature)) for v in logits])
    loss = lambda t: sum(np.log(1 + np.exp(-v / t if c else v / t)) for i, (v, c) in enumerate(zip(logits, y)) if i % 5 == 0)
    assert loss(n.temperature) <= min(loss(t) for t in np.geomspace(0.5, 20, 200)) + 0.05
    right = np.mean([(v > 0) == bool(c) for v, c in zip(logits, y)])
    assert right > 0.8


def test_sample_is_bounded_and_counts_an_id_once(spark):
    from cairn.llm import _labelled as lab

    docs = spark.createDataFrame([(i, f"text {i:03d}") for i in range(100)] + [(5, "a"), (5, "b"), (None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 1), (6, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    take = lambda bound, **kw: lab.sample(docs, labels, F.lit(True), "quality", bound, "doc_id", "text", **kw)
    every = take(1000)
    assert len(every) == 99 and ("a", 1) in every and not any("006" in t for t, _ in every) and ("", 1) in every
    some = take(10)
    assert len(some) == 10 and set(some) <= set(every) and set(some) <= set(take(20))
    assert sum(len(t) for t, _ in take(1000, chars=80)) <= 80


@pytest.mark.parametrize("where", ["first", "middle"])
def test_a_giant_text_displaces_no_other(spark, where):
    """The labelled text that comes first, or half way, in the order of the sample is longer than all it may read."""
    from cairn.llm import _labelled as lab

    docs = spark.createDataFrame([(i, f"text {i:03d}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    order = [r[0] for r in docs.orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id").collect()]
    giant = order[0 if where == "first" else 50]
    long = docs.withColumn("text", F.when(F.col("doc_id") == giant, F.repeat(F.lit("long "), 7_000_000)).otherwise(F.col("text")))
    take = lambda t: lab.sample(t, labels, F.lit(True), "quality", 1000, "doc_id", "text")
    assert set(take(docs)) - set(take(long)) == {(f"text {giant:03d}", giant % 2)} and len(take(long)) == 99
    only = labels.where(F.col("doc_id") == giant)
    found = lab.sample(long, only, F.lit(True), "quality", 1000, "doc_id", "text")
    assert [(len(t), y) for t, y in found] == [(35_000_000, giant % 2)]  # a label keeps one text


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    n = q.Network(x, y)
    p = n(x)
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[own].mean()) < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 1)]])
def test_labels_of_one_kind_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (1, "a b"), (4, "")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(3))
    got = q.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).collect()
    assert sorted(r.score for r in got) == [0.0, 0.0, 1.0, 1.0, 1.0]
    assert q.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).count() == 0
