import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import langid as g
from cairn.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
SYLLABLES = {"aa": ["the", "ing", "and", "ou", "er"], "bb": ["ión", "que", "los", "ar", "ado"], "cc": ["sch", "ung", "ein", "der", "ß"]}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    return [(i, " ".join("".join(rnd.choices(SYLLABLES[k], k=rnd.randint(1, 4))) for _ in range(rnd.randint(3, 60))), k) for i in range(n) for k in [list(SYLLABLES)[i % 3]]]


def brute(word, index, prob):
    """Sum over every segmentation, listed one by one."""
    w = g.MARK + word

    def rest(s):
        if s == len(w):
            return np.ones(prob.shape[1])
        out = np.zeros(prob.shape[1])
        if w[s] not in index:
            out += prob[-1] * rest(s + 1)
        for e in range(s + 1, len(w) + 1):
            if w[s:e] in index:
                out += prob[index[w[s:e]]] * rest(e)
        return out

    return np.log(rest(0))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"]
    prob = np.random.default_rng(0).random((len(pieces) + 1, 3)) / 4
    m = g.Model(pieces, ["x", "y", "z"], prob)
    words = ["a", "ab", "abab", "bbb", "abzab", "ζ", "babab"]
    assert np.allclose(m.words(words), [brute(w, m.index, prob) for w in words])


def test_expected_counts_are_those_of_all_segmentations():
    pieces, prob = ["▁", "a", "b", "ab", "▁a"], np.array([[0.2], [0.3], [0.1], [0.25], [0.15], [1e-7]])
    index = {p: i for i, p in enumerate(pieces)}
    lattice = g.Lattice([g.MARK + "ab"], index, 2)
    ways = [(["▁", "a", "b"], 0.2 * 0.3 * 0.1), (["▁", "ab"], 0.2 * 0.25), (["▁a", "b"], 0.15 * 0.1)]
    total = sum(p for _, p in ways)
    want = [sum(p / total * w.count(x) for w, p in ways) * 7 for x in pieces]
    assert np.allclose(lattice.expected(prob, np.array([7.0])), want)


def test_held_out_accuracy(spark):
    rows = corpus(240)
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = {r.doc_id: (r.lang_pred, r.score) for r in g.identify(t, PATH, learn).collect()}
    held = t.where(~learn).toPandas()
    assert (held.doc_id.map(lambda i: got[i][0]) == held.lang).mean() > 0.97
    assert all(1 / 3 <= s <= 1 for _, s in got.values())


def test_texts_without_letters_nulls_long_words_and_ties(spark):
    docs = corpus(60) + [(100, None, None), (101, "", None), (102, "12 34 !!", "aa"), (103, "the" * 5000, None), (104, "漢字", None), (None, "ungein schder", "cc"), (0, "the and", "aa")]
    t = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    rows = g.identify(t, PATH, F.col("doc_id").isNotNull()).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und" and by[100].score == 0
    assert by[103].lang_pred == "aa" and by[104].lang_pred in SYLLABLES
    assert g.identify(t.limit(0), PATH, F.lit(True)).count() == 0
    none = g.identify(t.withColumn("lang", F.lit(None).cast("string")), PATH, F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_whole_texts_count():
    m = g.fit([(t, k) for _, t, k in corpus(60)], g.vocabulary(PATH))
    a, b = m.texts(["the and " * 2000 + "queión", "the and " * 2000])
    assert not np.allclose(a, b) and np.allclose(a - b, m.words(["queión"])[0])


def by_position(word, index, prob):
    """The same sum position by position, with logarithms throughout."""
    w = g.MARK + word
    f = np.full((len(w) + 1, prob.shape[1]), -np.inf)
    f[0] = 0
    for e in range(1, len(w) + 1):
        ways = [f[s] + np.log(prob[index[w[s:e]]]) for s in range(max(0, e - 40), e) if w[s:e] in index]
        if w[e - 1] not in index:
            ways.append(f[e - 1] + np.log(prob[-1]))
        for x in ways:
            f[e] = np.logaddexp(f[e], x)
    return f[-1]


def test_words_of_any_length_are_one_sum(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bbbb"]
    prob = np.random.default_rng(0).random((len(pieces) + 1, 3)) / 40
    prob[-1] = 1e-7
    m = g.Model(pieces, ["x", "y", "z"], prob)
    rnd = random.Random(2)
    words = ["".join(rnd.choices("aabbbz", k=n)) for n in (1, 39, 40, 41, 42, 700, 5000, 9001)]
    want = [by_position(w, m.index, prob) for w in words]
    assert np.allclose(m.words(words), want)
    monkeypatch.setattr(g, "STRIP", 7)
    assert np.allclose(m.words(words[:6]), want[:6])
    assert np.isfinite(m.words(["z" * 3000])).all()


def test_texts_and_scores_are_those_of_a_loop(spark):
    rows = corpus(90) + [(500, "donau" * 30 + " und " + "漢字" * 50, None), (501, "und The 12 UNG", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") < 60
    m = g.fit([(r.text, r.lang) for r in g.sample(t, learn, "doc_id", "text", "lang").collect()], g.vocabulary(PATH))
    got = {r.doc_id: r for r in g.identify(t, PATH, learn).collect()}
    for i, text, _ in rows[::9] + rows[-2:]:
        total = sum(by_position(w, m.index, m.prob) for w in g.LETTERS.findall(text.lower()))
        p = np.exp((total - total.max()) / g.TEMPERATURE)
        assert got[i].lang_pred == m.langs[int(total.argmax())] and got[i].score == pytest.approx(1 / p.sum())


def test_sample_is_bounded(spark, monkeypatch):
    t = spark.createDataFrame([(i, f"text {i:03d}", f"l{i % 50 if i % 3 else 0}") for i in range(600)], "doc_id long, text string, lang string")
    monkeypatch.setattr(g, "TEXTS_PER_LANGUAGE", 5)
    rows = g.sample(t, F.lit(True), "doc_id", "text", "lang").collect()
    langs = {r.lang for r in rows}
    assert "l0" in langs and len(langs) > 40 and len(rows) < 350
    few = g.sample(t, F.lit(True), "doc_id", "text", "lang", chars=50 * 16).collect()
    assert {r.lang for r in few} == langs and max(sum(len(r.text) for r in few if r.lang == k) for k in langs) <= 16


def test_rare_language_and_long_text_under_the_bound(spark, monkeypatch):
    """Common languages and one giant text first in the order leave a rare language and the other texts their share."""
    rows = [(i, f"der text {i:06d} ung", f"c{i % 3}") for i in range(30_000)] + [(100_000 + i, f"rare zz{i}", "rare") for i in range(30)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(g, "SAMPLE_CHARS", 8_000)
    drawn = g.sample(t, F.lit(True), "doc_id", "text", "lang", chars=8_000)
    n = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert set(n) == {"c0", "c1", "c2", "rare"} and n["rare"] == 30
    long = t.withColumn("text", F.when(F.col("doc_id") == 100_003, F.repeat(F.lit("giant "), 5_000)).otherwise(F.col("text")))
    left = g.sample(long, F.lit(True), "doc_id", "text", "lang", chars=8_000)
    assert left.where("lang = 'rare'").count() == 29 and left.where("length(text) > 1000").count() == 0
    only = t.where("doc_id = 1").withColumn("text", F.repeat(F.lit("giant "), 5_000))
    assert g.sample(only, F.lit(True), "doc_id", "text", "lang", chars=100).count() == 1  # a language keeps one


def test_any_number_of_languages(spark):
    names = [f"l{i:03d}" for i in range(300)]
    own = [p[1:] for p in g.vocabulary(PATH) if p[0] == g.MARK and len(p) > 6 and p[1:].isalpha() and p[1:].islower()][:300]  # a word of its own, among common ones
    t = spark.createDataFrame([(3 * i + j, f"the {own[i]} and {own[i]}", k) for i, k in enumerate(names) for j in range(2)], "doc_id long, text string, lang string")
    got = g.identify(t, PATH, F.lit(True)).collect()
    assert len(got) == 600 and all(r.lang_pred == names[r.doc_id // 3] for r in got)


def test_fit_in_tasks_is_the_same(spark):
    rows = corpus(30)
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = g.fit([(t, k) for _, t, k in rows], g.vocabulary(PATH)), g.fit_in_tasks(t.select("lang", "text"), PATH)
    assert a.langs == b.langs and np.allclose(a.prob, b.prob)
    assert g.fit_in_tasks(t.limit(0).select("lang", "text"), PATH).langs == []
