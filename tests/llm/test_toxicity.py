import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity as t

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ga", "le") for b in ("nan", "rol", "tim", "mus", "sed", "dop", "pla")]


def corpus(n, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = rnd.choices(WORDS, k=rnd.randint(10, 300))
        bad = i % 6 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["grobnik", "vextar" + rnd.choice("abcdefgh") + "um", "vextar" + rnd.choice("klmnop") + "is"])
        elif i % 6 == 1:
            words[rnd.randrange(len(words))] = "mister grobnik"  # a name: harmless
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.mark.parametrize(
    "text, folded",
    [("GROBNIK", "grobnik"), ("gr0bn1k", "grobnik"), ("grоbnіk", "grobnik"), ("ｇｒｏｂ", "grob"), ("gro​bnik", "grobnik"), ("a$$et", "asset"), ("scum$$$", "scum$$$"), ("in 1999, 42!", "in 1999, 42!"), (None, ""), ("", "")],
)
def test_folding(text, folded):
    assert t.fold(text) == folded


def test_lexicon_terms_stems_and_exceptions():
    lex = t.learn([(x, y) for _, x, y in corpus(900)])
    assert any("grobnik".startswith(c.rstrip("*")) for c in lex.terms) and any(c.startswith("vextar"[:4]) and c.endswith("*") for c in lex.terms)
    assert all(not w.startswith(c.rstrip("*")) for c in lex.terms for w in WORDS)
    assert "mister grobnik" in lex.exceptions
    for bad in ("you grobnik", "a GR0BNIK here " + "bananan " * 50, "vextarzum", "such a grоbnіk"):
        assert lex.score(bad) >= 0.5, bad
    for good in ("good mister grobnik", "bananan corol", "hexgrobnik", "", None):
        assert lex.score(good) < 0.5, good


def test_hits_equal_a_plain_scan():
    lex = t.Lexicon({"abc": 2.0, "abc*": 1.0, "abcd*": 3.0, "zz": 1.0}, frozenset({"not abc"}))
    text = t.fold("abc abcx abcdy xabc not abc zz zzz ab-abc abc")
    want = 0.0
    words = [(m.start(), m[0]) for m in t._WORD.finditer(text)]
    for k, (_, w) in enumerate(words):
        own = [v for c, v in lex.terms.items() if (c.endswith("*") and w.startswith(c[:-1])) or w == c]
        before = words[k - 1][1] if k else ""
        if own and f"{before} {w}" not in lex.exceptions:
            want += max(own)
    assert lex.weight(text) == pytest.approx(want)


def test_length_normalises():
    lex = t.Lexicon({"bad": 5.0})
    assert lex.features("bad")[1] > lex.features("bad " + "fine " * 5000)[1] > 0


def test_held_out_documents(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r.doc_id: r.score for r in t.score(docs, labels, learn).collect()}
    held = docs.where(~learn).select("doc_id").toPandas().doc_id
    assert all((got[i] >= t.LIMIT) == bool(rows[i][2]) for i in held)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string").withColumn("score", F.lit(True))
    got = t.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
    assert len(got) == 3 and all(0 <= r.score < 0.5 for r in got)
    assert t.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).count() == 0
