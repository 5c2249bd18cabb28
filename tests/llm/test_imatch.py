import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import imatch as m

WORDS = [f"word{i}" for i in range(800)]


def docs_of(n, seed=1):
    rnd = random.Random(seed)
    return [(i * 3 + (i % 7) * 1000, " ".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 5, 40, 200, 900])))) for i in range(n)]


def plain(rows):
    """Order, edited texts, document frequencies and slots by loops; term hashes are those of the engine."""
    out, n = {}, len(rows)
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % n][1] or ""
        cut = len(t) // 3
        out[i] = (t, t[: len(t) - cut] + nxt[:cut], nxt)
    return out


def test_edits_are_the_contract(spark, monkeypatch):
    monkeypatch.setattr(m, "NEIGHBOURS", 7)
    rows = docs_of(120) + [(50_000, None), (50_001, "äöü😀" * 11), (-5, "minus five " * 9)]
    want = plain(rows)
    got = {r.doc_id: r for r in m.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    for i, (t, e, _) in want.items():
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def term_hashes(spark, words):
    return {r[0]: r[1] % 2**64 for r in spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", F.xxhash64("w")).collect()}


def plain_slots(text, hashed, band, df):
    """Bits, slots as ``{subset: sum}`` and whether no term is in the band, of a text of lower-case words."""
    every = {hashed[w] for w in text.split()}
    bits = m.MIN_BITS
    while 2**bits < len(every) and bits < m.MAX_BITS:
        bits += 1
    own = every & band
    kept = every if len(every) < m.FEW else own or {h for h in every if df.get(h, 0) > 1} or every
    out = {}
    for h in kept:
        u = h >> 1
        subset = u >> (63 - bits)
        out[subset] = (out.get(subset, 0) + u % 2**m.HASH_BITS) % 2**m.HASH_BITS
    return bits, out, not own


def plain_likeness(a, b):
    bits = min(a[0], b[0])
    sums = []
    for own, slots, _ in (a, b):
        s = {}
        for k, v in slots.items():
            s[k >> (own - bits)] = (s.get(k >> (own - bits), 0) + v) % 2**m.HASH_BITS
        sums.append(s)
    both = set(sums[0]) | set(sums[1])
    return sum(sums[0].get(k) == sums[1].get(k) for k in both) / len(both) if both else 0.0


def plain_text(slots, bare_hash):
    bits, own, bare = slots
    body = ".".join(f"{v:x}" for v in sorted(k * 2**m.HASH_BITS + x for k, x in own.items()))
    return f"{'=' * bare}{bits:02d}:{body}" if own else bare_hash


def held_against_loops(spark, rows):
    t = spark.createDataFrame(rows, "doc_id long, text string")
    edits = plain(rows)
    hashed = term_hashes(spark, {w for x in edits.values() for y in x for w in y.split()})
    band = {r[0] % 2**64 for r in m.band(t).collect()}
    df = {}
    for _, x in rows:
        for w in set((x or "").split()):
            df[hashed[w]] = df.get(hashed[w], 0) + 1
    got = {r.doc_id: r for r in m.edited_and_next(t).collect()}
    assert len(got) == len(rows)
    for i, (x, e, nxt) in edits.items():
        a, b, c = (plain_slots(y, hashed, band, df) for y in (x, e, nxt))
        assert got[i].fingerprint == plain_text(a, got[i].fingerprint) and got[i].edited_fingerprint == plain_text(b, got[i].edited_fingerprint)
        assert got[i].near_edited == pytest.approx(1.0 if x == e else plain_likeness(a, b))
        assert got[i].near_next == pytest.approx(1.0 if x == nxt else plain_likeness(a, c))
    return df, band, got


def test_slots_and_likeness_are_those_of_loops(spark):
    rows = docs_of(150, 2) + [(90_000, None), (90_001, " "), (90_003, "word1 word2"), (90_006, "only these are here")]
    df, band, _ = held_against_loops(spark, rows)
    assert band == {h for h, c in df.items() if m.MIN_DF <= c <= max(m.MIN_DF, int(m.MAX_SHARE * len(rows)))}


def test_loops_agree_on_crowded_subsets_and_cut_words(spark, monkeypatch):
    monkeypatch.setattr(m, "MIN_BITS", 0)
    monkeypatch.setattr(m, "MAX_BITS", 3)  # all of a text's terms in eight subsets
    monkeypatch.setattr(m, "AHEAD", 2)
    rnd = random.Random(5)
    held_against_loops(spark, [(i, " ".join(rnd.choices(WORDS + ["lone%d" % i, "w", "wo", "wor", "word"], k=rnd.choice([3, 30, 150])))) for i in range(120)])


def test_a_very_long_text(spark):
    rnd = random.Random(9)
    many = [f"t{i}" for i in range(30_000)]
    rows = [(0, " ".join(many + rnd.choices(many, k=60_000))), (1, " ".join(rnd.choices(many, k=20_000)))] + [(2 + i, " ".join(rnd.choices(many, k=50))) for i in range(40)]
    _, _, got = held_against_loops(spark, rows)
    assert got[0].near_edited > 0.2


def test_copies_edits_and_strangers(spark):
    rnd = random.Random(7)
    many = [f"term{i}" for i in range(12_000)]
    rows = [(i, " ".join(rnd.choices(many, k=300))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, rows[0][1])] * 3
    got = m.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(by[i] == by[1000 + i] and len(by[i]) == 1 for i in range(20)) and len(by[2000]) == 1
    some = [r for r in got if r.doc_id < 150]
    assert sum(r.near_edited for r in some) / len(some) > 0.25 > 0.1 > sum(r.near_next for r in some) / len(some)
    assert sorted(r.near_next for r in got if r.doc_id == 2000)[-2:] == [1.0, 1.0]


@pytest.mark.parametrize("rows", [[], [(1, "alone here")], [(1, None)], [(None, "x y z"), (None, "x y z"), (2, "q")], [(2**62, "far"), (-(2**62), "apart")]])
def test_small_tables(spark, rows):
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("fingerprint", F.lit(2))
    got = m.edited_and_next(t).collect()
    assert len(got) == len(rows) and all(r.fingerprint and r.edited_fingerprint for r in got)


def test_no_python_in_the_plan(spark):
    t = m.edited_and_next(spark.createDataFrame(docs_of(10), "doc_id long, text string"))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_plain_fingerprints_are_the_same(spark):
    rows = docs_of(80, 4) + [(90_000, None), (90_001, "")]
    t = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    a = sorted((r.doc_id, r.fingerprint) for r in m.edited_and_next(t).collect())
    b = sorted((r.doc_id, r.fingerprint) for r in m.fingerprints(t).collect())
    assert a == b


def test_every_term_in_the_band_counts(spark):
    many = [f"term{i}" for i in range(1500)]
    rnd = random.Random(3)
    base = [" ".join(rnd.sample(many, 700)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base * 2)] + [(100 + i, f"other{i} text{i}") for i in range(400)]
    words = base[0].split()
    rows += [(1000 + k, " ".join(words[:k] + words[k + 1 :])) for k in range(0, 700, 100)]
    got = {r.doc_id: r.fingerprint for r in m.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[4] and len({got[0]} | {got[1000 + k] for k in range(0, 700, 100)}) == 8
    assert got == {r.doc_id: r.fingerprint for r in m.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_copies_that_are_a_third_of_the_rows(spark):
    rnd = random.Random(11)
    base = rnd.sample([f"base{i}" for i in range(400)], 300)
    copies = []
    for i in range(100):
        words = list(base)
        for j in range(3):
            words[rnd.randrange(300)] = f"own{i}x{j}"
        copies.append((2 * i, " ".join(words)))
    rows = copies + [(1001 + 2 * i, " ".join(rnd.choices(WORDS, k=60))) for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in m.edited_and_next(t).collect()}
    mine = [got[i] for i, _ in copies]
    assert not any(r.fingerprint.startswith("=") for r in mine)
    assert sum(r.near_next for r in mine[1:]) / 99 > 0.6 and sum(r.near_edited for r in mine[1:]) / 99 > 0.4  # two thirds of its terms stay
    assert {i: r.fingerprint for i, r in got.items()} == {r.doc_id: r.fingerprint for r in m.fingerprints(t).collect()}


def test_texts_of_frequent_words_are_not_without_terms(spark):
    rnd = random.Random(13)
    few = [f"the{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.sample(few, 30))) for i in range(100)] + [(200, " ".join(few)), (201, " ".join(few[:-1] + ["odd"]))]
    got = {r.doc_id: r for r in m.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.fingerprint.startswith("=") and ":" in r.fingerprint for r in got.values())
    assert 0.5 < got[201].near_next < 1
