import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import simhash

WORDS = [f"w{i}" for i in range(400)]


def plain(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, bits=4):
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= bits) + i + 1:
            a, b = sorted((find(ids[i]), find(ids[j])))
            parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "a b c", "A b\x0bC d e", "Ünï Code stays one two", "x " * 5000, "the same the same the same the same"])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == plain(text)


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # large buckets go through pairs of chunks
    rnd = random.Random(5)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 300))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(base)]
    long = " ".join(rnd.choices(WORDS, k=800)).split()
    for i in range(60):  # a crowd of near copies
        w = list(long)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, base[i % 7]) for i in range(40)] + [(3000, None), (3001, ""), (3002, "  ")]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [i for i, _ in rows]
    fps = [plain(t) for _, t in rows]
    want = components(ids, fps)
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(f % 2**64 == p for (f, _), p in zip((got[i] for i in ids), fps))


def test_planted_distances_link_up_to_four_bits(spark):
    rnd = random.Random(1)
    rows, node = [], 0
    for d in range(8):
        for _ in range(50):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), d):
                b ^= 1 << bit
            for x in {a, b}:
                rows.append((x - 2**64 if x >> 63 else x, node))
                node += 1
    t = spark.createDataFrame(rows, "fp long, node long").dropDuplicates(["fp"])
    found = {tuple(sorted(r)) for r in simhash.links(t).collect()}
    fp = dict((n, f % 2**64) for f, n in rows)
    want = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4}
    assert {p for p in want} == {p for p in found}


def test_pivot_filter_never_drops_a_near_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    gap = np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(0)
    assert (gap <= np.bitwise_count(a ^ b)).all()


def test_nulls_repeats_extra_columns_and_empty(spark):
    t = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e")], "doc_id long, text string").withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1.5)).withColumn("node", F.lit(0))
    got = sorted(((r[0], r[2]) for r in simhash.near_duplicates(t).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 7), (None, None)]
    assert simhash.near_duplicates(t.limit(0)).count() == 0


def test_more_blocks_with_more_fingerprints_find_the_same():
    assert [simhash.agreeing(n) for n in (10, 10**6, 10**8, 10**10)] == [2, 2, 3, 5]


@pytest.mark.parametrize("t", [2, 3, 4])
def test_links_do_not_depend_on_the_blocks(spark, monkeypatch, t):
    monkeypatch.setattr(simhash, "agreeing", lambda n, bits=4: t)
    test_planted_distances_link_up_to_four_bits(spark)


def test_repeated_ids_with_other_texts_stay(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices(WORDS, k=120))
    known = text()
    rows = [(1, known, "a")]
    own = [text() for _ in range(10)]
    for i, t in enumerate(own):
        rows += [(10 + i, known, "b"), (10 + i, t, "c")]
    rows += [(None, known, "d"), (None, own[0], "e"), (None, "quite another text", "f"), (50, None, "g"), (51, "", "h"), (10, own[0], "c")]
    t = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("__id", F.lit(1)).withColumn("t", F.lit(2))
    got = simhash.one_of_each(t)
    assert got.columns == t.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, known), *((10 + i, x) for i, x in enumerate(own)), (None, "quite another text"), (50, None)], key=str)
    assert simhash.one_of_each(t.limit(0)).count() == 0
