import hashlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import alignment as al
from cairn.llm.queries import tokenizer_file
from test_token_counts import odd_texts

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def of():
    return al.Aligner(A, B)


def brute(of, text):
    """Groups and links of a whole text, token by token."""
    if not text:
        return [], []
    ids = of.a.own.encode(" " + text, add_special_tokens=False).ids, of.b.encode(text)
    parts = [of.a_bytes[i] for i in ids[0]], [of.b_bytes[i] for i in ids[1]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], []
    spans = [[(sum(map(len, p[:i])), sum(map(len, p[: i + 1])), t) for i, t in enumerate(x)] for p, x in zip(parts, ids)]
    links = [(a, b) for s, e, a in spans[0] for u, v, b in spans[1] if s < v and u < e]
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = ["|".join(",".join(str(t) for _, e, t in side if low < e <= high) for side in spans) for low, high in zip([0, *ends], ends)]
    return groups, links, len(ids[0]), len(ids[1])


def expected(of, texts):
    found = [brute(of, t) for t in texts]
    count = Counter(x for f in found for x in f[1])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for f in found:
        groups, links = f[:2]
        text = ";".join(groups)
        out.append((*(f[2:] or (0, 0)), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count


def test_table_equals_brute_force(spark, of):
    texts = [None, "", " ", *odd_texts(400, 25), *["the same sentence again"] * 9]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, `a.b` int").repartition(4)
    got = al.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, count = expected(of, texts)
    rows = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in got.collect())
    assert rows == sorted((i or -1, *w) for i, w in enumerate(want))
    assert any("▁" in (t or "") and w[0] == 0 for t, w in zip(texts, want))  # bytes differ: no tokens
    pairs = al.Alignment(docs, A, B).counts.table(spark)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == count


def test_groups_are_written_on_wish(spark, of):
    docs = spark.createDataFrame([(1, "Some words, ñandú 漢字"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in al.align(docs, A, B, groups=True).collect()}
    assert got[1].groups == ";".join(brute(of, "Some words, ñandú 漢字")[0]) and got[2].groups == ""
    assert al.align(docs.limit(0), A, B).count() == 0


def test_long_text_without_a_safe_place(spark, of):
    docs = spark.createDataFrame([(1, "ab漢" * 20_000), (2, "x y")], "doc_id long, text string")
    r = {r.doc_id: r for r in al.align(docs, A, B).collect()}[1]
    assert r.n_links == r.n_a + r.n_b - r.n_groups > 20_000


def test_partial_counts_survive_forgetting(spark, of, monkeypatch):
    texts = odd_texts(300, 25, seed=4)
    aligner = al.Aligner(A, B)
    monkeypatch.setattr(al, "aligner", lambda *_: aligner)
    whole = al.summed(*(np.concatenate(x) for x in zip(*((np.array([b << 32 | a for a, b in brute(of, t)[1]], np.int64),) * 2 for t in texts))))[0]
    found = []
    for some in (texts[:150], texts[150:]):
        for _, _, numbers, _ in al.numbered_texts(aligner, some):
            found.append(aligner.links(numbers)[0])
        aligner.forget()
    assert np.array_equal(np.unique(np.concatenate(found)), whole)


def test_summed():
    keys, n = al.summed(np.array([5, 1, 5, 3]), np.array([1, 2, 4, 8]))
    assert keys.tolist() == [1, 3, 5] and n.tolist() == [2, 8, 5]
    keys, n = al.summed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(keys) == len(n) == 0


def test_shards_hold_runs_that_cross_batches(spark, tmp_path):
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = [(b << 32 | a, 1 + a % 3) for b in range(20) for a in range(9) for _ in range(5)]
        partial = spark.createDataFrame(rows, "key bigint, n bigint").repartition(3)
        found = al.PairCounts(partial, f"file://{tmp_path}/shards", 25)
    finally:
        for k in settings:
            spark.conf.unset(k)
    want = Counter()
    for k, n in rows:
        want[k] += n
    found.open()
    keys = np.array(sorted(want))
    assert found.of(keys).tolist() == [want[k] for k in keys.tolist()] and len(found.names) > 1
    assert found.top.tolist() == [15] * 20 + [0] * 5
    assert found.of(keys[::7]).tolist() == [want[k] for k in keys[::7].tolist()]
