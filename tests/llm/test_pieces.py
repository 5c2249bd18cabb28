import random
import struct

import pytest
from pyspark.sql import functions as F

from cairn.llm import pieces as p
from cairn.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
TEXTS = ["", None, "Hello world", "  two  spaces ", "tabs\tand\nlines\r\n", "naïve café ñandú", "漢字 😀 mixed\u0007", "▁mark", "a" * 300, "the the theory there", "\u0000nul", "x " * 3000]


def brute(v, word):
    """Best sum over all segmentations, by recursion from the right end."""
    memo = {len(word): 0.0}
    for i in range(len(word) - 1, -1, -1):
        best = None
        for j in range(i + 1, min(len(word), i + v.longest if hasattr(v, "longest") else len(word)) + 1):
            hit = v.known.get(word[i:j])
            score = hit[1] if hit else v.unknown_score if j == i + 1 else None
            if score is not None and (best is None or score + memo[j] > best):
                best = score + memo[j]
        memo[i] = best
    return memo[0]


def test_segments_are_best_and_shared_prefixes_agree(tmp_path):
    rnd = random.Random(4)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), (p.MARK, -3.5, 1)]
    pieces += [(m + t, -rnd.uniform(1, 9), 1) for t in sorted({"".join(rnd.choices("abc", k=k)) for k in (1, 1, 2, 3, 4) for _ in range(30)} | set("abc")) for m in ("", p.MARK)]
    v = p.Pieces(unigram_file(tmp_path / "u.model", pieces))
    assert not v.merged
    words = {p.MARK + "".join(rnd.choices("abcz", (5, 5, 5, 1), k=rnd.randint(1, 12))) for _ in range(300)}
    words |= {w[:k] for w in list(words) for k in (2, 4)}
    made = v.segment(sorted(words))
    for w in words:
        got = sum(v.unknown_score if i == v.unk else v.known[v.text[i]][1] for i in made[w])
        assert got == pytest.approx(brute(v, w)), w
        assert made[w] == v.segment([w])[w]


def test_words_that_share_prefixes_are_merged_alike():
    v, rnd = p.Pieces(PATH), random.Random(4)
    words = {p.MARK + "".join(rnd.choices(["th", "e", "ion", "er", "qu", "ß", "z"], k=rnd.randint(1, 7))) for _ in range(300)}
    words |= {w[:k] for w in list(words) for k in (2, 4)} | {"▁▁▁", "▁▁▁x", "▁"}
    for w, ids in v.segment(sorted(words)).items():
        assert [v.text[i] for i in ids] == merged(v, w)


def unigram_file(path, pieces):
    """A unigram model file with these pieces and scores, written field by field."""

    def field(n, body):
        size, out = len(body), bytearray([n << 3 | 2])
        while size > 127:
            out.append(size & 127 | 128)
            size >>= 7
        return bytes(out) + bytes([size]) + body

    made = b"".join(field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([kind])) for t, s, kind in pieces)
    made += field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    path.write_bytes(made)
    return str(path)


def test_ids_are_the_librarys_for_a_unigram_model(tmp_path):
    from sentencepiece import SentencePieceProcessor

    rnd = random.Random(9)
    parts = {"".join(rnd.choices("abcde", k=k)) for k in (1, 2, 3, 4, 5) for _ in range(60)} | set("abcde")
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), (p.MARK, -3.5, 1)]
    pieces += [(m + t, -rnd.uniform(1, 4) * len(t) ** 0.6, 1) for t in sorted(parts) for m in ("", p.MARK)]
    path = unigram_file(tmp_path / "u.model", pieces)
    sp, e = SentencePieceProcessor(model_file=path), p.PieceEncoder(path)
    for _ in range(300):
        t = " ".join("".join(rnd.choices("abcde", k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 6)))
        assert e.encode([t])[0].tolist() == sp.encode(t), t


def test_ids_are_the_librarys_for_merges_by_rank():
    from sentencepiece import SentencePieceProcessor

    sp, e = SentencePieceProcessor(model_file=PATH), p.PieceEncoder(PATH)
    rnd = random.Random(3)
    some = [sp.id_to_piece(i) for i in range(300, 32_000)]
    texts = ["".join(rnd.choices(some, k=rnd.randint(1, 8))).replace(p.MARK, " ") for _ in range(800)]
    texts += ["".join(rnd.choices("abcdefghij therning01 é漢", k=rnd.randint(1, 60))) for _ in range(800)]
    texts += ["x" * 500, "aaaa" * 100 + " " + "ab" * 200, "naïve café 12345 !!??"]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == sp.encode(t), t


def merged(v, text):
    """Pieces by merging the best pair, the leftmost of equal ones, until none is left."""
    out = list(text)
    while pairs := [(v.known[a + b][1], -i) for i, (a, b) in enumerate(zip(out, out[1:])) if a + b in v.known]:
        i = -max(pairs)[1]
        out[i : i + 2] = [out[i] + out[i + 1]]
    return out


def test_neighbours_are_those_that_merging_leaves_apart():
    v, rnd = p.Pieces(PATH), random.Random(4)
    ids = [i for i, _ in v.known.values()]
    near = rnd.sample(ids, 300) + [v.known[c][0] for c in "aeithnrs"]
    for i in near:
        assert v.run(i)[0] == (merged(v, v.text[i]) == [v.text[i]])
    ends = [0, 0]
    for _ in range(3000):
        a, b = rnd.choice(near), rnd.choice(near)
        if v.run(a)[0] and v.run(b)[0]:
            want = merged(v, v.text[a] + v.text[b]) == [v.text[a], v.text[b]]
            assert v.neighbours(a, b) == want
            ends[want] += 1
    assert min(ends) > 100


def test_round_trip(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (2, TEXTS[2])], "doc_id long, text string").withColumn("ids", F.lit("mine"))
    e = p.encode(t, PATH)
    rows = e.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = TEXTS[r.doc_id] if r.doc_id is not None else "no id"
        assert r.exact == (want is None or p.MARK not in want), want
        assert r.n_ids == len(r["ids"]) and (r.n_ids > 0) == bool(want)
    back = {r[0]: r[1] for r in p.decode(e.where("doc_id is not null").select("doc_id", "ids"), PATH).collect()}
    assert all(back[i] == (x or "").replace(p.MARK, " ") for i, x in enumerate(TEXTS))
    assert p.encode(t.limit(0), PATH).count() == 0


def test_decoding_is_the_librarys():
    from sentencepiece import SentencePieceProcessor

    sp, v, e = SentencePieceProcessor(model_file=PATH), p.Pieces(PATH), p.PieceEncoder(PATH)
    for t in TEXTS:
        if t:
            ids = e.encode([t])[0].tolist()
            assert v.decode(ids) == sp.decode(ids)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(p, "KEPT", 40)
    monkeypatch.setattr(p, "PAIRS_KEPT", 3)
    e = p.PieceEncoder(PATH)
    for i in range(6):
        assert e.pieces.decode(e.encode([f"word{i} other{i}"])[0].tolist()) == f"word{i} other{i}"
        assert len(e.known) < 10
