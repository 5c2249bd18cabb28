import random

import numpy as np
import pytest

from cairn.llm import token_counts as tc
from cairn.llm.chunks import json_layout, sections
from cairn.llm.queries import tokenizer_file

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
ODD = [*"ab1. \n\t'sé́ñ漢 　​\x1c\x85ΣσA_▁😀\r\x00", "  ", " ", "<|endoftext|>", " <|endoftext|> ", "'ll ", "hello", "<0x0A>", "<s>"]


def odd_texts(n, longest=40, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("file", FILES)
def test_counts_are_the_librarys(file, monkeypatch):
    c = tc.Counter(tokenizer_file(file))
    assert c.cut
    texts = odd_texts(3000)
    want = list(c.library(texts))
    assert c.count(texts).tolist() == want
    monkeypatch.setattr(tc, "SECTION", 7)
    assert [int(c.count(c.sections(t)).sum()) for t in texts] == want
    assert max(len(c.sections(t)) for t in texts) > 3


def test_unknown_layout_gets_whole_texts(tmp_path):
    import json

    spec = json.load(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    c = tc.Counter(str(tmp_path / "other.json"))
    texts = odd_texts(200)
    assert json_layout(str(tmp_path / "other.json")) is None and not c.cut
    assert c.count(texts).tolist() == list(c.library(texts)) and c.sections("a b c") == ["a b c"]


def test_sections_lose_only_the_spaces_at_the_cuts():
    for t in odd_texts(500):
        assert " ".join(sections(t, 5)) == t
    assert sections("a" * 50, 5) == ["a" * 50] and sections("", 5) == [""]


def test_balanced_ranges():
    w = [3, 3, 3, 20, 1, 0, 9]
    assert list(tc.balanced(w, 9)) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert list(tc.balanced([], 9)) == []


def test_whole_table(spark, monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    long = " ".join(f"word{i} ñandú" for i in range(60_000))
    texts = [None, "", "  \n ", long, "x" * 400_000, "<|endoftext|> a", *odd_texts(300), *["same text"] * 5]
    rows = [(i if i % 50 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `a.b` int").repartition(3)
    got = tc.count_tokens(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    whole = tc.json_tokenizer(path)
    want = sorted((str(i), len((t or "").encode()), n, n > 2048) for (i, t, *_), n in zip(rows, (len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert tc.count_tokens(docs.limit(0), path).count() == 0
    limit = want[10][2]
    assert not any(r.over_limit for r in tc.count_tokens(docs, path, limit=limit).collect() if r.n_tokens == limit)


def test_cache_is_forgotten(monkeypatch):
    c = tc.Counter(tokenizer_file("word_bpe_49k.json"))
    monkeypatch.setattr(tc, "KEPT", 100)
    for texts in (odd_texts(50, seed=s) for s in range(5)):
        assert c.count(texts).tolist() == list(c.library(texts))
    assert np.array_equal(c.count([]), [])
