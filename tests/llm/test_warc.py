import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, warc

PAGES = [(1, "http://a/x", "<p>" + "a" * 200), (2, "http://b/ y", "<p>" + "a" * 200), (3, None, "tiny"), (4, "u", "tiny"), (5, "v", None), (6, "w", ""), (7, "é\u0085", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nünï" * 20), (8, "z", "x" * 700_000), (None, "n", "<p>" + "a" * 200), (1, "again", "<p>" + "a" * 200)]


def test_contract_rows(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.op9_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = min(same) if len(raw) >= 100 and sum(h == html for _, _, h in PAGES) > 1 else page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if page == first else "revisit", None if page == first else first))
    assert got == sorted(want, key=str)


def test_payloads_survive_the_round_trip(spark):
    t = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    made = warc.archive(t)
    read = warc.read_archives(made).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in read} == {h or "" for _, _, h in PAGES}
    for r in made.collect():
        raw = b"".join(gzip.decompress(bytes(r.content)[x.offset : x.offset + x.length]) for x in r["index"])
        assert raw == gzip.decompress(bytes(r.content))


def records():
    return [warc.record("response", f"urn:page:{i}", "http://x/", p, hashlib.sha256(p).hexdigest(), len(p)) for i, p in enumerate([b"", b"abc", b"\r\n\r\nWARC/1.1\r\n" * 30, b"z" * 600_000])]


@pytest.mark.parametrize("members", [1, 4])
def test_normaliser_splits_one_stream_and_several(members):
    rs = records()
    whole = gzip.compress(b"".join(rs)) if members == 1 else b"".join(map(gzip.compress, rs))
    sink = io.BytesIO()
    index = warc.normalise(io.BytesIO(whole), sink)
    out = sink.getvalue()
    assert [gzip.decompress(out[x["offset"] : x["offset"] + x["length"]]) for x in index] == rs
    assert sum(x["length"] for x in index) == len(out) and gzip.decompress(out) == b"".join(rs)


def test_files_and_sidecar(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records())))
    n = warc.normalise_file(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"), str(tmp_path / "b.idx"))
    lines = [json.loads(x) for x in (tmp_path / "b.idx").read_text().splitlines()]
    assert n == len(lines) == 4
    head, payload = warc.read_at((tmp_path / "b.warc.gz").read_bytes(), lines[1]["offset"], lines[1]["length"])
    assert payload == b"abc" and head["warc-record-id"] == "<urn:page:1>"


def test_damage_is_an_error():
    whole = gzip.compress(b"".join(records()))
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(whole[:-40]), io.BytesIO())
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"not a record\r\n\r\n")), io.BytesIO())


def test_memory_of_inflation_is_bounded():
    assert max(map(len, warc.inflate(io.BytesIO(gzip.compress(b"0" * 50_000_000))))) <= warc.CHUNK


def test_empty_and_extra_columns(spark):
    t = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("payload", F.lit(0))
    assert warc.read_archives(warc.archive(t)).count() == len(PAGES)
    assert warc.read_archives(warc.archive(t.limit(0))).count() == 0
