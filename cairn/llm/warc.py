"""WARC archives: writing, and a normaliser for monolithic gzip files.

Archives that were compressed as one gzip stream cannot be read at a record. The normaliser inflates such a
stream once, piece by piece, rewrites every record as a gzip member of its own, and keeps a sidecar index with each
member's offset and length, by which any record can be read alone.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.staging import Stage

MIN_DEDUP = 100
#: Bytes of records in an archive, about; a single larger record is an archive of its own.
ARCHIVE_BYTES = 2_000_000
CHUNK = 1 << 18
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,type:string>>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One uncompressed WARC/1.1 record around an HTTP response; a revisit leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the payload after the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields |= {"http-" + k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return fields, payload


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file in bounded pieces, whether it is one stream or several members."""
    engine, ready = zlib.decompressobj(31), b""
    while data := ready or source.read(CHUNK):
        ready = b""
        if engine.eof:
            engine = zlib.decompressobj(31)
        out = engine.decompress(data, CHUNK)
        if out:
            yield out
        ready = engine.unused_data if engine.eof else engine.unconsumed_tail
    if not engine.eof:
        raise ValueError("the gzip stream ends early")


def records(source: BinaryIO) -> Iterator[bytes]:
    """Each record of a gzip WARC file, uncompressed, in one pass over the stream."""
    held = bytearray()
    need = 0
    for piece in inflate(source):
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                size = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the last WARC record is cut off")


def member(raw: bytes, level: int = LEVEL) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def normalise(source: BinaryIO, sink: BinaryIO, level: int = LEVEL) -> list[dict]:
    """Rewrites ``source`` into ``sink`` with a member for each record; returns the sidecar index."""
    index, at = [], 0
    for raw in records(source):
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in raw[: raw.index(b"\r\n\r\n")].decode().split("\r\n")[1:]))
        made = member(raw, level)
        sink.write(made)
        index.append({"offset": at, "length": len(made), "record_id": fields["warc-record-id"].strip("<>"), "type": fields["warc-type"]})
        at += len(made)
    return index


def normalise_file(source: str, target: str, sidecar: str, level: int = LEVEL) -> int:
    """Local files: writes ``target`` and a JSON-lines ``sidecar``; returns the number of records."""
    with open(source, "rb") as f, open(target, "wb") as g:
        index = normalise(f, g, level)
    with open(sidecar, "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in index)
    return len(index)


def read_at(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    return parse(gzip.decompress(content[offset : offset + length]))


def _id(page: int | None, part: int, k: int) -> str:
    return f"urn:page:{page}" if page is not None else f"urn:row:{part}:{k}"


def deduplicated(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(id, url, payload, payload_bytes, payload_digest, refers_to)``: what each record is to hold.

    Of equal payloads of at least ``MIN_DEDUP`` bytes the rows with the smallest id are responses, and all others
    refer to it. Rows with a null id are responses unless another row of their payload has an id.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= MIN_DEDUP).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "payload_digest", "left").select("id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_monolithic(rows: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(archive, content)``: records of each partition in gzip WARC archives that are one stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, k = TaskContext.get().partitionId(), 0, 0
        out, size, engine = [], 0, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(out) + engine.flush()], pa.binary())], names=["archive", "content"])

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for r in range(batch.num_rows):
                page, url, payload, n, digest, ref = (c[r].as_py() for c in cols)
                engine = engine or zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record("response" if ref is None else "revisit", _id(page, part, k), url, payload, digest, n, None if ref is None else _id(ref, 0, 0))
                out.append(engine.compress(raw))
                size, k = size + len(raw), k + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, size, engine, made = [], 0, None, made + 1
        if engine:
            yield close()

    return rows.select("id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "archive string, content binary")


def normalise_archives(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(archive, content, index)``: each archive with a member for each record, and its sidecar index."""
    entry = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                sink = io.BytesIO()
                index = normalise(io.BytesIO(content.as_py()), sink, level)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([sink.getvalue()], pa.binary()), pa.array([index], entry)], names=["archive", "content", "index"])

    return archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, index {INDEX}")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record, read at its offset in the sidecar index: ``(record_id, record_type, uri, payload_bytes,
    payload_digest, refers_to, payload)``. The digest of a response is that of the bytes read; it must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for content, index in zip(batch.column(0), batch.column(1)):
                raw, rows = content.as_py(), []
                for x in index.as_py():
                    head, payload = read_at(raw, x["offset"], x["length"])
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{x['record_id']}: the payload does not match its digest")
                    ref = head.get("warc-refers-to")
                    rows.append((x["record_id"], kind, head.get("warc-target-uri"), len(payload) if kind == "response" else int(head["http-content-length"]), digest, ref and ref.strip("<>"), payload if kind == "response" else None))
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("content", "index").mapInArrow(run, "record_id string, record_type string, uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and returns the staged ``(archive, content, index)``.

    A null html is an empty payload; a null url leaves the target out; repeated rows are separate records; a null id
    gets a record id of its own. An empty table gives no archive. Payloads of any length are written whole, each within one
    archive; of equal payloads the smallest id is the response, of equal ids any one. Other columns are not read.
    """
    stage = Stage(pages.sparkSession, "warc")
    whole = stage.put(write_monolithic(deduplicated(pages, id_col, html_col, url_col)))
    out = stage.put(normalise_archives(whole))
    stage.drop(whole)
    return out
