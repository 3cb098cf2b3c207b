"""Web archives compressed record by record against a shared dictionary.

An archive is a .warc.zst file: a skippable frame (magic 0x184D2A5D) with a Zstandard dictionary, then one frame for
each WARC record, so a record is read from its offset and the archive's head alone. The dictionary is trained on a
bounded sample of payloads (SAMPLES records of at most SAMPLE_BYTES each); every row is archived.

Of records with equal payloads of at least REVISIT_BYTES, that with the smallest page_id is a response and the others
are revisits. Which is which is settled over (page_id, digest, size) alone; the pages meet those decisions by page_id,
so a payload that a third of all pages share gathers nowhere. A table of written archives commits them: files of lost
or repeated attempts are never read.

Defined cases: a null html is an empty payload; a null url leaves the target out; repeated rows of one page_id and
payload are of one type; a null page_id revisits the smallest id, if there is one; no rows give no archives; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, slices, written

SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 32_768, 65_536
REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 24
DATE = "1970-01-01T00:00:00Z"
_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    offset: int
    length: int


def decisions(pages: DataFrame) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    narrow = digested.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_BYTES)
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    later = narrow.distinct().join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    later = later.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"))
    same = digested["page_id"].eqNullSafe(later["_id"]) & (digested["payload_digest"] == later["_digest"])
    return digested.join(later, same, "left").drop("_id", "_digest")


def dictionary(pages: DataFrame) -> bytes:
    """Trained on a sample that depends on page ids only; without enough to train on, the sample itself."""
    found = pages.where("html IS NOT NULL")
    # about four times as many as are wanted leave their tasks, however many pages there are
    share = min(1.0, 4 * SAMPLES / max(1, found.count()))
    picked = found.select(F.xxhash64("page_id").alias("k"), F.substring("html", 1, SAMPLE_BYTES // 4).alias("html")).where(F.pmod("k", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.orderBy("k", "html").limit(SAMPLES)
    payloads = [r["html"].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[-DICTIONARY_BYTES:]


def _record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    body = b"" if refers_to is not None else _HTTP + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": None if refers_to is None else _PROFILE,
        "WARC-Refers-To": None if refers_to is None else _urn(refers_to),
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(body),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives; returns the table of them: (path, n_records, n_bytes)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    head = dictionary(pages)
    return written(map_batches(decisions(pages), _write, "path string, n_records bigint, n_bytes bigint", folder, head, archive_bytes), "archives")


def _write(batches: Iterator[pa.RecordBatch], folder: str, head: bytes, archive_bytes: int) -> Iterator[dict[str, Any]]:
    where, at = fs.FileSystem.from_uri(folder)
    where.create_dir(at, recursive=True)
    frames = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(head)) if head else zstandard.ZstdCompressor(level=3)
    out, name, n = None, "", 0

    def row() -> dict[str, Any]:
        size = out.tell()
        out.close()
        return {"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]}

    for whole in batches:
        for batch in slices(whole, "html"):
            for values in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = where.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(struct.pack("<II", _MAGIC, len(head)) + head)
                out.write(frames.compress(_record(*values)))
                n += 1
                if out.tell() >= archive_bytes:
                    yield row()
                    out = None
    if out is not None:
        yield row()


def _head(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    magic, size = struct.unpack("<II", data[:8])
    if magic != _MAGIC:
        raise ValueError("an archive begins with its dictionary")
    kept = data[8 : 8 + size]
    return (zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept)) if size else zstandard.ZstdDecompressor()), 8 + size


def _parse(data: bytes, offset: int, length: int) -> Record:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or body[n:] != b"\r\n\r\n":
        raise ValueError(f"no WARC record at {offset}")
    return Record(headers, body[:n].partition(b"\r\n\r\n")[2], offset, length)


def records(path: str) -> Iterator[Record]:
    """All records of an archive, in order."""
    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_file(at) as file:
        data = memoryview(file.read())
    frames, low = _head(data)
    while low < len(data):
        frame = frames.decompressobj()
        # a first guess at the frame's end, so that what follows it isn't copied for each record
        step, record, start = 1 << 16, b"", low
        while not frame.eof and low < len(data):
            part = data[low : low + step]
            record += frame.decompress(part)
            low += len(part) - len(frame.unused_data)
        yield _parse(record, start, low - start)


def read_record(path: str, offset: int, length: int) -> Record:
    """One record by its place, with two reads besides the head."""
    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_file(at) as file:
        size = struct.unpack("<II", file.read_at(8, 0))[1]
        frames, _ = _head(file.read_at(8 + size, 0))
        return _parse(frames.decompressobj().decompress(file.read_at(length, offset)), offset, length)


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, then url, path, offset, length."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, path string, offset bigint, length bigint"
    spread = archives.select("path").repartition(max(1, min(archives.count(), 10_000)), "path")
    return map_batches(spread, _read, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "offset", "length")
    for batch in batches:
        for path in batch.column("path").to_pylist():
            out: list[tuple[Any, ...]] = []
            for r in records(path):
                h = r.headers
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if h["WARC-Type"] == "response" and (hashlib.sha256(r.payload).hexdigest() != digest or len(r.payload) != int(h["X-Payload-Length"])):
                    raise ValueError(f"{path}: the payload at {r.offset} is damaged")
                ids = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                out.append((ids[0], int(h["X-Payload-Length"]), digest, h["WARC-Type"], ids[1], h.get("WARC-Target-URI"), path, r.offset, r.length))
                if len(out) == 4096:
                    yield dict(zip(names, zip(*out, strict=True), strict=True))
                    out = []
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))
