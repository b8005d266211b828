"""WARC archives with a Zstandard dictionary: writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame for each record, compressed with
that dictionary, so a record can be read alone. Every task writes archives of about `archive_bytes` of records; each archive trains its
dictionary on its own first records (at most `sample_bytes` of them, the first 128 KiB of each; a dictionary only makes records smaller,
it decides nothing), so nothing about the whole table passes through the driver, and an archive needs no other file. Archives lie in the cluster's shared folder; a manifest table, written through Spark's commit protocol,
names those of the tasks that counted, so a task that ran twice leaves a stray file which no one reads.

Edge cases: a null payload is the empty payload; equal payloads (SHA-1, SHA-256 and length) are stored once, in the record with the
smallest page_id, unless they are shorter than `min_bytes`; rows that repeat a page_id with the same payload are one response and
otherwise revisits of that id; a null page_id is never referred to while another id has the payload; null URLs become empty; characters
that would end a header line are percent-encoded; an empty table gives no archive and no row. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, new_folder, table, written

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A WARC/1.1 record. A revisit has the headers of its full payload and an empty block."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length differs from its header")
    return headers, rest[:size]


def dictionary_of(records: list[bytes], sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the records, or an empty one where they are too few or too small to train on."""
    sample, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 20, 1024)), sample, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: list[bytes], level: int = 3) -> None:
    trained = dictionary_of(records)
    out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, **options)
    for r in records:
        out.write(compressor.compress(r))


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with its dictionary")
    trained = data[8 : 8 + size]
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    decompressor = zstandard.ZstdDecompressor(**options)
    view = memoryview(data)[8 + size :]
    while len(view):
        one = decompressor.decompressobj()
        yield one.decompress(view)
        view = view[len(view) - len(one.unused_data) :]


def with_decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    Digests meet before payloads move. The smallest page_id of each payload is a partial aggregate, so a payload that a third of the pages
    share comes to one row per task; it is written down, and pages' ids and digests join it, which Spark can split. Payloads then go by page
    and digest, so that pages with one payload are dealt like all others.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "key": F.unhex(F.sha2("payload", 256))})
    slim = rows.filter(F.length("payload") >= min_bytes).select("page_id", "key")
    groups = slim.groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first_id IS NOT NULL")
    groups = written(groups.select("key", "first_id"), "warc-groups")
    revisits = slim.join(groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("_page"), F.col("key").alias("_key"), "first_id").distinct()
    revisits = written(revisits, "warc-revisits")
    drop(groups)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("key") == F.col("_key"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "sha1", F.col("first_id").alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest: path, records, raw_bytes, stored_bytes."""
    folder = new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush():
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            info = [b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:" + path.rpartition("/")[2].encode() + b">\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
            with store.open_output_stream(path) as out:
                write_archive(out, info + waiting)
                stored = out.tell()
            return pa.RecordBatch.from_pylist([{"path": path, "records": len(waiting), "raw_bytes": size, "stored_bytes": stored}], schema=_MANIFEST)

        for b in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                waiting.append(record(page_id, url, payload, base64.b32encode(sha1).decode(), refers_to))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    found = with_decisions(pages, min_bytes).mapInArrow(run, "path string, records long, raw_bytes long, stored_bytes long")
    manifest = written(found, "warc-manifest")
    manifest.folder_ = folder
    return manifest


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("stored_bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _id(value: str | None):
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All response and revisit records of the manifest's archives. Digest and length of a response are checked against its block;
    a revisit has none of its own and carries those of its full payload. Raises an error on a damaged archive."""
    folder = manifest.folder_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path) as f:
                    data = f.read()
                rows, size = [], 0
                for raw in read_archive(data):
                    h, block = parse(raw)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (len(block) != length or base64.b32encode(hashlib.sha1(block).digest()).decode() != digest):
                        raise ValueError(f"the payload of {h['warc-record-id']} differs from its headers")
                    rows.append((_id(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _id(h.get("warc-refers-to")), digest, length, block if payloads else None))
                    size += len(raw)
                    if len(rows) >= 4096 or size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(run, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_bytes_of(records: list[bytes]) -> bytes:
    out = io.BytesIO()
    write_archive(out, records)
    return out.getvalue()


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM p
"""
