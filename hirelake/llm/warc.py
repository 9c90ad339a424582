"""Zstandard-compressed WARC archives: one dictionary per archive, one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary of the other frames; each of those is
one WARC/1.1 record. Equal payloads are stored once: the row with the smallest page id is a response, others are revisits
(profile identical-payload-digest) that refer to it.

Spark has no writer for binary files. Archives are written by its text writer, one row per file, with an empty skippable
frame as the line separator, which every Zstandard reader passes over. So any file system that Spark knows will do, and a
lost task is simply written again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.session import Scratch

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
ZSTD_MAGIC = 0xFD2FB528
# An empty skippable frame: magic 0x184D2A50, length 0. All bytes are ASCII.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
# Payload bytes that the dictionary of an archive is trained on, and bytes of one payload.
SAMPLE_BYTES, SAMPLE_PART = 512 << 10, 8 << 10
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD_SCHEMA = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
                 "payload_digest string, refers_to long")


class ArchiveError(ValueError):
    """An archive that breaks the format; names file and offset."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    """A header value without blanks, control characters or bytes beyond ASCII."""
    return "".join(chr(b) if 33 <= b <= 126 else f"%{b:02X}" for b in (url or "").encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str | None, payload: bytes, is_revisit: bool, refers_to: int | None) -> bytes:
    """One record; its block is an HTTP response, of which a revisit keeps the head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if is_revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _urn(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary for payloads like these; the samples themselves where there are too few to train on."""
    parts, total = [], 0
    for sample in samples:
        if total >= SAMPLE_BYTES:
            break
        if sample:
            parts.append(sample[:SAMPLE_PART])
            total += len(parts[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(parts)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    """Frames without the content's checksum would hide damage, so each carries one."""
    writer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    return head + b"".join(writer.compress(r) for r in records)


def _archives(archive_bytes: int):
    schema = pa.schema([("archive", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, payloads, size = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([archive(records, train(payloads))], pa.binary())], schema=schema)

        for batch in batches:
            for page_id, url, payload, is_revisit, refers_to in zip(*batch.columns, strict=True):
                body = payload.as_py()
                records.append(record(page_id.as_py(), url.as_py(), body, is_revisit.as_py(), refers_to.as_py()))
                if sum(map(len, payloads)) < SAMPLE_BYTES and not is_revisit.as_py():
                    payloads.append(body[:SAMPLE_PART])
                size += len(records[-1])
                if size >= archive_bytes:
                    yield made()
                    records, payloads, size = [], [], 0
        if records:
            yield made()

    return run


def write_archives(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row into archives below ``path``.

    A null payload is empty. Rows with equal payloads of at least ``least_bytes`` bytes refer to the smallest id among
    them; rows that carry that id, and all smaller payloads, are responses. A null id counts as larger than all others; if
    a payload has null ids only, all its rows are responses. An empty table writes no archive.
    """
    payload: Column = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key"))
    copies = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    )
    # Both sides of the join are plain scans, so that a payload with very many copies is split over tasks.
    joined = rows.join(scratch.table(copies.select("key", "first"), "copies"), "key", "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    made = joined.select("page_id", "url", "payload", is_revisit.alias("is_revisit"), F.col("first").alias("refers_to"))
    files = made.mapInArrow(_archives(archive_bytes), "archive binary").select(F.col("archive").cast("string"))
    files.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of each frame after the dictionary; other skippable frames are passed over."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ArchiveError("offset 0: no dictionary frame")
    length = struct.unpack_from("<I", data, 4)[0]
    stored = data[8:8 + length]
    if len(stored) < length:
        raise ArchiveError("offset 0: dictionary cut short")
    if stored[:4] == struct.pack("<I", ZSTD_MAGIC):
        stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(stored))
    at, view = 8 + length, memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise ArchiveError(f"offset {at}: cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            raise ArchiveError(f"offset {at}: not a frame")
        began, one, parts, step = at, reader.decompressobj(), [], 4096
        while not one.eof:
            if at >= len(data):
                raise ArchiveError(f"offset {began}: frame cut short")
            piece = view[at:at + step]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"offset {began}: {error}") from error
            at += len(piece) - len(one.unused_data)
            step = min(2 * step, 1 << 20)
        yield began, b"".join(parts)
    if at > len(data):
        raise ArchiveError(f"offset {at}: last frame cut short")


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"{what}: bad header line {line[:60]!r}")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields


def _number(fields: dict[str, str], what: str) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise ArchiveError(f"{what}: bad length {text!r}")
    return int(text)


def _page(urn: str, what: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ArchiveError(f"{what}: bad record id {urn!r}")
    inner = urn[10:-1]
    return int(inner) if inner else None


def parse(data: bytes, what: str) -> dict:
    """The row of one record; :class:`ArchiveError` if a header, a length or the digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION.encode():
        raise ArchiveError(f"{what}: no {VERSION} record")
    fields = _fields(lines[1:], what)
    for name in MANDATORY:
        if not fields.get(name):
            raise ArchiveError(f"{what}: no {name}")
    length = _number(fields, what)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{what}: block of {len(rest) - 4} bytes, header says {length}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"{what}: unknown type {kind!r}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError(f"{what}: no HTTP response")
    size = _number(_fields(http.split(b"\r\n")[1:], what), what)
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    refers = None
    if kind == "response":
        if len(payload) != size or digest(payload) != told:
            raise ArchiveError(f"{what}: payload differs from its length or digest")
    else:
        refers = _page(fields.get("warc-refers-to", ""), what)
        if payload or len(told) != 32 or fields.get("warc-profile") != REVISIT_PROFILE:
            raise ArchiveError(f"{what}: bad revisit")
    return {"page_id": _page(fields["warc-record-id"], what), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": told,
            "refers_to": refers}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kinds)
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            rows, size = [], 0
            try:
                for offset, data in frames(content.as_py()):
                    rows.append(parse(data, f"record at {offset}"))
                    size += len(data)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            except ArchiveError as error:
                raise ArchiveError(f"{path.as_py()}: {error}") from error
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """All records of the archives below ``path`` (columns ``RECORD_SCHEMA``); a revisit has a null payload.

    Headers, lengths, checksums and digests are checked; the first fault stops reading and names file and offset. One
    archive is read by one task and held in its memory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(_records, RECORD_SCHEMA)
