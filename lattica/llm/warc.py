"""WARC archives (operator 7): a deduplicating writer and a salvaging reader.

The writer turns each page into a WARC/1.1 record: a `response`, or, where an equal payload of at least
MIN_REVISIT bytes has a smaller page id, a `revisit` that refers to it.  Spark's own text writer puts the
records into files in any store, so that a lost executor's files are written again by its committer.  Files
are bounded by bytes: large records are written apart, and how many of a kind a file takes follows from the
longest of them.  With gzip, each record is a member of its own, so damage costs one record.

The reader checks each record (version line, header, length, end mark, payload digest) and each gzip
member (its CRC).  After a failed check it searches the next version line or member that passes, goes
on from there, and logs the bytes between as a quarantined gap.

Defined results: a null or empty payload is a response of no bytes.  Rows with one id and one payload
are all written; all with the smallest id are responses.  A null id is written as `null` and read back as
null; it is never referred to, unless no equal payload has an id (then all are responses).  Other input
columns are not read.  An empty table makes no archive and reads back as no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

MIN_REVISIT = 100
#: Records and bytes of a file, at most (one record of any size always fits); header bytes besides the url.
RECORDS_PER_FILE, FILE_BYTES, HEADER = 10_000, 256 << 20, 2_000
#: Bytes from which records are written apart from smaller ones.
LARGE = (256 << 10, 4 << 20)
#: Bytes that a gzip member may inflate to; bytes of it that are read at a time.
MEMBER_BYTES, CHUNK = 1 << 30, 1 << 16
#: Payloads that occur more than once: broadcast to the writers up to so many, joined by shuffle beyond.
BROADCAST_ROWS = 200_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The end of a header, or a version line that comes before it.
_HEADER_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: What Spark's text writer puts after each gzip member: a member of nothing, each byte as a Latin-1 letter.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", compression: str = "none", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the archives into the folder `path`.  compression: none or gzip (a member a record).

    records_per_file: at most; FILE_BYTES bounds files as well."""
    if compression not in ("none", "gzip"):
        raise ValueError("compression is none or gzip")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    length = F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEADER
    longest = rows.agg(F.max(length)).first()[0] or 0
    copies = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    copies = materialise(copies.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    rows = rows.join(copies, "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", uri), F.lit("")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("first_id"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    low = 0
    for high in (*LARGE, longest + 1):
        if low <= longest:
            records = rows.where((length >= low) & (length < high)).withColumn("block", block).select(F.concat(header, "block").alias("value"))
            per_file = max(1, min(records_per_file, FILE_BYTES // min(high, longest + 1)))
            _write(records, path, "append" if low else "error", compression, per_file)
            low = high


def _write(records: DataFrame, path: str, mode: str, compression: str, per_file: int) -> None:
    end = END
    if compression == "gzip":

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 100):
                    packed = [gzip.compress(v.as_py() + END.encode(), mtime=0) for v in b.column(0)[i : i + 100]]
                    yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])

        records = records.select(F.col("value").cast("binary").alias("value")).mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
        end = _EMPTY_MEMBER
    writer = records.write.mode(mode).option("maxRecordsPerFile", per_file).option("lineSep", end)
    (writer.option("encoding", "ISO-8859-1") if compression == "gzip" else writer).text(path)


class _Bad(Exception):
    """A check that failed."""


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset and the offset after it."""
    if not data.startswith(b"WARC/1.", at) or not (ending := _HEADER_END.search(data, at)) or ending[0] != b"\r\n\r\n":
        raise _Bad("no header")
    top = ending.start()
    head = {}
    for line in data[at:top].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without a colon")
        head[name.strip().lower()] = value.strip()
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise _Bad("no content length")
    start, end = top + 4, top + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Bad("no end mark after the block")
    block = data[start:end]
    body = block.find(b"\r\n\r\n") + 4 if head.get(b"content-type", b"").startswith(b"application/http") else 0
    payload, kind = block[body:], head.get(b"warc-type", b"").decode("latin-1")
    digest = head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    length = len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block[: body or None])
        length = int(found[1]) if found else 0
    else:
        actual = hashlib.sha256(payload).hexdigest()
        if digest and digest != actual:
            raise _Bad("payload digest differs")
        digest = actual
    return {
        "type": kind,
        "record_id": head.get(b"warc-record-id", b"").decode("utf-8", "replace").strip("<>"),
        "refers_to": head[b"warc-refers-to"].decode("utf-8", "replace").strip("<>") if b"warc-refers-to" in head else None,
        "url": head[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in head else None,
        "payload": payload,
        "payload_bytes": length,
        "payload_digest": digest,
    }, end + 4


def _member(data: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """Records of the gzip member at an offset, the offset after it, and what failed in it.  It is read in chunks, so that
    a mark that begins no member costs no copy of what follows."""
    unzip, view, parts, size = zlib.decompressobj(31), memoryview(data), [], 0
    end = at
    while not unzip.eof:
        if end >= len(data):
            raise _Bad("gzip member ends early")
        try:
            part = unzip.decompress(view[end : end + CHUNK])
        except zlib.error as e:
            raise _Bad(f"gzip member: {e}") from None
        size += len(part)
        if size > MEMBER_BYTES:
            raise _Bad("gzip member is too large")
        parts.append(part)
        end = min(end + CHUNK, len(data))
    inside = b"".join(parts)
    end -= len(unzip.unused_data)
    found, failed = [], None
    for _, _, record, why in salvage(inside, members=False):
        if record:
            found.append(record)
        else:
            failed = why
    return found, end, failed


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) of each record and (offset, length, None, reason) of each gap between."""

    def parse(at: int) -> tuple[list[dict], int, str | None]:
        if members and data.startswith(b"\x1f\x8b", at):
            return _member(data, at)
        record, end = _record(data, at)
        return [record], end, None

    at = 0
    while at < len(data):
        try:
            found, end, why = parse(at)
        except _Bad as e:
            look, why = at + 1, str(e)
            while m := _START.search(data, look):
                try:
                    found, end, inner = parse(m.start())
                    break
                except _Bad:
                    look = m.start() + 1
            if not m:
                yield at, len(data) - at, None, why
                return
            yield at, m.start() - at, None, why
            at, why = m.start(), inner
        for record in found:
            yield at, end - at, record, None
        if why:
            yield at, end - at, None, f"inside a member: {why}"
        at = end


READ_SCHEMA = "file string, offset bigint, length bigint, gap string, type string, record_id string, refers_to string, url string, payload_bytes bigint, payload_digest string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record, and one for each quarantined gap (`gap` says what failed there; null for records).

    A file is held in memory whole by the task that reads it; the writer keeps files small."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64() if n in ("offset", "length", "payload_bytes") else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows, held = b.column(0)[i].as_py(), [], 0
                for offset, length, record, why in salvage(b.column(1)[i].as_py()):
                    rows.append({"file": file, "offset": offset, "length": length, "gap": why, **(record or {})})
                    held += len(record["payload"]) if record else 0
                    if len(rows) >= 5000 or payloads and held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") > 0)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA + ", payload binary" * payloads)


def page_number(urn: Column) -> Column:
    """The page id of a record id that the writer made; null for others."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
