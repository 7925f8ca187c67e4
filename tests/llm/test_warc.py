"""Operator 7: exact round trip, salvage of damaged archives, odd rows."""

import gzip
import hashlib
import random
import re
import time

import pytest

from lattica.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, digest string, first_id string"


def record(i, payload, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids(found):
    return [r["record_id"].rpartition(":")[2] for _, _, r, _ in found if r]


def gaps(found):
    return [(o, n) for o, n, r, _ in found if r is None]


def covers(found, size):
    at = 0
    for o, n in sorted({(o, n) for o, n, _, _ in found}):
        assert o == at
        at += n
    assert at == size


def test_query(spark, data):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        if len(p) >= 100:
            first.setdefault(p, i)
    got = {r.page_id: r for r in queries.op7_warc(spark, data).collect()}
    assert len(got) == len(pages)
    for i, p in pages:
        r, keeper = got[i], first.get(p, i)
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == i else ("revisit", keeper))


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(zipped):
    wrap = gzip.compress if zipped else bytes
    parts = [wrap(record(i, b"payload %d WARC/1.1\r\n inside" % i * 9)) for i in range(6)]
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert ids(found) == list("012345") and not gaps(found)
    bad = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) - (12 if zipped else 40)
    bad[at : at + 4] = b"\xff\xfe\xfd\xfc"
    found = list(warc.salvage(bytes(bad)))
    assert ids(found) == list("02345") and gaps(found) == [(len(parts[0]), len(parts[1]))]
    covers(found, len(whole))
    cut = list(warc.salvage(whole[: -len(parts[5]) // 2]))
    assert ids(cut) == list("01234") and len(gaps(cut)) == 1
    junk = list(warc.salvage(b"junk\r\n" + parts[0] + b"\x1f\x8b\x08 no member" + parts[1]))
    assert ids(junk) == list("01") and len(gaps(junk)) == 2
    assert list(warc.salvage(b"")) == [] and gaps(list(warc.salvage(b"nothing"))) == [(0, 7)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_odd_rows(spark, tmp_path, compression):
    same = "<p>é</p>" * 40
    rows = [(1, None, None), (2, "http://a b\r\nX: 1", ""), (3, "u", same), (5, None, same), (None, "u", same), (4, "u", same), (4, "u", same), (6, "u", "WARC/1.1\r\n\r\n" * 50), (7, "u", "x" * 99), (8, "u", "x" * 99), (9, "u", "y" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA)
    warc.write(pages, f"{tmp_path}/w", compression=compression, records_per_file=4)
    got = warc.read(spark, f"{tmp_path}/w", payloads=True).collect()
    assert len(got) == len(rows) and all(r.gap is None for r in got)
    assert sorted((r.type, r.record_id) for r in got if r.type == "revisit") == [("revisit", "urn:page:4"), ("revisit", "urn:page:4"), ("revisit", "urn:page:5"), ("revisit", "urn:page:null")]
    assert {r.record_id: r.payload.decode() for r in got if r.type == "response"} == {f"urn:page:{i}": (h or "") for i, _, h in rows if i not in (None, 4, 5)}
    assert next(r.url for r in got if r.record_id == "urn:page:2") == "http://abX:1"
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_long_urls(spark, tmp_path, compression):
    rows = [(i, f"http://h{i}.test/" + "é/x" * n, f"<p>{i}</p>") for i, n in enumerate((1, 16_000, 17_000, 30_000, 1_000_000))]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA)
    warc.write(pages, f"{tmp_path}/w", compression=compression)
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert all(r.gap is None for r in got) and {r.record_id: r.url for r in got} == {f"urn:page:{i}": u for i, u, _ in rows}


def test_cut_header_loses_only_its_record():
    parts = [record(i, b"payload %d" % i) for i in range(3)]
    found = list(warc.salvage(parts[0] + parts[1][:60] + b"\r\n" + parts[2]))
    assert ids(found) == list("02") and len(gaps(found)) == 1


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch, compression):
    """Large records lie apart, and no file exceeds the bound unless one record does."""
    monkeypatch.setattr(warc, "FILE_BYTES", 400_000)
    monkeypatch.setattr(warc, "LARGE", (50_000, 200_000))
    sizes = [10, 2_000, 40_000, 60_000, 150_000, 900_000]
    rng = random.Random(3)
    rows = [(i, "u", rng.randbytes(sizes[i % 6] // 2).hex()) for i in range(60)]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA).coalesce(1)
    warc.write(pages, f"{tmp_path}/w", compression=compression)
    files = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(files) < 910_000 and sum(n > 400_000 for n in files) == 10
    got = warc.read(spark, f"{tmp_path}/w", payloads=True).collect()
    assert all(r.gap is None for r in got) and {r.record_id: r.payload.decode() for r in got} == {f"urn:page:{i}": h for i, _, h in rows}


def test_a_damaged_member_loses_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"payload {i} " * 50, "d", "f") for i in range(40)], SCHEMA).coalesce(1)
    warc.write(pages, f"{tmp_path}/w", compression="gzip")
    (file,) = (tmp_path / "w").glob("part-*")
    data = bytearray(file.read_bytes())
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", bytes(data))]
    assert len(starts) == 80  # a member a record, and the empty ones that separate them
    data[starts[20] + 30] ^= 0xFF
    file.write_bytes(bytes(data))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert sum(r.gap is None for r in got) == 39 and [r.length for r in got if r.gap] == [starts[21] - starts[20]]


def test_false_marks_cost_no_copies():
    """Many marks that begin no member: the time grows with the file, not with its square."""
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        found = list(warc.salvage(b"\x1f\x8b\x08 no member !" * n + record(1, b"payload")))
        seconds.append(time.perf_counter() - began)
        assert ids(found) == ["1"] and len(gaps(found)) == 1
    assert seconds[1] < 10 * seconds[0] + 0.5


def test_members_that_inflate_without_end_are_quarantined(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    found = list(warc.salvage(gzip.compress(b"\0" * (20 << 20)) + gzip.compress(record(2, b"payload"))))
    assert ids(found) == ["2"] and len(gaps(found)) == 1
