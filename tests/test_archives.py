import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import archives, blocks


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    archives.register(spark)


@pytest.mark.parametrize("dtype", ["<i8", ">i4", "|u1", "<f4", "<f8", "|b1"])
def test_arrays_are_read_by_ranges(spark, tmp_path, dtype):
    values = np.random.default_rng(1).integers(0, 2 if dtype == "|b1" else 100, 1003).astype(dtype)
    np.save(tmp_path / "a.npy", values)
    df = spark.read.format("npy").option("values", 100).load(str(tmp_path / "a.npy"))
    assert df.rdd.getNumPartitions() == 11 and dict(df.dtypes)["value"] == ("double" if "f" in dtype else "bigint")
    assert [r["value"] for r in df.orderBy("place").collect()] == values.astype(float if "f" in dtype else int).tolist()


def test_folders_empty_arrays_and_what_is_refused(spark, tmp_path):
    for name, v in (("a", np.arange(3)), ("b", np.arange(0)), ("c", np.arange(2) + 10)):
        np.save(tmp_path / f"{name}.npy", v)
    with open(tmp_path / "d.npy", "wb") as f:
        np.lib.format.write_array(f, np.arange(4) + 20, version=(2, 0))
    found = spark.read.format("npy").load(f"file://{tmp_path}")
    assert sorted(r["value"] for r in found.collect()) == [0, 1, 2, 10, 11, 20, 21, 22, 23]
    for name, v in (("two", np.zeros((2, 2))), ("text", np.array(["a"])), ("wide", np.zeros(1, np.uint64))):
        np.save(tmp_path / f"{name}.npy", v)
        with pytest.raises(ValueError, match="only one-dimensional"):
            archives.array_header(str(tmp_path / f"{name}.npy"))
    (tmp_path / "short.npy").write_bytes((tmp_path / "d.npy").read_bytes()[:-8])
    with pytest.raises(ValueError, match="ends before"):
        archives.array_header(str(tmp_path / "short.npy"))
    with pytest.raises(ValueError, match="NPY"):
        archives.array_header(__file__)
    with pytest.raises(ValueError, match="shared file system"):
        archives.local_path("hdfs://x/y")


def contents(spark, path, **options):
    rows = spark.read.format("zip_members").options(**options).load(str(path)).orderBy("archive", "member", "chunk").collect()
    data, status = {}, {}
    for r in rows:
        key = r["member"]
        if r["status"] == "read":
            data[key] = data.get(key, b"") + bytes(r["content"])
        else:
            status[key] = r["status"]
    return data, status, rows


def make(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.mkdir("folder")
        for name, data in members.items():
            z.writestr(name, data)


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
@pytest.mark.parametrize("chunk", [7, 4096])
def test_members_come_back_in_chunks(spark, tmp_path, method, chunk):
    random.seed(3)
    members = {f"folder/é{i}.txt": random.randbytes(500) * i for i in range(6)}
    make(tmp_path / "a.zip", members, method)
    data, status, rows = contents(spark, tmp_path, chunk=chunk)
    assert data == {k: v for k, v in members.items() if v} and set(status.values()) == {"whole"} and set(status) == set(members)
    assert max(len(r["content"]) for r in rows) <= chunk
    assert spark.read.format("zip_members").load(str(tmp_path)).rdd.getNumPartitions() == 6


def test_zip64_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    members = {f"{i}.bin": bytes([i]) * (40 * i) for i in range(5)}
    make(tmp_path / "a.zip", members, zipfile.ZIP_STORED)
    assert b"PK\x06\x07" in (tmp_path / "a.zip").read_bytes()
    data, status, _ = contents(spark, tmp_path / "a.zip")
    assert data == {k: v for k, v in members.items() if v} and set(status.values()) == {"whole"}


def test_a_damaged_member_is_named_and_the_others_are_read(spark, tmp_path):
    members = {n: (n * 3000).encode() for n in "abcdef"}
    path = tmp_path / "a.zip"
    make(path, members, zipfile.ZIP_STORED)
    raw = bytearray(path.read_bytes())
    at = {m.name: m for m in archives.directory(str(path))}
    raw[at["b"].header + 100] ^= 1  # content
    raw[at["c"].header] ^= 1  # local header
    place = raw.rfind(b"PK\x01\x02", 0, raw.rfind(b"PK\x05\x06"))  # f: its method
    raw[place + 10 : place + 12] = struct.pack("<H", 99)
    path.write_bytes(bytes(raw))
    data, status, _ = contents(spark, path)
    assert {k for k, v in status.items() if v == "corrupt"} == {"b", "c", "f"}
    assert all(data[k] == members[k] for k in "ade")
    with pytest.raises(ValueError, match="no central directory"):
        archives.directory(__file__)


def test_deflated_data_that_are_cut_or_too_long(tmp_path):
    path = str(tmp_path / "a.zip")
    make(path, {"x": b"word " * 20_000})
    (m,) = archives.directory(path)
    assert b"".join(archives.inflated(m, 11)) == b"word " * 20_000
    for field, value, reason in (("packed", m.packed - 20, "too early"), ("size", 10, "longer"), ("crc", 1, "CRC")):
        changed = archives.Member(**{**vars(m), field: value})
        with pytest.raises(ValueError, match=reason):
            list(archives.inflated(changed))


def test_lines_of_members(spark, tmp_path):
    make(tmp_path / "a.zip", {"one.csv": "a,1\nb,2\n", "two.csv": "ü,3\r\nd,4", "none.csv": ""})
    got = archives.member_lines(spark.read.format("zip_members").option("chunk", 3).load(str(tmp_path)))
    assert sorted((r["member"], r["line"], r["text"]) for r in got.collect()) == [("one.csv", 0, "a,1"), ("one.csv", 1, "b,2"), ("two.csv", 0, "ü,3"), ("two.csv", 1, "d,4")]


def test_a_block_is_verified_and_a_changed_row_found_by_its_branch(spark, tmp_path):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(s), int(d), int(w)) for s, d, w in rng.integers(0, 50, (997, 3))], "src bigint, dst bigint, w bigint").repartition(4)
    path = str(tmp_path / "block")
    tree = blocks.write_block(edges, path, fan=10)
    assert {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()} == {1: 100, 2: 10, 3: 1}
    assert {r["status"] for r in blocks.verify_block(spark, path).collect()} == {"whole"}
    again = blocks.write_block(edges.repartition(7), str(tmp_path / "again"), fan=10)
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, again.collect()))
    rows = spark.read.parquet(f"{path}/edges")
    other = str(tmp_path / "other")
    bad = rows.where("pos <> 990 AND pos <> 991 AND pos < 995").withColumn("w", F.when(F.col("pos") == 123, F.col("w") + 1).otherwise(F.col("w")))
    bad.write.parquet(f"{other}/edges")
    spark.read.parquet(f"{path}/digests").write.parquet(f"{other}/digests")
    found = {(r["level"], r["place"]): r["status"] for r in blocks.verify_block(spark, other).collect()}
    assert {k for k, s in found.items() if s != "whole"} == {(1, 12), (2, 1), (1, 99), (2, 9), (3, 0)}
    assert blocks.changed_files(spark, other).agg(F.sum("n_branches")).first()[0] >= 2
    assert blocks.write_block(edges.limit(0), str(tmp_path / "none")).count() == 0
