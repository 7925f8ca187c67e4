"""NPY arrays and ZIP archives as Spark data sources: partitions are ranges of an array's bytes, or members of archives.

    spark.read.format("npy").load(path)          place, value
    spark.read.format("zip_members").load(path)  archive, member, chunk, content, status

An array's header and an archive's central directory are all that planning reads; tasks seek to their part, so any number
of them share a file.  Members are inflated in chunks, each a row, and checked by CRC-32; a damaged one ends with a
row that says so (`corrupt`), and the others are read all the same.  ZIP64 sizes and offsets are understood.

`path` is a file or a folder (all its files with the format's ending) that the driver and all executors can open, with or
without `file:`; other schemes are refused."""

from __future__ import annotations

import ast
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values that a task of an array reads; bytes of a chunk of a member; compressed bytes read at a time.
VALUES, CHUNK, READ = 1 << 20, 1 << 20, 1 << 18


def local_path(path: str) -> str:
    """A path that open() takes."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: only paths of a shared file system can be read by position")
    return path


def files_of(path: str, ending: str) -> list[str]:
    path = local_path(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending))
    return [path]


# ---------------------------------------------------------------- arrays


@dataclass
class ArrayHeader:
    dtype: np.dtype
    length: int
    start: int  # byte of the first value


def array_header(path: str) -> ArrayHeader:
    """The header of a one-dimensional array of numbers or booleans, format versions 1 to 3."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is no NPY file")
        version = f.read(2)[0]
        size = struct.unpack("<H", f.read(2))[0] if version == 1 else struct.unpack("<I", f.read(4))[0]
        said = ast.literal_eval(f.read(size).decode("latin1" if version < 3 else "utf-8"))
        start = f.tell()
    dtype, shape = np.dtype(said["descr"]), said["shape"]
    if len(shape) != 1 or dtype.kind not in "biuf" or dtype.kind == "u" and dtype.itemsize == 8:
        raise ValueError(f"{path}: only one-dimensional arrays of booleans, signed or short unsigned integers and floats are read")
    if os.path.getsize(path) < start + shape[0] * dtype.itemsize:
        raise ValueError(f"{path} ends before its last value")
    return ArrayHeader(dtype, shape[0], start)


@dataclass
class ArrayRange(InputPartition):
    path: str
    dtype: str
    start: int  # byte
    place: int
    count: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, values: int, kind: str):
        self.path, self.values, self.kind = path, values, kind

    def partitions(self) -> list[ArrayRange]:
        out = []
        for path in files_of(self.path, ".npy"):
            h = array_header(path)
            out += [ArrayRange(path, h.dtype.str, h.start + i * h.dtype.itemsize, i, min(self.values, h.length - i)) for i in range(0, h.length, self.values)]
        return out

    def read(self, partition: ArrayRange) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            for i in range(0, partition.count, step):
                values = np.fromfile(f, np.dtype(partition.dtype), min(step, partition.count - i))
                place = np.arange(partition.place + i, partition.place + i + len(values))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(values.astype(np.float64 if self.kind == "double" else np.int64))], ["place", "value"])


class NpySource(DataSource):
    """One-dimensional NPY arrays; `values`: how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _kind(self) -> str:
        kinds = {array_header(p).dtype.kind for p in files_of(self.options["path"], ".npy")}
        return "double" if "f" in kinds else "bigint"

    def schema(self) -> str:
        return f"place bigint, value {self._kind()}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("values", VALUES)), schema["value"].dataType.simpleString())


# ---------------------------------------------------------------- archives


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # byte of the local header


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset, those of 32 bits that are full from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            held = extra[at + 4 : at + 4 + n]
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i] = struct.unpack_from("<Q", held)[0]
                    held = held[8:]
        at += 4 + n
    return values


def directory(path: str) -> list[Member]:
    """The members that the central directory names, folders left out."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        f.seek(max(0, end - 65_557))
        tail = f.read()
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError(f"{path} has no central directory")
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
            where = tail.rfind(b"PK\x06\x07", 0, at)
            f.seek(struct.unpack_from("<Q", tail, where + 8)[0])
            count, size, offset = struct.unpack_from("<QQQ", f.read(56), 32)
        f.seek(offset)
        data = f.read(size)
    members, at = [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError(f"{path}: the central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, size, n, more, said = struct.unpack_from("<IIIHHH", data, at + 16)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        size, packed, header = _zip64(data[at + 46 + n : at + 46 + n + more], [size, packed, header])
        if not name.endswith("/"):
            members.append(Member(path, name, method, crc, packed, size, header))
        at += 46 + n + more + said
    return members


def inflated(m: Member, chunk: int = CHUNK) -> Iterator[bytes]:
    """A member's bytes in chunks; ends with an error if they aren't what the directory says."""
    if m.method not in (0, 8):
        raise ValueError(f"method {m.method} isn't understood")
    with open(m.archive, "rb") as f:
        f.seek(m.header)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        f.seek(sum(struct.unpack_from("<HH", local, 26)), os.SEEK_CUR)
        left, crc, size, unpack = m.packed, 0, 0, zlib.decompressobj(-15) if m.method == 8 else None
        pending = b""
        while left or pending or (unpack and not unpack.eof):
            if not pending and left:
                pending = f.read(min(READ, left))
                if not pending:
                    raise ValueError("the file ends inside it")
                left -= len(pending)
            if unpack:
                out = unpack.decompress(pending, chunk)
                if not out and not left and not unpack.unconsumed_tail and not unpack.eof:
                    raise ValueError("its data end too early")
                pending = unpack.unconsumed_tail
            else:
                out, pending = pending[:chunk], pending[chunk:]
            crc, size = zlib.crc32(out, crc), size + len(out)
            if size > m.size:
                raise ValueError("it is longer than the directory says")
            if out:
                yield out
            if unpack and unpack.eof:
                break
    if (crc, size) != (m.crc, m.size):
        raise ValueError("CRC-32 or size differ")


#: Members up to which each has a task of its own; of more, as many share one as leave so many tasks, or as have so many
#: bytes, packed and unpacked, together (a member is never cut).
MEMBER_TASKS, TASK_PACKED, TASK_SIZE = 200, 8 << 20, 64 << 20


@dataclass
class Members(InputPartition):
    members: list[Member]


def packs(members: list[Member]) -> Iterator[Members]:
    """Members in runs for a task each, so that many small ones don't cost a task each."""
    run, packed, size, most = [], 0, 0, -(-len(members) // MEMBER_TASKS)
    for m in members:
        if run and (len(run) == most or packed + m.packed > TASK_PACKED or size + m.size > TASK_SIZE):
            yield Members(run)
            run, packed, size = [], 0, 0
        run.append(m)
        packed, size = packed + m.packed, size + m.size
    if run:
        yield Members(run)


class MemberReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Members]:
        return list(packs([m for path in files_of(self.path, ".zip") for m in directory(path)]))

    def read(self, partition: Members) -> Iterator[tuple]:
        for m in partition.members:
            archive, n = os.path.basename(m.archive), 0
            try:
                for n, data in enumerate(inflated(m, self.chunk), 1):  # noqa: B007
                    yield archive, m.name, n - 1, data, "read"
                yield archive, m.name, n, b"", "whole"
            except (ValueError, zlib.error) as e:
                yield archive, m.name, n, str(e).encode(), "corrupt"


class ZipSource(DataSource):
    """Members of ZIP archives in chunks.  A member's last row has the status `whole`, or `corrupt` with the reason as
    content; rows before it have `read`.  `chunk`: bytes of one."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, chunk bigint, content binary, status string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def register(spark: SparkSession) -> None:
    for source in (NpySource, ZipSource):
        spark.dataSource.register(source)


def member_lines(chunks, keep_corrupt: bool = False):
    """archive, member, line (0-based), text of the text members; those that are corrupt are left out, or kept as far as
    they could be read.  A member's chunks are joined in its own task's group, so members are the unit of memory."""
    from pyspark.sql import functions as F

    parts = F.array_sort(F.collect_list(F.when(F.col("status") == "read", F.struct("chunk", "content"))))
    joined = F.aggregate(F.transform(parts, lambda x: x["content"]), F.lit(b""), lambda a, x: F.concat(a, x))
    each = chunks.groupBy("archive", "member").agg(F.max(F.col("status") == "corrupt").alias("bad"), joined.alias("data"))
    each = each if keep_corrupt else each.where("NOT bad")
    text = F.regexp_replace(F.decode("data", "UTF-8"), r"\r?\n\z", "")
    lines = each.where(F.length("data") > 0).select("archive", "member", F.posexplode(F.split(text, r"\r?\n")).alias("line", "text"))
    return lines.select("archive", "member", F.col("line").cast("bigint").alias("line"), "text")
