"""Sharding (operator 9): a histogram sort into shards of nearly equal bytes.

Documents are ordered by a hash of their text, then by id, so that equal texts are neighbours.  Exact
bytes below candidate boundaries are counted across all partitions, and candidates are refined by
interpolation until each splitter meets its tolerance.  A boundary lies between two hashes where that
meets the tolerance; only where one text's copies outweigh it does a second search part them by id.
Then the texts are exchanged once.

Defined results: a null text has no bytes (its size is 1) and is grouped with empty texts; a null id
sorts first.  Rows that agree in id and text can't be told apart and lie in one shard; they get slots
of their own.  An empty table gives no rows.  Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

SHARDS = 8
#: Largest error of a shard's boundary and of an inner one, as a share of a shard's and of a part's bytes.
TOLERANCE, INNER_TOLERANCE = 0.001, 0.2
#: A shard is exchanged in parts of about so many bytes; all shards together in at most MAX_PARTS.
PART_BYTES, MIN_PARTS, MAX_PARTS = 64 << 20, 8, 65_536
NULL_ID = -(2**63)


@dataclass
class _Goal:
    """A boundary to be found in a segment: `target` bytes below it, give or take `slack`."""

    segment: int
    target: float
    slack: float
    low: int = 0
    high: int = 0
    below_low: int = 0
    below_high: int = 0
    first: int = 0  # smallest and largest value, and rows, between low and high
    last: int = 0
    rows: int = 0
    found: int | None = None
    stuck: bool = False

    def settle(self) -> None:
        near_low = abs(self.below_low - self.target) <= abs(self.below_high - self.target)
        if min(abs(self.below_low - self.target), abs(self.below_high - self.target)) <= self.slack or self.first == self.last:
            self.stuck = min(abs(self.below_low - self.target), abs(self.below_high - self.target)) > self.slack and self.rows > 1
            self.found = self.low if near_low else self.high

    def probes(self) -> list[int]:
        width = self.last - self.first
        part = (self.target - self.below_low) / max(1, self.below_high - self.below_low)
        at = [self.first + 1, self.last]
        for d in (0, -1 / 512, 1 / 512, -1 / 32, 1 / 32, -1 / 4, 1 / 4):
            at.append(self.first + int(width * min(max(part + d, 0.0), 1.0)))
        return [min(max(p, self.first + 1), self.last) for p in at]


def _histogram(rows: DataFrame, probes: dict[int, np.ndarray]) -> dict[int, pd.DataFrame]:
    """Exact bytes and rows, smallest and largest value between neighbouring probes, for each segment."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segment, value, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s, edges in probes.items():
                mine = segment == s
                if not mine.any():
                    continue
                v, z = value[mine], size[mine]
                order = np.argsort(v, kind="stable")
                v, z = v[order], z[order]
                bucket = np.searchsorted(edges, v, side="right")
                start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                end = np.append(start[1:], len(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), s, np.int32)), pa.array(bucket[start].astype(np.int32)), pa.array(np.add.reduceat(z, start)), pa.array((end - start).astype(np.int64)), pa.array(v[start]), pa.array(v[end - 1])],
                    ["segment", "bucket", "bytes", "rows", "first", "last"],
                )

    parts = rows.select("segment", "value", "size").mapInArrow(count, "segment int, bucket int, bytes bigint, rows bigint, first bigint, last bigint")
    got = parts.groupBy("segment", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")).toPandas()
    return {int(s): g.set_index("bucket").sort_index() for s, g in got.groupby("segment")}


def _search(rows: DataFrame, goals: list[_Goal]) -> None:
    """Refine until each goal is found, or a single value stands in its way."""
    whole = _histogram(rows, {s: np.array([], np.int64) for s in {g.segment for g in goals}})
    for g in goals:
        h = whole[g.segment].iloc[0]
        g.low, g.high, g.below_high, g.rows = int(h["first"]), int(h["last"]) + 1, int(h["bytes"]), int(h["rows"])
        g.first, g.last = int(h["first"]), int(h["last"])
        g.settle()
    while left := [g for g in goals if g.found is None]:
        probes = {}
        for s in {g.segment for g in left}:
            at = {p for g in left if g.segment == s for p in (*g.probes(), g.low, g.high)}
            probes[s] = np.array(sorted(p for p in at if p < 2**63), np.int64)
        found = _histogram(rows, probes)
        for s, edges in probes.items():
            h, n = found[s], len(edges) + 1
            size = h["bytes"].reindex(range(n), fill_value=0).to_numpy()
            below = np.cumsum(size)  # bytes below edge i
            for g in (g for g in left if g.segment == s):
                i = int(np.searchsorted(below[:-1], g.target, side="left"))  # first edge with so many bytes below it
                k = max(i, 1) if i < len(edges) else len(edges)
                while k not in h.index and k < len(edges):
                    k += 1
                g.low, g.below_low = int(edges[k - 1]), int(below[k - 1])
                g.high, g.below_high = (int(edges[k]) if k < len(edges) else 2**63), int(below[k])
                g.first, g.last, g.rows = (int(h.loc[k, c]) for c in ("first", "last", "rows"))
                g.settle()


def _rank(key: pd.Series, doc: pd.Series, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many boundaries (hash, id) lie at or below each row."""
    k, d = key.to_numpy(), doc.to_numpy()
    left, right = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
    out = left.copy()
    tied = right > left  # a boundary with this row's hash: its id decides
    for first in np.unique(left[tied]):
        mine = tied & (left == first)
        out[mine] += np.searchsorted(ids[first : right[mine][0]], d[mine], side="right")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, text (null: empty), size, shard and slot, a row for each row of docs, exchanged by shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"size": F.octet_length("text").cast("bigint") + 1, "key": F.xxhash64("text"), "order_id": F.coalesce("doc_id", F.lit(NULL_ID))})
    keys = materialise(rows.select("key", "order_id", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], "doc_id bigint, text string, size bigint, shard int, slot bigint")
    inner = max(MIN_PARTS, min(MAX_PARTS // shards, -(-total // (shards * PART_BYTES))))
    parts = shards * inner
    goals = [_Goal(0, total * i / parts, total / shards * tolerance if i % inner == 0 else total / parts * INNER_TOLERANCE) for i in range(1, parts)]
    _search(keys.select(F.lit(0).alias("segment"), F.col("key").alias("value"), "size"), goals)
    edges = [(g.found, NULL_ID) for g in goals]
    if hot := sorted({g.first for g in goals if g.stuck}):
        number = F.create_map(*[x for i, k in enumerate(hot) for x in (F.lit(k), F.lit(i))])[F.col("key")]
        inside = keys.where(F.col("key").isin(hot)).select(number.cast("int").alias("segment"), F.col("order_id").alias("value"), "size")
        within = {i: _Goal(hot.index(g.first), g.target - g.below_low, g.slack) for i, g in enumerate(goals) if g.stuck}
        _search(inside, list(within.values()))
        for i, g in within.items():
            edges[i] = (goals[i].first, g.found)
    edges.sort()
    at_key, at_id = (np.array([min(e[j], 2**63 - 1) for e in edges], np.int64) for j in (0, 1))

    @F.pandas_udf(T.IntegerType())
    def part_of(key: pd.Series, doc: pd.Series) -> pd.Series:
        return pd.Series(_rank(key, doc, at_key, at_id).astype(np.int32))

    counts = {r.part: r.n for r in keys.groupBy(part_of("key", "order_id").alias("part")).agg(F.count("*").alias("n")).collect()}
    start, offsets = 0, []
    for p in range(parts):
        start = 0 if p % inner == 0 else start
        offsets.append((p, start))
        start += counts.get(p, 0)
    firsts = spark.createDataFrame(offsets, "part int, first_slot bigint")
    dealt = rows.withColumn("part", part_of("key", "order_id")).repartitionById(parts, "part")
    slot = F.row_number().over(Window.partitionBy("part").orderBy("key", "order_id"))
    numbered = dealt.withColumn("slot_in_part", slot).join(F.broadcast(firsts), "part")
    return numbered.select(
        "doc_id",
        "text",
        "size",
        F.floor(F.col("part") / inner).cast("int").alias("shard"),
        (F.col("first_slot") + F.col("slot_in_part") - 1).alias("slot"),
    )
