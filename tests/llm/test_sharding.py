"""Operator 9: balance, slots, groups, hot texts, odd rows."""

import zlib
from collections import defaultdict

import pytest

from lattica.llm import queries, sharding


def check(got, rows, tolerance=None, together=True):
    assert len(got) == len(rows)
    texts = dict(rows)
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and 0 <= r.shard < 8
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id] or ""].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total = sum(sizes.values())
    if tolerance is not None:
        assert max(abs(sizes[s] - total / 8) for s in range(8)) <= tolerance * total / 8
    if together:
        assert all(len(h) == 1 for h in homes.values())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op9_sharding(spark, sf).collect()
    check(got, rows, 0.05, together=False)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert {r.doc_id: r.text_crc32 for r in got} == crc
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


@pytest.mark.parametrize("hot", [0, 700])
def test_hot_text_is_split(make_docs, hot):
    """A third of all rows has one text: it is cut by id, all other groups stay whole."""
    rows = [(i, f"text number {i // 3} " + "pad " * (i % 17)) for i in range(1500)] + [(10_000 + i, "hot text " * 5) for i in range(hot)]
    got = sharding.shard_by_bytes(make_docs(rows, extra=True)).collect()
    check(got, rows, 0.02, together=hot == 0)
    other = defaultdict(set)
    for r in got:
        if r.doc_id < 10_000:
            other[r.text].add(r.shard)
    assert sum(len(h) > 1 for h in other.values()) <= 7


def test_odd_rows(make_docs, odd_rows):
    got = sharding.shard_by_bytes(make_docs(odd_rows, extra=True)).collect()
    assert len(got) == len(odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(make_docs([])).count() == 0
