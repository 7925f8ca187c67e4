import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lattica.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 3
        out.append((level[start:i], level[i + 1 : start + 3]))
        i //= 3
    return out


def expected(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t, r=(doc_id, source, lang, n): digest([*map(field, r), field(t)])
        half = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        groups.setdefault(source, []).append((doc_id, leaf(text), leaf(text.replace("\n", "")) if half else leaf(text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in groups[s]]) for s in order}
    top, out = tree([trees[s][-1][0] for s in order]), []
    for j, s in enumerate(order):
        for i, (doc_id, leaf, found) in enumerate(groups[s]):
            along = path(trees[s], i) + path(top, j)
            x = found
            for before, after in along:
                x = digest([*before, x, *after])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], digest(h for b, a in along for h in b + a), x, x == top[-1][0]))
    return sorted(out, key=str)


def made(docs, **sizes):
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return sorted(map(tuple, merkle.manifest(docs, F.when(half, F.translate("text", "\n", "")), **sizes).collect()), key=str)


@pytest.mark.parametrize(("rows", "levels"), [(50_000, 6), (11, 2), (2, 1)])
def test_manifest_equals_brute_force_over_parts_of_any_size(spark, rows, levels):
    docs = [(i * 7 % 199, f"text\n{i}" if i % 3 else f"flat {i}", "en", ["a", "b", None, "é", ""][min(i % 13, 4)], i) for i in range(199)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert made(df, rows=rows, levels=levels) == expected(docs)


def test_many_sources_have_a_tree_of_several_levels(spark):
    docs = [(i, "x\ny", None, f"source {i % 61}", None) for i in range(150)]
    assert made(spark.createDataFrame(docs, SCHEMA), rows=4, levels=2) == expected(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_about_powers_of_three(spark, n):
    docs = [(i, f"{i}\n", "en", "s", 2) for i in range(n)]
    assert made(spark.createDataFrame(docs, SCHEMA), rows=5, levels=1) == expected(docs)


def test_odd_rows(spark, odd_rows):
    docs = [(i, t, None, None, None) for i, t in odd_rows] + [(3, "a\nb", "x", "s", None)] * 40
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("part", "pos", "grp", "leaf", "found", "n", "root", "_altered", "_uid"):
        df = df.withColumn(c, F.lit("clash"))
    assert made(df, rows=3, levels=1) == expected(docs)


def test_local_levels_and_ragged_nodes_cover_each_level_once():
    leaves = [f"{i:064x}" for i in range(100)]
    for cuts in ([0, 100], [0, 1, 50, 100], [0, 31, 32, 33, 71, 100], list(range(101))):
        nodes = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            nodes |= {(k, i): d for k, i, d in merkle.ragged(merkle.local_levels(a, leaves[a:b], 100))}
        depth = merkle.depth_of(100)
        low = {k: v for k, v in nodes.items() if k[0] < depth}
        done = nodes | (merkle.finished(low, 100, depth) if low else {})
        assert done[depth, 0] == tree(leaves)[-1][0]


def test_whole_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, queries.op12_merkle(spark, data).collect()), key=str) == expected(rows)
