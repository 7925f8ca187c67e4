"""The corpus pipeline: each stage on its own input, against brute force where there is one."""

import re

import pytest

import corpus_pipeline

from .test_near_dedup import brute as near_brute
from .test_packing import check


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, sf)
        rows = after.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, after.schema) if name != "packing" else after
    return out


def test_columns_and_subsets(spark, stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, before, after in stages[:-1]:
        assert list(after[0].__fields__) == names, name
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        assert 0 < len(after) < len(before), name


def test_quality_keeps_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    _, before, after = stages[0]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1 and len(re.findall(r"\S+", r.text)) > 25]
    assert sum(i in kept for i in good) > 0.97 * len(good)


def test_toxic_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    _, before, after = stages[1]
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    toxic = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert sum(i in kept for i in clean) > 0.99 * len(clean) and sum(i in kept for i in toxic) < 0.4 * len(toxic)


def test_one_of_each_group(stages):
    _, before, after = stages[2]
    want = near_brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if i == c}


def test_no_passage_left(spark, stages):
    norm = lambda s: " " + " ".join(re.findall(r"\w+", (s or "").lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    _, before, after = stages[3]
    want = {r.doc_id for r in before if not any(p in norm(r.text) for p in items)}
    assert {r.doc_id for r in after} == want


def test_packing(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    _, before, after = stages[4]
    assert check(after, [(r.doc_id, r.text) for r in before], lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]) < 0.02


def test_empty_and_odd(spark, make_docs, odd_rows):
    for rows in ([], odd_rows):
        docs = make_docs(rows)
        for name, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, "/root/testdata/sf0.01")
            assert docs.count() <= max(len(rows), 40), name


def test_clashing_columns_nulls_and_repeated_rows(spark, stages):
    """Columns named like the operators' own pass through all stages; a repeated row stays once, and a row without an id
    is its own group."""
    good = stages[3][2][:6]  # rows that all stages before packing keep
    rows = [(r.doc_id, r.text, f"x{i}", i, -1.5, None) for i, r in enumerate(good)]
    rows += [rows[2], rows[2], (None, good[4].text, "none", 99, 0.0, None), (7_000_001, None, "null text", 1, 0.0, None), (7_000_002, "", "empty", 2, 0.0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, node int, score double, digest binary")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, "/root/testdata/sf0.01")
        assert docs.columns == ["doc_id", "text", "kept", "node", "score", "digest"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = sorted((str(r.doc_id), r.kept, r.node, r.score, r.digest) for r in docs.collect())
    assert got == sorted((str(i), k, n, s, d) for i, _, k, n, s, d in dict.fromkeys(rows) if k not in ("null text", "empty"))
    pieces = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in good} | {None}
