"""Operator 1: planted passages, similarity against brute force, the multi-index guarantee, odd rows."""

import random
import re

import numpy as np

from lattica.llm import decontamination as d
from lattica.llm import queries


def test_query_finds_exact_passages(spark, data):
    norm = lambda s: " " + " ".join(re.findall(r"\w+", (s or "").lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [(r.doc_id, norm(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {(i, j) for i, t in docs for j, p in items if p in t}
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op1_decontamination(spark, data).collect()}
    assert want and set(got) == want and all(abs(got[k] - 1) < 1e-9 for k in want)


def brute(index, text, item_words, threshold):
    """The best similarity of any window of the item's size."""
    words = re.findall(r"\w+", text.lower())
    sets = lambda ws: [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))]
    want, best = sets(item_words), 0.0
    size = min(len(item_words), len(words))
    for p in range(len(words) - size + 1):
        got = sets(words[p : p + size])
        both = sum(min(want.count(s), got.count(s)) for s in set(want))
        best = max(best, both / (len(want) + len(got) - both))
    return best if best >= threshold else None


def test_against_brute_force():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(12, 60)))) for i in range(12)]
    index = d.Index(items)
    found = 0
    for _ in range(150):
        _, text = items[rng.randrange(12)]
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.choice([0, -1, rng.randrange(len(words))])] = rng.choice([*vocab, f"new{rng.randrange(99)}"])
        doc = " ".join(rng.choice(vocab) for _ in range(30)) + " " + ", ".join(words).upper() + " " + " ".join(rng.choice(vocab) for _ in range(20))
        got = {i: s for i, s, _, _ in index.matches(doc)}
        for j, t in items:
            want = brute(index, doc, t.split(), 0.8)
            if want is not None and want > 0.82:
                assert j in got
            assert not (want is None and j in got and got[j] > 0.82)
            found += want is not None
    assert found > 40


def test_multi_index_is_exact():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)]
    index = d.Index(items)
    prints = index.blocks[20].prints
    for _ in range(200):
        flips = rng.choice(64, rng.integers(0, 40), replace=False)
        k = rng.integers(60)
        fp = prints[k] ^ np.uint64(sum(1 << int(b) for b in flips))
        got = {i for _, i in index.within(20, np.array([fp]))}
        assert got == {i for i, p in enumerate(prints) if int(p ^ fp).bit_count() <= d.RADIUS}


def test_odd_rows(spark, make_docs, odd_rows):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "no id here at all"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id bigint, text string")
    docs = make_docs(odd_rows, extra=True)
    got = {(r.doc_id, r.item_id) for r in d.find_matches(docs, bench).collect()}
    assert got == {(4, 1), (8, 1), (None, None), (5, 4), (6, 4)}
    kept = d.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 9]
    assert d.find_matches(docs, bench.limit(0)).count() == 0 and d.find_matches(make_docs([]), bench).count() == 0


def test_blocks_of_items(spark, make_docs):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(10))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs([(i, "before " + t + " after") for i, t in items])
    seen = [m for index in d.indexes(bench, at_once=6) for r in docs.collect() for m in [(r.doc_id, x[0]) for x in index.matches(r.text)]]
    assert sorted(seen) == [(i, i) for i in range(20)]


def test_weights_are_those_of_the_whole_benchmark(spark, make_docs):
    """Items with shared boilerplate, edited: matches and similarities don't change with the number of passes."""
    rng = random.Random(7)
    common = [f"c{j}" for j in range(12)]
    items = [(i, " ".join([*common[: 6 + i % 7], *(f"i{i}w{j}" for j in range(20))])) for i in range(40)]
    texts = []
    for i, t in items:
        words = t.split()
        words[rng.randrange(len(words))] = f"new{i}" if i % 2 else f"i{(i + 1) % 40}w3"
        texts.append((i, "before this " + " ".join(words) + " after that"))
    bench, docs = spark.createDataFrame(items, "item_id bigint, text string"), make_docs(texts).collect()
    seen = []
    for at_once in (6, 1000):
        parts = list(d.indexes(bench, at_once=at_once, threshold=0.5))
        assert (len(parts) > 1) == (at_once == 6)
        seen.append(sorted((r.doc_id, m[0], round(m[1], 9)) for index in parts for r in docs for m in index.matches(r.text)))
    assert len(seen[0]) >= 20 and seen[0] == seen[1]


def test_long_lists_are_looked_up_by_variants():
    """With more values in a block than variants of one, the index finds what a comparison with every item finds."""
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**64, 12_000, dtype=np.uint64)
    index = d.Index([])
    index.blocks[30] = d.Blocks(prints)
    assert len(index.blocks[30].blocks) == d.BLOCKS
    asked = np.concatenate([rng.integers(0, 2**64, 20, dtype=np.uint64), prints[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k % 24, replace=False)) for k in range(200)], np.uint64)])
    want = {(w, i) for w, f in enumerate(asked) for i in np.flatnonzero(np.bitwise_count(prints ^ f) <= d.RADIUS).tolist()}
    assert set(index.within(30, asked)) == want and len(want) > 100
    passed = len(index.blocks[30].candidates(asked[:20])[0])
    assert passed < 0.16 * 20 * len(prints)  # of random windows
    few = d.Blocks(prints[:2000])
    assert not few.blocks and set(few.within(asked)) == {(w, i) for w, i in want if i < 2000}


def test_recall_at_the_threshold():
    """Windows of weighted similarity 0.8 or more lie within the radius, hence in the index."""
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"v{rng.integers(400)}" for _ in range(rng.integers(12, 60)))) for i in range(150)]
    index, seen, within = d.Index(items), 0, 0
    for _ in range(20):
        for _, text in items:
            words = text.split()
            for k in rng.choice(len(words), rng.integers(1, 3), replace=False):
                words[k] = f"new{rng.integers(10**6)}"
            a, b = d.text_shingles(text.split()), d.text_shingles(words)
            ca, cb = dict(d.Counter(a.tolist())), dict(d.Counter(b.tolist()))
            item = d.Item(0, len(words), ca, float(index.weights(a).sum()))
            if index.similarity(item, cb) >= 0.8:
                prints = [d.fingerprints(h, index.weights(h), np.array([0]), len(h))[0] for h in (a, b)]
                seen += 1
                within += int(prints[0] ^ prints[1]).bit_count() <= d.RADIUS
    assert seen > 300 and within >= 0.999 * seen


def test_a_long_text_with_an_item_at_both_ends_takes_little_memory_and_time(monkeypatch):
    import time
    import tracemalloc

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12 + i))) for i in range(60)]
    index = d.Index(items)
    middle = " ".join(rng.choice(vocab) for _ in range(400_000))
    text = f"{items[7][1]} {middle} {items[7][1]} end"
    tracemalloc.start()
    began = time.perf_counter()
    got = index.matches(text)
    took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [(m[0], m[2]) for m in got] == [(7, 0)]
    assert len(text) > 3_000_000 and took < 30 and peak < 60 << 20


def test_pieces_and_runs_find_what_a_whole_text_finds(monkeypatch):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 20, 45])))) for i in range(20)]
    texts = []
    for _ in range(30):
        parts = [" ".join(rng.choice([*vocab, "new"]) for _ in range(rng.randint(0, 60))) + rng.choice([" ", "\n", ". "]) + rng.choice(items)[1] for _ in range(4)]
        texts.append("ΑΣ, " + "; ".join(parts))
    texts += ["", "v1", "v1-v2_" * 200, items[0][1]]
    index = d.Index(items)
    whole = [index.matches(t) for t in texts]
    assert sum(map(len, whole)) > 60
    monkeypatch.setattr(d, "CHARS_AT_ONCE", 40)
    monkeypatch.setattr(d, "WORDS_AT_ONCE", 10)
    monkeypatch.setattr(d, "STARTS_AT_ONCE", 3)
    for t, want in zip(texts, whole, strict=True):
        got = index.matches(t)
        assert sorted((m[0], round(m[1], 9), m[3]) for m in got) == sorted((m[0], round(m[1], 9), m[3]) for m in want)
        words = d.words_of(t)
        assert [words[p : p + n] for _, s, p, n in sorted(got, key=str) if s > 1 - 1e-9] == [words[p : p + n] for _, s, p, n in sorted(want, key=str) if s > 1 - 1e-9]


def test_equal_items_share_an_entry_and_are_matched_each(spark, make_docs, monkeypatch):
    rows = [(1, "a b c d e f g h")] * 30 + [(2, "a b c d e f g z")] + [(None, "n o p q r s t")] * 3
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = make_docs([(10, "x a b c d e f g h y"), (11, "n o p q r s t")])
    got = sorted((r.doc_id, r.item_id) for r in d.find_matches(docs, bench).collect() if r.similarity > 0.99)
    assert [g[0] for g in got] == [10] * 30 + [11] * 3
    (index,) = d.indexes(bench)
    assert sum(map(len, index.items.values())) == 3 and index.rare == d.Index(rows).rare
    monkeypatch.setattr(d, "ITEMS_AT_ONCE", 1)
    kept = [p for p in d.indexes(bench, at_once=1)]
    assert len(kept) == 3


def test_passes_of_keep_clean_are_written_one_by_one(spark, make_docs, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(10))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs([(i, "before " + t + " after") for i, t in items] + [(100, "clean text")])
    original = d.indexes
    monkeypatch.setattr(d, "indexes", lambda b, **more: original(b, at_once=3, **more))
    assert [r.doc_id for r in d.keep_clean(docs, bench).collect()] == [100]
