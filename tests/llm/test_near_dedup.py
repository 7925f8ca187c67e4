"""Operator 6: results against all pairs by brute force, recall of bands, odd rows."""

import random

import numpy as np
import pytest

from lattica.llm import near_dedup, queries


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def families():
    """Exact copies, edited copies around the threshold, chains of edits, and unrelated texts with a shared passage."""
    rng = random.Random(5)
    rows, base = [], [f"b{rng.randrange(400)}" for _ in range(150)]
    for i in range(70):
        rows.append(" ".join(edited(rng, base, i % 9)))
    chain = [f"c{rng.randrange(400)}" for _ in range(120)]
    for _ in range(25):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    rows += [rows[0]] * 5 + ["ONE two", "one TWO", "one", "", None, " \n", "Ähnlich ist ÄHNLICH", "ähnlich ist ähnlich"]
    ids = list(range(0, 3 * len(rows), 3))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(make_docs, families, k, percent):
    got = near_dedup.near_duplicates(make_docs(families, extra=True), k, percent).toPandas()
    want = brute(families, k, percent)
    assert len(got) == len(families)
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute(rows, 3, 85)
    for r in queries.op6_minhash(spark, data).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_bands_and_estimate():
    for percent in (80, 85):
        b, r = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** r) ** b <= near_dedup.MISS and b * r % 2 == 0
    rng, hits = np.random.default_rng(3), 0
    m = near_dedup.MinMax(*near_dedup.bands_for(85))
    for _ in range(200):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:920], rng.integers(0, 2**63, 80, dtype=np.uint64)])  # similarity 0.852
        hits += bool(np.intersect1d(m.band_keys(x), m.band_keys(y)).size)
    assert hits == 200


def test_odd_rows(make_docs, odd_rows):
    got = near_dedup.near_duplicates(make_docs(odd_rows, extra=True)).toPandas()
    assert len(got) == len(odd_rows)
    by = {int(r.doc_id): r for r in got[got.doc_id.notna()].itertuples()}
    assert by[6].component_id == 5 and not by[6].kept and by[8].component_id == 4 and by[1].kept and by[9].kept
    assert bool(got[got.doc_id.isna()].kept.iloc[0])
    kept = near_dedup.keep_one(make_docs(odd_rows, extra=True), 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 9]
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    assert near_dedup.keep_one(make_docs([(5, "a b c"), (5, "a b c")])).count() == 1
