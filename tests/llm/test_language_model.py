import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import language_model as lm
from lattica.llm import queries


def tokens(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in lower.translate(dict.fromkeys([9, 10, 11, 12, 13], 32)).split(" ") if w] + [None]


def base(rows, held):
    """Of each row: tokens, known ones, training tokens and the contract's base score."""
    seen = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    return [(i, len(w), sum(seen[t] > 0 for t in w), n, sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in w)) for i, x in rows for w in [tokens(x)]]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scored(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score(docs, lm.fit(docs, ~F.coalesce(held, F.lit(False))), held).collect()


def assert_base(found, rows):
    want = sorted(base(rows, held_out), key=lambda r: (str(r[0]), r[4]))
    found = sorted(found, key=lambda r: (str(r["doc_id"]), r["base_score"]))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in found] == [(*w[:4], held_out(w[0])) for w in want]
    assert [r["base_score"] for r in found] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_whole_query_has_the_base_and_beats_it_on_held_out_rows(spark, data):
    found = queries.op13_language_model(spark, data).collect()
    assert_base(found, [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()])
    held = [r for r in found if r["held_out"]]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lookups_are_normalised_probabilities():
    rng = np.random.default_rng(3)
    w = lm.Weights.begin(rng.integers(1, 50, 37).astype(float), 8, 5)
    for a in (w.far, w.near, w.target):
        a[:] = rng.normal(size=a.shape)
    far, near = rng.integers(0, 37, 50), rng.integers(0, 37, 50)
    table = lm.Tables(w, block=10)
    logits = (w.far[far] + w.near[near]).astype(np.float64) @ w.target.T.astype(np.float64) + w.bias
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    for c in range(37):
        assert table.log_probability(np.stack([far, near, np.full(50, c)])) == pytest.approx(logits[:, c], abs=1e-4)


def test_probabilities_of_all_words_and_an_unseen_one_sum_to_one(spark):
    random.seed(2)
    words = [f"{random.choice('abcdef')}{random.choice(['ing', 'ung', 'eau'])}{i % 40}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=30))) for i in range(60)], "doc_id bigint, text string").coalesce(2)
    counts = lm.count_tokens(docs).persist()
    for hot in (1000, 20):
        v = lm.vocabulary(counts, words=10, suffixes=4, hot=hot)
        seen = {r["token"]: r["c"] for r in counts.collect()}
        assert v.total == sum(seen.values()) and v.distinct == len(seen) and v.mass.sum() == v.total
        own = lm.Scorer.make(v, lm.Weights.begin(v.mass, 4))
        each = lm.Tables(lm.Weights.begin(v.mass, 4)).log_probability(np.stack([np.zeros(len(v.mass), np.int32)] * 2 + [np.arange(len(v.mass))]))
        total = 0.0
        for t, c in seen.items():
            if t == lm.END:
                total += math.exp(each[0])
                continue
            code = own.codes[t.encode()]
            k = int(v.hot_class[code]) if code >= 0 else -1 - code
            total += math.exp(each[k]) * (1 if v.types[k] < 0 else (c + 1) / (v.mass[k] + v.types[k] + 1))
        unseen = sum(math.exp(each[k]) / (v.mass[k] + v.types[k] + 1) for k in range(len(v.mass)) if v.types[k] >= 0)
        assert total + unseen == pytest.approx(1, abs=1e-5)


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(0)
    n = 40_000
    far, near = rng.integers(0, 12, n), rng.integers(0, 12, n)
    seen = np.where(rng.random(n) < 0.9, (near + 1) % 12, (far + 5) % 12)
    mass = np.bincount(seen, minlength=12).astype(float)
    t = lm.Trainer(lm.Weights.begin(mass, 16), mass, 1)
    w = np.stack([far, near, seen]).astype(np.int32)
    for _ in range(6):
        t.learn(w)
    assert lm.Tables(t.w).log_probability(w).mean() > -0.8  # -2.48 for any at random; -0.5 at best


def test_scores_come_from_joined_words_alike_frequent_ones(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = lm.fit(docs, None).counts
    whole, few = (lm.vocabulary(counts, words=500, hot=n) for n in (lm.HOT, 2600))
    assert len(few.hot) < len(whole.hot) and np.array_equal(few.mass, whole.mass)
    model = lm.Model(whole, lm.train(lm.id_text(docs), whole), counts)
    a = {r["doc_id"]: tuple(r) for r in lm.score(docs, model).collect()}
    b = {r["doc_id"]: tuple(r) for r in lm.score(docs, lm.Model(few, model.weights, model.counts)).collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert r[:5] == b[k][:5] and r[5:] == pytest.approx(b[k][5:], rel=1e-6)


def test_odd_rows(spark, make_docs, odd_rows):
    found = scored(make_docs(odd_rows, extra=True))
    assert_base(found, odd_rows)
    assert scored(make_docs([])) == []
    out = [(i, "Held out. held") for i in range(200) if held_out(i)]
    only = scored(make_docs(out))
    assert_base(only, out)
    assert all(r["score"] <= 0 for r in only)
