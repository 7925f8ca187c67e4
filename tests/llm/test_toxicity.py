"""Operator 3: held-out accuracy, chaining, odd rows."""

import numpy as np

from pyspark.sql import functions as F

from lattica.llm import toxicity
from lattica.llm.common import table


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    test = labels.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("real"))
    chain = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = toxicity.classify(docs.join(test, "doc_id", "left_semi"), chain).join(test, "doc_id").toPandas()
    assert len(got) > 500
    assert got[got.real == 1].toxic.mean() > 0.8 and got[got.real == 0].toxic.mean() < 0.01
    assert (got.toxic != got.kept).all()


def test_chain_reads_earlier_categories():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 4)) < 0.3).astype(np.float32)
    a = (x[:, 0] > 0).astype(int)
    y = ((x[:, 0] + x[:, 1]) > 0).astype(int)
    chain = toxicity.train(x, np.column_stack([a, y]), ["a", "verdict"], ["p", "q", "r", "s"])
    assert [len(w) for w in chain.weights] == [5, 6]  # marks (and earlier categories) and an intercept
    p = chain.predict(["p", "q", "r", ""])
    assert p[0, 0] > 0.5 > p[1, 0] and p[0, 1] > 0.5 and p[1, 1] > 0.5 and p[2, 1] < 0.5


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(4, 1), (8, 1), (5, 0), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    docs = make_docs(odd_rows, extra=True)
    chain = toxicity.fit(docs, labels)
    assert toxicity.classify(docs, chain).count() == len(odd_rows)
    assert toxicity.keep_clean(docs, chain).columns == docs.columns
    none = toxicity.fit(docs, labels.where(F.lit(False)))
    assert toxicity.classify(docs, none).where("toxic").count() == 0
    assert toxicity.classify(make_docs([]), toxicity.fit(make_docs([]), labels)).count() == 0


def test_kinds_are_found_in_any_language(spark):
    """Every toxic labelled row with marks has a kind, in each language of the documents, and no clean row has."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit(docs, labels)
    assert chain.categories == ["kind_1", "kind_2", "kind_3", "toxic"] and len(chain.weights) == 4
    got = toxicity.classify(docs, chain).join(labels.where("toxic = 1"), "doc_id", "left_semi").join(docs.select("doc_id", "lang"), "doc_id")
    by = {r.lang: (r.n, r.p, r.caught) for r in got.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.greatest("p_kind_1", "p_kind_2", "p_kind_3")).alias("p"), F.avg(F.col("toxic").cast("double")).alias("caught")).collect()}
    assert all(p > 0.3 and caught > 0.7 for n, p, caught in by.values() if n >= 20), by


def test_kinds():
    rng = np.random.default_rng(3)
    group = np.arange(90) % 3
    x = np.zeros((90, 12), np.float32)
    for i, g in enumerate(group):
        x[i, 4 * g + rng.choice(4, 2, replace=False)] = 1
    found = toxicity.kinds(x)
    assert len({(g, k) for g, k in zip(group.tolist(), found.tolist(), strict=True)}) == 3
    assert toxicity.kinds(np.zeros((0, 5), np.float32)).tolist() == []
    assert set(toxicity.kinds(np.zeros((4, 5), np.float32)).tolist()) == {0}
    assert set(toxicity.kinds(np.ones((4, 5), np.float32)).tolist()) == {0}


def test_equal_scores_at_the_threshold(make_docs):
    """Rows that score alike are judged alike: the threshold lies between scores, never on one."""
    x = np.repeat(np.array([[1, 0], [0, 0]], np.float32), [40, 60], axis=0)
    y = np.r_[np.ones(40, int), np.zeros(60, int)]
    chain = toxicity.train(x, y[:, None], ["toxic"], ["bad", "word"])
    got = toxicity.classify(make_docs([(i, "bad" if i % 2 else "fine") for i in range(20)]), chain).collect()
    assert {(r.doc_id % 2, r.toxic) for r in got} == {(1, True), (0, False)}


def test_folds_keep_copies_together():
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    assert toxicity.fold_of(text) == toxicity.fold_of(text.upper() + "!")
    assert toxicity.fold_of("") == toxicity.fold_of(None) == 0 and toxicity.fold_of("one two") in range(toxicity.FOLDS)
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(60)]
    assert sum(toxicity.fold_of(t) == toxicity.fold_of(text) for t in near) > 50
    assert len({toxicity.fold_of(f"some other text number {i} of many") for i in range(60)}) == toxicity.FOLDS


def test_the_threshold_has_not_seen_its_rows(spark, make_docs):
    """Labels that nothing in the texts explains: chains that see their own rows would find marks for them."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{rng.integers(10**9):x}" for _ in range(30)) + f" own{i}word") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    chain = toxicity.fit(make_docs(rows), labels)
    assert toxicity.classify(make_docs(rows), chain).where("toxic").count() <= 3


def test_verdicts_equal_a_plain_chain(spark, data):
    """Each row's probabilities, term by term in plain Python."""
    import math

    docs = table(spark, data, "documents")
    chain = toxicity.fit(docs, table(spark, data, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.classify(docs, chain).collect():
        found, earlier = toxicity.marks_of(texts[r.doc_id]), []
        for w in chain.weights:
            z = float(w[-1]) + sum(float(w[i]) for m, i in chain.marks.items() if m in found) + sum(float(a) * p for a, p in zip(w[len(chain.marks) : -1], earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-z)))
        assert all(abs(r[f"p_{c}"] - p) < 1e-4 for c, p in zip(chain.categories, earlier, strict=True))
        assert r.toxic == (r.p_toxic >= chain.threshold) and r.kept != r.toxic
