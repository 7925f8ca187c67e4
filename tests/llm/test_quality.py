"""Operators 4 and 10: base counts against brute force, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality_model, quality_rules, queries
from lattica.llm.common import table
from lattica.llm.textstats import text_counts


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


@pytest.mark.parametrize("text", ["", "a", "a b\x0bc\x0cd\re\xa0f", "x y\nx y\n \nx y", "a b c d e f g h " * 3, "q a b c d e f g h z a b c d e f g h", "##|<>\n##|<>", "a b \x1c c\x85d"])
def test_counts(text):
    assert text_counts(text)[:5] == brute(text)


def test_rules_query(spark, data):
    got = queries.op4_quality_rules(spark, data).toPandas().set_index("doc_id")
    docs = table(spark, data, "documents").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in docs.text.items():
        n = brute(t)
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == n
        assert got.loc[i, "base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got.loc[i, "base_failed"] and got.loc[i, "kept"])
    labels = table(spark, data, "labels").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    good = both[(both.quality == 1) & ~both.base_failed]
    assert good.kept.mean() > 0.97


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(8, 1, (5, 3))])
    f = quality_rules.IsolationForest.grow(x)
    s = f.score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97)
    f.calibrate(s, np.arange(505) < 500, 0.01)
    assert (s[500:] >= f.threshold).all() and (s[:500] >= f.threshold).mean() <= 0.01


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, sf)
    labels = table(spark, sf, "labels")
    p = got.join(labels, "doc_id").where("held_out").toPandas()
    assert len(p) > 40
    assert ((p.predicted == 1) == (p.quality == 1)).mean() > 0.95
    every = got.toPandas()
    assert every.score.between(0, 1).all() and (every.predicted == (every.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(every.doc_id, every.held_out, strict=True))


def test_learns_from_training_rows_only(spark, make_docs):
    docs = make_docs([(i, f"word{i} again and more text here") for i in range(200)])
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    held = labels.where(quality_model.held_out("doc_id"))
    changed = labels.join(held.select("doc_id", F.lit(0).alias("q")), "doc_id", "left").select("doc_id", F.coalesce("q", "quality").alias("quality"))
    assert quality_model.fit(docs, changed) == 1.0  # the only zeros are held out


def test_odd_rows(spark, make_docs, odd_rows, data):
    docs, labels = make_docs(odd_rows, extra=True), table(spark, data, "labels")
    known = table(spark, data, "documents")
    forest, model = quality_rules.fit(known, labels), quality_model.fit(known, labels)
    assert quality_rules.judge(docs, forest).count() == len(odd_rows)
    assert quality_rules.keep_good(docs, forest).columns == docs.columns
    assert quality_model.classify(docs, model).count() == len(odd_rows)
    empty = make_docs([])
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0
    assert quality_model.classify(empty, quality_model.fit(empty, labels)).count() == 0
    assert quality_rules.judge(docs, None).where("kept AND base_failed").count() == 0


def path_length(forest, t, row):
    """Walk one tree."""
    node, depth = 0, 0
    while forest.feature[t, node] >= 0:
        node = 2 * node + (1 if row[forest.feature[t, node]] < forest.cut[t, node] else 2)
        depth += 1
    assert depth <= forest.path[t, node] + 1e-9  # plus what the rows left there would take
    return forest.path[t, node]


def test_verdicts_equal_walks_over_all_trees(spark, data):
    docs = table(spark, data, "documents")
    forest = quality_rules.fit(docs, table(spark, data, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs, forest).collect():
        row = quality_rules.rates(np.array([text_counts(texts[r.doc_id] or "")]))[0]
        mean = np.mean([path_length(forest, t, row) for t in range(len(forest.feature))])
        score = 2.0 ** -(mean / forest.norm)
        n = brute(texts[r.doc_id])
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert abs(r.anomaly - score) < 1e-9 and r.kept == (not failed and r.anomaly < forest.threshold)


def test_the_threshold_is_calibrated_on_rows_not_grown_on(spark):
    """Of good rows that were neither grown on nor calibrated with, few more are rejected than calibration may reject."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    forest = quality_rules.fit(docs, labels.where("doc_id % 4 <> 0"))
    p = quality_rules.judge(docs, forest).join(labels.where("doc_id % 4 = 0"), "doc_id").where("NOT base_failed").toPandas()
    good, bad = p[p.quality == 1], p[p.quality == 0]
    assert len(good) > 500 and (~good.kept).mean() < 0.01
    assert len(bad) > 20 and (~bad.kept).mean() > 0.8


def test_densities_equal_the_multivariate_normal():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(1, 2, (200, 4)) @ rng.normal(size=(4, 4))])
    y = np.repeat([0, 1], [300, 200])
    model = quality_model.Discriminant.fit(x, y)
    logs = []
    pooled = sum((y == k).mean() * np.cov(x[y == k].T, bias=True) for k in (0, 1)) + 1e-4 * np.eye(4)
    for k in (0, 1):
        own = x[y == k]
        cov = (1 - quality_model.POOLED) * np.cov(own.T, bias=True) + quality_model.POOLED * pooled
        cov = (1 - quality_model.DIAGONAL) * cov + quality_model.DIAGONAL * np.diag(np.diag(cov))
        d = x - own.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1] + np.log((y == k).mean()))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(logs[1] - logs[0]))), atol=1e-9)


def test_every_labelled_row_is_grown_on_and_calibrated_with(spark, make_docs, monkeypatch):
    """More labelled rows than the 10,000 that a fit once took: all are scored, and all may be in trees."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words here and "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 40 > 0).cast("int").alias("quality"))
    seen, keep = [], quality_rules._threshold
    monkeypatch.setattr(quality_rules, "_threshold", lambda scored: seen.append(scored.count()) or keep(scored))
    quality_rules.fit(docs, labels)
    assert seen == [12_000]


def test_the_threshold_equals_that_of_all_scores_together(spark):
    rng = np.random.default_rng(4)
    good = rng.random(3000) < 0.9
    score = np.round(np.where(good, rng.normal(0.4, 0.05, 3000), rng.normal(0.6, 0.08, 3000)), 3)
    forest = quality_rules.IsolationForest(np.zeros(0), np.zeros(0), np.zeros(0), 1.0)
    forest.calibrate(score, good)
    df = spark.createDataFrame(list(zip(score.tolist(), good.tolist(), strict=True)), "score double, good boolean")
    assert abs(quality_rules._threshold(df) - forest.threshold) < 1e-12 and forest.threshold < 1
    assert quality_rules._threshold(df.where("good")) is None
