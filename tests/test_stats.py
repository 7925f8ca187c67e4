"""Metrics, paired statistics and the rule language: closed-form values."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics, rules, stats


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "truth int, predicted int")


def test_classification(spark):
    m = metrics.classification(rows(spark, [(0, 0), (0, 1), (1, 1), (1, 1)]), 3).first()
    assert math.isclose(m.accuracy, 0.75) and math.isclose(m.balanced_accuracy, 0.75)
    assert math.isclose(m.macro_f1, (2 / 3 + 0.8 + 0) / 3) and math.isclose(m.macro_f1_present, (2 / 3 + 0.8) / 2)


def test_auroc(spark):
    data = [(t, c, float(s if c == 1 else -s)) for t, s in [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)] for c in (0, 1)]
    df = spark.createDataFrame(data, "truth int, label int, score double")
    assert math.isclose(metrics.auroc_ovr(df, 2).first().auroc, 0.75)
    assert metrics.auroc_ovr(df, 3).first().auroc is None
    assert metrics.auroc_ovr(df.where("truth = 1"), 2).first().auroc is None
    ties = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5), (0, 0, 0.5), (1, 0, 0.5)], "truth int, label int, score double")
    assert metrics.auroc_ovr(ties, 2).first().auroc == 0.5


def test_regression(spark):
    m = metrics.regression(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "target double, estimate double")).first()
    assert math.isclose(m.mae, 0.5) and math.isclose(m.rmse, math.sqrt(1.25 / 3)) and math.isclose(m.r2, 1 - 1.25 / (14 / 3))
    assert math.isnan(metrics.regression(spark.createDataFrame([(1.0, 1.5)], "target double, estimate double")).first().r2)


@pytest.mark.parametrize(("pos", "neg", "p"), [(0, 0, 1.0), (5, 0, 0.0625), (6, 0, 0.03125), (4, 1, 0.375), (3, 3, 1.0), (40, 10, 2.386e-05)])
def test_sign_p(spark, pos, neg, p):
    got = spark.range(1).select(stats.two_sided_sign_p(F.lit(pos).cast("bigint"), F.lit(neg).cast("bigint")).alias("p")).first().p
    assert math.isclose(got, p, rel_tol=1e-3)


def test_small_facts(spark):
    assert stats.clusters_needed(0.05) == 6
    assert spark.range(1).select(stats.minimum_p(F.lit(5)).alias("p")).first().p == 0.0625


def deltas(spark, values):
    return spark.createDataFrame([("c", f"s{i:02d}", float(v)) for i, v in enumerate(values)], "contrast string, specimen string, delta double")


def test_effects(spark):
    d = deltas(spark, [1, 2, -3, 0, 4])
    r = stats.signed_ranks(d, ["contrast"]).first()
    assert (r.n_nonzero, r.statistic) == (4, 3.0) and math.isclose(r.rank_biserial, (7 - 3) / 10)
    walsh = sorted((x + y) / 2 for x in (1, 2, -3, 0, 4) for y in (1, 2, -3, 0, 4))
    assert stats.hodges_lehmann(d, ["contrast"]).first().hodges_lehmann == walsh[len(walsh) // 2]
    assert stats.signed_ranks(deltas(spark, [0, 0]), ["contrast"]).first().rank_biserial == 0


def test_bootstrap(spark):
    m = deltas(spark, [1, 2, 3, 4, 5, 6]).withColumnRenamed("delta", "mean_delta")
    b = stats.bootstrap_ci(m, ["contrast"], "specimen", 2000).first()
    assert b.estimate == 3.5 and 1.8 < b.ci_low < 2.7 and 4.3 < b.ci_high < 5.2
    assert stats.bootstrap_ci(m.limit(1), ["contrast"], "specimen", 10).isEmpty()


def test_holm(spark):
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.5)], "family string, name string, p_value double")
    got = {r.name: round(r.p_holm, 6) for r in stats.holm(t, ["family"], tie=["name"]).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.5}


def test_equivalence(spark):
    get = lambda lo, hi, m: spark.range(1).select(*[c.alias(n) for c, n in zip(stats.equivalence(F.lit(lo), F.lit(hi), m), "pe", strict=True)]).first()
    assert tuple(get(-0.01, 0.01, 0.02)) == (0.0, True)
    r = get(-0.03, 0.01, 0.02)
    assert not r.e and math.isclose(r.p, 0.05 * (1 + 0.01))
    assert tuple(get(0.0, 0.0, 0.0)) == (1.0, False)


def test_pairs(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, 1.0), (4, 1.0)], "k int, v double")
    assert [(r.k, r.delta) for r in stats.paired(a, b, ["k"], "v").collect()] == [(1, 0.5)]
    assert stats.paired(a, b, ["k"], "v", drop_missing=False).count() == 2
    assert {(r.k, r.only) for r in stats.asymmetry(a, b, ["k"]).collect()} == {(3, "first"), (4, "second")}


EVIDENCE = rules.Evidence(
    {("A", "B", "macro_f1", "D1", "full"): rules.Contrast(0.1, 0.05, 0.15, 0.01, 30, 10, 10), ("A", "B", "macro_f1", "D2", "full"): rules.Contrast(0.1, 0.05, 0.15, 0.01, 30, 5, 5), ("A", "B", "mae", "D1", "full"): rules.Contrast(-0.2, -0.3, -0.1, 0.02, 30, 10, 10)},
    margins={"macro_f1": 0.2},
    parameters={"A": 100, "B": {"D1": 50, "D2": 150}},
    names={"datasets": ["D1", "D2"]},
    unavailable={"ops": "not measured"},
)


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("sig('A', 'B', 'macro_f1', 'D1')", "True"),
        ("sig('A', 'B', 'macro_f1', 'D2')", "False"),  # five clusters can't reach alpha
        ("sig('A', 'B', 'mae', 'D1')", "True"),
        ("sig('B', 'A', 'macro_f1', 'D1')", "False"),
        ("delta('B', 'A', 'macro_f1', 'D1') == -0.1 and ci_low('B', 'A', 'macro_f1', 'D1') == -0.15", "True"),
        ("sig('A', 'C', 'macro_f1', 'D1') or True", "UNEVALUABLE"),  # all operands are evaluated
        ("sig_any('A', 'B', 'macro_f1', ['D9', 'D1'])", "True"),
        ("sig_any('A', 'C', 'macro_f1', datasets)", "UNEVALUABLE"),
        ("equiv_all('A', 'B', 'macro_f1', datasets)", "True"),
        ("params('A') < params('B')", "UNEVALUABLE"),  # one value against a value for each data set
        ("params('A') * 2 > 150 and 1 < 2 < 3", "True"),
        ("params('Z') < 1", "UNEVALUABLE"),
        ("margin('rmse') > 0", "UNEVALUABLE"),
        ("ops < 1", "UNEVALUABLE"),
        ("noninferior('B', 'A', 'macro_f1', 'D1') if len(datasets) == 2 else False", "True"),
        ("1 / 0 > 1", "UNEVALUABLE"),
        ("not (max([1, 2]) > 3)", "True"),
    ],
)
def test_rules(rule, want):
    assert rules.evaluate(rule, EVIDENCE)[0] == want


@pytest.mark.parametrize("rule", ["__import__('os')", "datasets.append", "[x for x in datasets]", "len(obj=1)", "lambda: 1", "1 +", "unknown > 1", "1 + 1", "f'{1}'", "datasets[0]", "(lambda: 1)()"])
def test_refused(rule):
    with pytest.raises(rules.RuleError):
        rules.evaluate(rule, EVIDENCE)


def test_narrative():
    assert rules.narrative({"N1": "True", "N2": "False"}) == ("N1", False)
    assert rules.narrative({"N1": "True", "N2": "True"}) == (None, True)
    assert rules.narrative({"N1": "UNEVALUABLE"}) == (None, False)


@pytest.mark.parametrize("pos, neg", [(560, 480), (520, 520), (1100, 900), (2000, 1000), (5000, 4900), (1040, 0), (3, 3)])
def test_sign_p_of_many_clusters(spark, pos, neg):
    n, top = pos + neg, max(pos, neg)
    exact = min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(top, n + 1)), 2**n)))
    got = spark.range(1).select(stats.two_sided_sign_p(F.lit(pos).cast("bigint"), F.lit(neg).cast("bigint")).alias("p")).first().p
    assert math.isclose(got, exact, rel_tol=1e-9, abs_tol=1e-300)


def test_r2_of_a_constant_target(spark):
    r2 = lambda pairs: metrics.regression(spark.createDataFrame(pairs, "target double, estimate double")).first().r2
    assert r2([(0.1, 0.1)] * 3) == 1.0 and r2([(0.1, 0.1), (0.1, 0.2), (0.1, 0.1)]) == 0.0


def test_hodges_lehmann_of_many_deltas_is_counted(spark, monkeypatch):
    """Listed or counted, the median is the same; a contrast of any size has one."""
    rng = random.Random(3)
    rows = [(c, rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), 0.0, -0.0])) for c, n in (("a", 41), ("b", 30), ("c", 1), ("d", 2)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("a", None)], "contrast string, delta double")
    listed = {r.contrast: r.hodges_lehmann for r in stats.hodges_lehmann(df, ["contrast"]).collect()}
    monkeypatch.setattr(stats, "MAX_WALSH", 30)
    both = {r.contrast: r.hodges_lehmann for r in stats.hodges_lehmann(df, ["contrast"]).collect()}
    monkeypatch.setattr(stats, "MAX_WALSH", 0)
    counted = {r.contrast: r.hodges_lehmann for r in stats.hodges_lehmann(df, ["contrast"]).collect()}
    assert listed.keys() == counted.keys() == both.keys() and len(listed) == 4
    assert all(math.isclose(v, counted[k], abs_tol=1e-12) and math.isclose(v, both[k], abs_tol=1e-12) for k, v in listed.items())


@pytest.mark.parametrize("rule", ["1 < 'a'", "abs()", "params(['A'])", "-'a' < 1", "'a' - 1 < 2", "max([1, 'a']) > 1"])
def test_an_ill_typed_rule_is_its_own_error(spark, rule):
    with pytest.raises(rules.RuleError):
        rules.evaluate(rule, EVIDENCE)
    got = {r.rule: r.outcome for r in rules.evaluate_all(spark, {"bad": rule, "good": "1 < 2", "open": "ops < 1"}, EVIDENCE).collect()}
    assert got == {"bad": "ERROR", "good": "True", "open": "UNEVALUABLE"}


def test_auroc_with_many_scores(spark):
    """Real-valued scores in several ranges equal the pairwise definition."""
    rng = random.Random(2)
    pairs = [(rng.randrange(3), rng.choice([rng.random(), 0.25, 0.5])) for _ in range(400)]
    table = spark.createDataFrame([(t, k, s if k == 0 else 1 - s) for t, s in pairs for k in (0, 1)], "truth int, label int, score double").repartition(7)
    want = []
    for k in (0, 1):
        s = [(t == k, v if k == 0 else 1 - v) for t, v in pairs]
        wins = [(a > b) + 0.5 * (a == b) for p, a in s if p for q, b in s if not q]
        want.append(sum(wins) / len(wins))
    got = metrics.auroc_ovr(table, 2).first()
    assert math.isclose(got.auroc, sum(want) / 2, rel_tol=1e-12) and got.n_classes_scored == 2


VECTORS = rules.Evidence({}, parameters={"a": {"D2": 1, "D3": 5}, "b": {"D2": 2}, "c": {"D2": 2, "D3": 6}, "d": {"D2": 2, "D3": 4}, "n": 3})


@pytest.mark.parametrize(
    "rule, want",
    [
        ("params('a') < params('b')", "UNEVALUABLE"),  # D3 is missing on one side
        ("params('b') < params('a')", "UNEVALUABLE"),
        ("params('a') < params('c')", "True"),
        ("params('a') < params('d')", "False"),
        ("params('a') < 10", "UNEVALUABLE"),
        ("params('n') < params('c')", "UNEVALUABLE"),
        ("params('a') - params('c') < 0", "UNEVALUABLE"),
        ("+params('n') == 3 and -params('n') == -3", "True"),
        ("-params('a') < params('c')", "UNEVALUABLE"),
        ("1 > 2 > 1 / 0", "False"),  # a false link ends the chain
        ("2 > 1 > 1 / 0", "UNEVALUABLE"),
    ],
)
def test_values_by_data_set_and_chains(rule, want):
    assert rules.evaluate(rule, VECTORS)[0] == want


def test_interval_of_rho_equals_resampled_rows(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(1)
    data = [(g, int(i), float(rng.integers(0, 6)), float(rng.normal())) for g, n in (("a", 25), ("b", 9)) for i in range(n)]
    data += [("flat", i, 1.0, float(i)) for i in range(5)] + [("a", 99, None, 1.0)]
    got = {r["g"]: r for r in stats.spearman_interval(spark.createDataFrame(data, "g string, i int, x double, y double"), ["g"], ["i"], "x", "y", 40, 7).collect()}

    def rank(v):
        return np.array([(np.sum(v < a) + 1 + np.sum(v <= a)) / 2 for a in v])

    def rho(x, y):
        a, b = rank(x), rank(y)
        return np.nan if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]

    for g in ("a", "b"):
        own = np.array([d[2:] for d in data if d[0] == g and d[2] is not None])
        n, each = len(own), []
        for b in range(40):
            at = [int(hashlib.md5(f"7|{b}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
            each.append(rho(own[at, 0], own[at, 1]))
        each = [v for v in each if v == v]
        want = (rho(*own.T), *np.percentile(each, [2.5, 97.5]), n, len(each))
        assert np.allclose([got[g][c] for c in ("rho", "ci_low", "ci_high", "n", "n_draws")], want)
    assert got["flat"]["n_draws"] == 0 and got["flat"]["ci_low"] is None and np.isnan(got["flat"]["rho"])
