"""Studies, protocols and the benchmark: exact tails, freezing, failures as records."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import reservoir, studies
from lattica.plans import benchmark
from lattica.sources import protocol


@pytest.mark.parametrize("n", [6, 8, 11])
def test_exact_signed_ranks(n):
    d = np.random.default_rng(n).normal(0.4, 1, n)
    stat, p, test = studies.signed_rank_p(d)
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert test == "wilcoxon_exact" and stat == w
    assert math.isclose(p, min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_signed_rank_edges():
    assert studies.signed_rank_p(np.zeros(4)) == (0.0, 1.0, "sign_test")
    assert studies.signed_rank_p(np.array([1.0, 2, 3, 4, 5]))[1:] == (0.0625, "sign_test")
    assert studies.signed_rank_p(np.array([1.0, 1, 2, -2, 3, 4, 0]))[2] == "wilcoxon_normal"


def test_controls_keep_constraints():
    rng = np.random.default_rng(0)
    a = np.where(rng.random((25, 25)) < 0.2, rng.integers(1, 4, (25, 25)), 0).astype(float)
    np.fill_diagonal(a, 0)
    family = studies.topology_family(a, 3)
    assert sorted(family) == [f"R{i}" for i in range(7)]
    for k in ("R1", "R2", "R3"):
        m = studies.constraint_match(a, family[k])
        assert m["n"] == m["m"] == 0 and abs(m["rho"]) < 1e-6
    assert ((family["R2"] != 0).sum(0) == (a != 0).sum(0)).all() and ((family["R2"] != 0).sum(1) == (a != 0).sum(1)).all()
    x = rng.normal(0, 1, (150, 2))
    gate = studies.search_gain(reservoir.scaled(a, 0.9), rng.normal(0, 1, (25, 2)), x, [0.1, 1.0, 3.0])
    assert 0 < gate["ratio"] and gate["rank"] > 1


def test_protocol(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("contrasts:\n- {id: c1, a: A, b: B}\n- {id: c2, a: A, b: C}\nfamilies: {F: [c1]}\ngrids: {esn: {leak: [0.1, 0.3]}}\n")
    with pytest.raises(ValueError):
        protocol.load(path, frozen=True)
    protocol.freeze(path)
    doc = protocol.load(path, frozen=True)
    assert [tuple(r) for r in protocol.contrasts(spark, doc).orderBy("contrast").collect()] == [("c1", "A", "B", "F"), ("c2", "A", "C", None)]
    assert protocol.grids(doc) == {"esn": {"leak": [0.1, 0.3]}} and protocol.leaves(doc)["grids.esn.leak"] == [0.1, 0.3]
    assert protocol.config_hash({"b": 1, "a": 2}) == protocol.config_hash({"a": 2, "b": 1})
    path.write_text(path.read_text() + "# changed\n")
    with pytest.raises(ValueError):
        protocol.load(path, frozen=True)
    with pytest.raises(ValueError):
        protocol.contrasts(spark, {"contrasts": [], "families": {"F": ["c"], "G": ["c"]}})


def test_benchmark_records(spark):
    rows = [(f"sp{s}", f"sp{s}", float(t), float(s % 2 * 3 + t % 2), s % 2, float(s % 2)) for s in range(8) for t in range(20)]
    frame = spark.createDataFrame(rows, "specimen_id string, session_id string, time_index double, a double, freshness_class int, tvc double")
    got = benchmark.run(frame, "D", ["a"], ["svm_rbf", "gru"], tasks=("classification", "regression"), lengths=[5], max_folds=2, stride=3, n_classes=2)
    status = {(r.model, r.status) for r in got.collect()}
    assert status == {("svm_rbf", "ok"), ("gru", "failed")} and got.count() == 8
    assert got.where("model = 'gru'").first().failure_reason.startswith("NotImplementedError")
    s = benchmark.summary(got, ["accuracy", "mae"]).where("task = 'classification'").first()
    assert s.n_runs == 2 and s.accuracy_mean > 0.7
    again = benchmark.run(frame, "D", ["a"], ["svm_rbf"], tasks=("classification", "regression"), lengths=[5], max_folds=2, stride=3, n_classes=2, done=got)
    assert again.count() == 0
    assert got.where(F.col("duration_s") < 0).isEmpty()


def test_families_and_feasibility():
    assert sorted(studies.coprime_lengths(30, 3)) and sum(studies.coprime_lengths(97, 4)) == 97
    for n, k in ((30, 3), (97, 4), (8, 2)):
        sizes = studies.coprime_lengths(n, k)
        assert sum(sizes) == n and all(math.gcd(a, b) == 1 for a, b in itertools.combinations(sizes, 2))
    rng = np.random.default_rng(1)
    a = np.where(rng.random((24, 24)) < 0.25, rng.integers(1, 3, (24, 24)), 0).astype(float)
    np.fill_diagonal(a, 0)
    f = studies.audit_families(a, rng.normal(0, 1, (24, 2)), 2)
    assert all(abs(reservoir.spectral_radius(m) - reservoir.spectral_radius(a)) < 1e-6 for m in f.values())
    assert ((f["F2"] != 0).sum(0) == (a != 0).sum(0)).all() and (f["F3"] != 0).sum() == (a != 0).sum()
    b = np.ones((24, 1))
    labels = ["x"] * 12 + ["y"] * 12
    same = studies.organisation_feasible(a, a, labels, b, b, (1.0, 1.0), False)
    assert not same["feasible"] and not same["type_pairs_changed"] and same["degrees_kept"] and same["weights_kept"]
    assert studies.closed_walk_nodes(np.roll(np.eye(4), 1, 0), 4) == [0, 0, 0, 4]


def test_contrast_matrix(spark):
    schema = "id string, parent string, varied string, fixed array<string>, blocked boolean"
    problems = lambda rows: sorted((r.problem, r.id, r.other) for r in studies.contrast_matrix_problems(spark.createDataFrame(rows, schema)).collect())
    good = [("F1", None, "none (reference)", ["a"], None), ("F2", "F1", "wiring", ["degree", "n"], False), ("F3", "F2", "degree", ["n"], False)]
    assert problems(good) == [] and problems([]) == []
    bad = [*good[:2], ("F3", "F9", " Wiring", ["x"], False), ("F4", None, "wiring", [], True), ("F4", "F1", "size", [], True)]
    assert problems(bad) == [("holds no more fixed than F3", "F2", "F3"), ("no parent", "F4", None), ("repeated", "F4", None), ("same factor", "F2", "F3"), ("unknown parent", "F3", "F9")]
    assert problems([("F1", None, "size", None, None)]) == [("reference varies", "F1", None)]


def test_impossible_lengths_are_an_error():
    for n, k in ((4, 3), (6, 2), (3, 2)):
        with pytest.raises(ValueError):
            studies.coprime_lengths(n, k)


def test_grid_covers_every_fold_and_specimen(spark, data, monkeypatch):
    from lattica import catalog
    from lattica.plans import benchmark
    from lattica.plans.sensor import frame

    seen = []
    monkeypatch.setattr(benchmark, "evaluate", lambda model, w, n: seen.append(w.select("specimen_id").distinct().count()) or {})
    rows = catalog.QUERIES["benchmark_grid"](spark, data).collect()
    specimens = frame(spark, data).select("specimen_id").distinct().count()
    folds = {r.run_id.split("|")[4] for r in rows}
    assert len(folds) == 5 and len(seen) == 10 and all(n == specimens for n in seen), (folds, seen, specimens)


@pytest.mark.parametrize(("n", "blocks"), [(1000, 8), (4000, 8), (625, 5), (40_000, 30), (77, 8), (98, 8)])
def test_coprime_lengths_are_found_at_once(n, blocks):
    began = time.perf_counter()
    found = studies.coprime_lengths(n, blocks)
    assert time.perf_counter() - began < 2
    assert sum(found) == n and len(found) == blocks and min(found) >= 2
    assert all(math.gcd(a, b) == 1 for a, b in itertools.combinations(found, 2))


def test_coprime_lengths_of_small_sums_equal_brute_force():
    for n in range(1, 26):
        for k in range(5):
            possible = any(sum(c) == n and all(math.gcd(a, b) == 1 for a, b in itertools.combinations(c, 2)) for c in itertools.combinations_with_replacement(range(2, n + 1), k))
            if possible and k:
                assert sum(studies.coprime_lengths(n, k)) == n
            else:
                with pytest.raises(ValueError):
                    studies.coprime_lengths(n, k)
