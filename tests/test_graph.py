"""Graphs, reservoirs and models against brute force and known toys."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import graph, models, reservoir


def frame(spark, pairs):
    return spark.createDataFrame([(int(a), int(b), 1) for a, b in pairs], "src bigint, dst bigint, w bigint")


def closure(pairs):
    ids = {x for p in pairs for x in p}
    reach = {i: {i} for i in ids}
    for i in ids:
        todo = [i]
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in reach[i]:
                    reach[i].add(b)
                    todo.append(b)
            todo.pop(0)
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)]
    r = closure(pairs)
    for local in (0, 1000):
        strong = {x.node: x.label for x in graph.strong_components(frame(spark, pairs), local).collect()}
        assert strong == {i: min(j for j in r[i] if i in r[j]) for i in r}
    und = closure(pairs + [(b, a) for a, b in pairs])
    weak = {x.node: x.label for x in graph.weak_components(frame(spark, pairs)).collect()}
    assert all(label == min(und[i]) for i, label in weak.items())
    assert {x.node for x in graph.reachable(frame(spark, pairs), spark.createDataFrame([(pairs[0][0],)], "id bigint")).collect()} == r[pairs[0][0]]


def test_long_chain(spark):
    n = 60
    e = frame(spark, [(i, i + 1) for i in range(n)])
    assert {x.label for x in graph.weak_components(e).collect()} == {0}


@pytest.mark.parametrize("pairs", [[(4, 3), (5, 4), (3, 1), (5, 2)], [(i * 7 % 61, (i + 1) * 7 % 61) for i in range(60)], [(1, 1)], []])
def test_a_node_has_one_weak_component(spark, pairs):
    """Chains whose ids aren't in order; a node with two centres, none of which is a ray, isn't done."""
    und = closure(pairs + [(b, a) for a, b in pairs])
    want = sorted((i, min(r)) for i, r in und.items() if r != {i})
    assert sorted(map(tuple, graph.weak_components(frame(spark, pairs)).collect())) == want


def test_cycle_radius_and_walks(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    a = np.zeros((4, 4))
    a[[1, 2, 3, 0], [0, 1, 2, 3]] = 1
    assert abs(reservoir.spectral_radius(a) - 1) < 1e-9
    dense = np.abs(np.linalg.eigvalsh(((a + a.T) > 0).astype(float))).max()
    star = frame(spark, [(0, i) for i in range(1, 5)] + [(1, 2)])
    s = np.zeros((5, 5))
    for i, j in [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2)]:
        s[i, j] = s[j, i] = 1
    assert abs(dense - 2) < 1e-9
    assert abs(graph.spectral_radius(star, 200) - np.abs(np.linalg.eigvalsh(s)).max()) < 1e-4
    assert graph.closed_walks(e, 4).count() == 4 and graph.closed_walks(e, 3).isEmpty()


def test_quotas():
    q = graph.proportional_quotas({"a": 70.0, "b": 25.0, "c": 5.0}, {"a": 4, "b": 50, "c": 50}, 20)
    assert sum(q.values()) == 20 and q["a"] == 4
    for total, caps in itertools.product((3, 7, 12), ({"a": 5, "b": 5, "c": 5}, {"a": 1, "b": 9, "c": 2})):
        q = graph.proportional_quotas({"a": 1.0, "b": 1.0, "c": 0.0}, caps, total)
        assert sum(q.values()) == min(total, sum(caps.values())) and all(q[k] <= caps[k] for k in q)


def test_controls():
    src, dst = reservoir.random_graph(20, 60, 1)
    w = np.random.default_rng(0).integers(1, 4, 60)
    s2, d2, w2 = reservoir.rewired(src, dst, w, 400, 2)
    assert (np.bincount(d2, minlength=20) == np.bincount(dst, minlength=20)).all() and (s2 != d2).all()
    assert len(set(zip(s2, d2, strict=True))) == 60 and (d2 != dst).any()
    assert all(np.bincount(d2, w2 == v, 20).tolist() == np.bincount(dst, w == v, 20).tolist() for v in (1, 2, 3))
    assert (reservoir.rewired(src, dst, w, 10, 2, keep_weights=False)[2] == 1).all()
    assert len(set(zip(src, dst, strict=True))) == 60 and (src != dst).all()
    a, b = reservoir.small_world(30, 2, 0.1, 1)
    assert (a != b).all() and 50 <= len(a) <= 60


def test_ranks():
    n = 20
    chain = np.diag(np.ones(n - 1), -1)
    b = np.zeros((n, 1))
    b[0] = 1
    assert abs(reservoir.krylov_rank(chain, b) - 17) < 1e-9 and abs(reservoir.controllability_rank(chain, b) - 16) < 1e-9
    assert reservoir.krylov_rank(np.zeros((n, n)), b) == 1
    assert reservoir.participation_rank(np.vstack([np.eye(4), -np.eye(4)])) > 3.9
    assert reservoir.henrici(np.eye(3)) < 1e-6 < reservoir.henrici(chain)
    rows = {c: s for c, s, *_ in reservoir.audit(np.zeros((n, n)), b, 0.0)}
    assert rows == {"A1": "FAIL", "A3": "FAIL", "A4": "not_applicable", "A5": "not_applicable"}
    assert reservoir.ring_capacity(20, 15) > 8
    u, y = reservoir.narma(300)
    assert np.isfinite(y).all() and reservoir.delayed_xor(50)[1].max() == 1 and len(u) == 300


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        c = i % 3
        x = rng.normal(c, 0.4, (6, 2))
        rows.append((i, [[float(v) for v in r] for r in x], c, float(c) + float(rng.normal(0, 0.1))))
    return spark.createDataFrame(rows, "id bigint, x array<array<double>>, label int, target double")


def test_states_match_the_recurrence(windows):
    r = reservoir.random_reservoir(2, 3, reservoir_size=15, washout=2, state_pooling="mean")
    row = windows.where("id = 7").first()
    h, seen = np.zeros(15), []
    for t, x in enumerate(row.x):
        h = (1 - r.leak) * h + r.leak * np.tanh(r.gain * r.a @ h + r.w_in @ np.array(x) + r.bias)
        if t >= 2:
            seen.append(h)
    got = reservoir.window_states(windows, r, ["id"]).where("id = 7").first().state
    assert np.allclose(got, np.mean(seen, axis=0))


def test_ridge_equals_numpy(windows):
    flat = windows.withColumn("f", F.flatten("x"))
    w = reservoir.ridge(flat, "f", "target", 0.1)
    pdf = flat.toPandas()
    h = np.column_stack([np.vstack(pdf.f), np.ones(len(pdf))])
    assert np.allclose(w[:, 0], np.linalg.solve(h.T @ h + 0.1 * np.eye(13), h.T @ pdf.target.to_numpy()))


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "pca_svm", "svm_rbf", "esn"])
def test_models_beat_chance(windows, name):
    train, test = windows.where("id % 4 <> 0"), windows.where("id % 4 = 0")
    options = {"n_classes": 3} if name in ("svm_rbf", "pca_svm", "esn") else {"n_estimators": 10, "max_depth": 5}
    got = models.build_model(name, **options).fit(train).predict(test)
    assert got.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0] > 0.75


def test_registry_and_selection(windows):
    assert models.availability()["gru"] != "available" and models.availability()["esn"] == "available"
    with pytest.raises(NotImplementedError):
        models.build_model("lstm")
    train, test = windows.where("id % 4 <> 0"), windows.where("id % 4 = 0")
    best, scores = models.select_hyperparameters(lambda task, **kw: models.build_model("svm_rbf", task, n_classes=3, **kw), {"penalty": [1e6, 1e-2]}, train, test)
    assert best in ({"penalty": 1e6}, {"penalty": 1e-2}) and len(scores) == 2


def test_options_reach_the_estimators(windows):
    forest = models.build_model("random_forest", n_estimators=7, max_depth=2, min_samples_leaf=3).estimator
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (7, 2, 3)
    plain = models.build_model("random_forest", models.REGRESSION).estimator
    assert (plain.getNumTrees(), plain.getMaxDepth()) == (300, 30)
    plain = models.build_model("boosted_trees", models.REGRESSION).estimator
    assert (plain.getMaxIter(), plain.getMaxDepth(), plain.getStepSize(), plain.getSubsamplingRate()) == (300, 6, 0.1, 0.9)
    assert models.build_model("boosted_trees", models.REGRESSION, n_estimators=4, learning_rate=0.3).estimator.getStepSize() == 0.3
    for name in ("random_forest", "boosted_trees", "pca_svm", "svm_rbf"):
        with pytest.raises(TypeError):
            models.build_model(name, no_such_option=1)
    train, test = windows.where("id % 4 <> 0"), windows.where("id % 4 = 0")
    grid = {"n_estimators": [1, 20], "max_depth": [1, 6]}
    best, scores = models.select_hyperparameters(lambda task, **kw: models.build_model("random_forest", task, **kw), grid, train, test)
    assert len(set(scores)) > 1 and scores[models.grid(grid).index(best)] == max(scores)


def test_components_explain_the_share(windows):
    flat = np.vstack([np.ravel(r.x) for r in windows.collect()])
    share = np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(flat.T)))[::-1]) / np.trace(np.cov(flat.T))
    for want in (0.5, 0.95, 3):
        fitted = models.build_model("pca_svm", models.REGRESSION, n_components=want).fit(windows)
        assert fitted.components.shape[1] == (want if want >= 1 else 1 + int(np.searchsorted(share, want)))


def test_top_eigenvalues(spark):
    rng = np.random.default_rng(4)
    a = np.where(rng.random((12, 12)) < 0.4, rng.integers(1, 9, (12, 12)), 0)
    e = spark.createDataFrame([(int(s), int(d), int(a[d, s])) for d, s in zip(*np.nonzero(a), strict=True)], "src bigint, dst bigint, w bigint")
    want = np.sort(np.abs(np.linalg.eigvalsh((a + a.T) / 2)))[::-1][:5]
    assert np.allclose(graph.top_eigenvalues(e, spark.range(12), 5), want)
    assert graph.top_eigenvalues(e, spark.range(0), 5) == [0.0]


def test_edges_of_weight_zero_have_no_stubs(spark):
    e = spark.createDataFrame([(1, 2, 0), (3, 4, 2)], "src bigint, dst bigint, w bigint")
    assert graph.configuration_model(e, 1).agg(F.sum("w")).first()[0] == 2


def test_readouts_by_group_equal_those_of_each_group(windows):
    """Weights and predictions of all groups from one pass are those of each group alone."""
    rows = windows.withColumns({"f": F.flatten("x"), "g": F.col("id") % 3, "k": F.when(F.col("id") % 2 == 0, "a").otherwise("b")})
    weights = reservoir.ridge_by(rows, ["k", "g"], "f", "label", 0.1, 3)
    assert set(weights) == {(k, g) for k in "ab" for g in range(3)}
    for (k, g), w in weights.items():
        one = rows.where((F.col("k") == k) & (F.col("g") == g))
        assert np.allclose(w, reservoir.ridge(one, "f", "label", 0.1, 3))
    del weights["a", 0]
    got = {r.id: r.predicted for r in reservoir.read_out_by(rows, ["k", "g"], "f", weights).select("id", "predicted").collect()}
    want = {r.id: r.predicted for (k, g), w in weights.items() for r in reservoir.read_out(rows.where((F.col("k") == k) & (F.col("g") == g)), "f", w).collect()}
    assert {i: p for i, p in got.items() if p is not None} == want and all(got[i] is None for i in got if i % 6 == 0)


def test_states_of_several_reservoirs(windows):
    family = {str(i): reservoir.random_reservoir(2, i, reservoir_size=9) for i in range(3)}
    both = {(r.control, r.id): r.state for r in reservoir.window_states_of(windows, family, ["id"]).collect()}
    for name, r in family.items():
        assert all(np.allclose(both[name, x.id], x.state) for x in reservoir.window_states(windows, r, ["id"]).collect())


def test_radii_of_all_subgraphs_equal_dense_ones(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for key, n in (("a", 12), ("b", 25), ("star", 6), ("loop", 1)):
        pairs = {(0, i) for i in range(1, n)} if key == "star" else {(0, 0)} if key == "loop" else {tuple(map(int, p)) for p in rng.integers(0, n, (4 * n, 2))}
        a = np.zeros((n, n))
        for s, d in pairs:
            a[s, d] = a[d, s] = 1
        want[key] = np.abs(np.linalg.eigvalsh(a)).max()
        rows += [(key, s, d) for s, d in pairs]
    found = graph.spectral_radii(spark.createDataFrame(rows, "k string, src bigint, dst bigint"), ["k"], 100).collect()
    assert {r["k"] for r in found} == set(want)
    assert all(abs(r["radius"] - want[r["k"]]) < 1e-5 for r in found) and len({r["rounds"] for r in found}) > 1
    assert graph.spectral_radii(spark.createDataFrame([], "k string, src bigint, dst bigint"), ["k"]).count() == 0


def test_a_selection_beside_random_ones_equals_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(3)
    pairs = sorted({tuple(map(int, p)) for p in rng.integers(0, 40, (70, 2))})
    nodes = spark.range(40)
    chosen = list(range(0, 40, 3))
    found = graph.selection_against_random(spark.createDataFrame(pairs, "src bigint, dst bigint"), nodes, spark.createDataFrame([(i,) for i in chosen], "id bigint"), 6, 2).first()
    eligible = [p for p in pairs if p[0] != p[1]]

    def measured(ids):
        inside = [p for p in eligible if p[0] in ids and p[1] in ids]
        label = {i: i for i in ids}
        for _ in ids:
            for s, d in inside:
                label[s] = label[d] = min(label[s], label[d])
        return len(inside) / len(eligible), len(set(label.values()))

    share, parts = measured(set(chosen))
    key = lambda b, i: (int(hashlib.md5(f"select|2|{b}|{i}".encode()).hexdigest()[:8], 16), i)
    drawn = [measured(set(sorted(range(40), key=lambda i: key(b, i))[: len(chosen)])) for b in range(6)]  # noqa: B023
    want = (share, parts, np.mean([d[0] for d in drawn]), np.mean([d[1] for d in drawn]), np.mean([d[0] <= share for d in drawn]))
    assert np.allclose(list(found), want)


def test_absolute_norm_keeps_rows_without_weight(spark):
    e = spark.createDataFrame([(1, 2, -3.0), (1, 3, 1.0), (2, 1, 0.0)], "src bigint, dst bigint, w double")
    assert {(r.src, r.dst): r.w for r in graph.absolute_norm(e, 2.0).collect()} == {(1, 2): -1.5, (1, 3): 0.5, (2, 1): 0.0}


def test_impact_of_few_rounds(spark):
    """A clique converges at once, a path slowly: only the clique's scaling holds after two rounds."""
    rows = [("clique", i, j) for i in range(5) for j in range(5) if i < j] + [("path", i, i + 1) for i in range(9)]
    trace = graph.radius_trace(spark.createDataFrame(rows, "k string, src int, dst int"), ["k"], 300).cache()
    got = {(r.k, r.rounds): r for r in graph.radius_impact(trace, ["k"], [1, 2, 250]).collect()}
    path = 2 * np.cos(np.pi / 11)
    x = np.ones(10)
    a = np.eye(10, k=1) + np.eye(10, k=-1)
    norms = [np.sqrt(10)]
    for k in (1, 2):
        y = a @ (x if k == 1 else x / norms[-1])
        norms.append(np.linalg.norm(y))
        x = y
    assert got["clique", 1].kept is False and got["clique", 2].kept and got["clique", 250].error == 0
    assert abs(got["path", 2].error - abs(norms[2] - path)) < 1e-6 and not got["path", 2].kept
    assert abs(got["path", 2].scaled - 0.95 * path / norms[2]) < 1e-6 and got["path", 250].kept
