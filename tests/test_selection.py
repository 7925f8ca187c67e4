import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import reservoir, selection
from lattica.operators.selection import DeclaredGrid, OutOfGridError


def rows_of(spark, n=400, seed=0, n_classes=None):
    rng = np.random.default_rng(seed)
    x, h = rng.normal(size=(n, 3)), rng.normal(size=(n, 4))
    y = x @ [1.0, -2.0, 0.5] + h @ [0.5, 0.0, 1.0, -1.0] + rng.normal(size=n) * 0.3
    label = np.digitize(y, [-1.5, 1.5])
    split = np.array(["train", "train", "val", "test"])[rng.integers(0, 4, n)]
    data = [(int(i), int(i % 3), str(split[i]), x[i].tolist(), h[i].tolist(), float(y[i]), int(label[i])) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, fold_id int, split string, x array<double>, h array<double>, y double, label int").repartition(5), data


def weights(f, y, penalty):
    z = np.column_stack([f, np.ones(len(f))])
    return np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y)


def test_only_declared_values_and_shared_knobs_pass():
    grid = DeclaredGrid({"radius": (0.5, 0.9), "lambda": (0.1, 1, "auto"), "flag": (True,)}, frozenset({"radius"}))
    assert grid.points()[:3] == [{"radius": 0.5, "lambda": v, "flag": True} for v in (0.1, 1, "auto")]
    assert len(grid.points({"radius": 0.9})) == 3
    grid.check("lambda", 1.0)
    grid.check("n_estimators", 7)  # not declared: a model's own
    for name, value in (("lambda", 0.2), ("flag", 1), ("lambda", "1"), ("radius", True)):
        with pytest.raises(OutOfGridError):
            grid.check(name, value)
    with pytest.raises(OutOfGridError):
        grid.points({"radius": 0.7})
    with pytest.raises(ValueError, match="not shared"):
        grid.points({"lambda": 0.1})
    with pytest.raises(OutOfGridError):
        DeclaredGrid({"a": (1,)}, frozenset({"radius"})).points({"radius": 0.5})
    with pytest.raises(ValueError, match="no candidates"):
        DeclaredGrid({"a": ()}).points()


def test_a_path_equals_separate_solutions(spark):
    df, data = rows_of(spark)
    penalties = [0.0, 0.1, 10.0, 1e4]
    for r in reservoir.ridge_paths(df, ["fold_id"], "x", "y", penalties).collect():
        own = [d for d in data if d[1] == r["fold_id"]]
        want = weights(np.array([d[3] for d in own]), np.array([d[5] for d in own]), r["penalty"])
        assert np.allclose(r["weights"], want, atol=1e-8)


def test_columns_without_variance_have_no_weight_at_no_penalty(spark):
    df, _ = rows_of(spark, 60)
    twice = df.withColumn("z", F.concat("x", "x", F.array(F.lit(0.0))))
    (r,) = reservoir.ridge_paths(twice, [], "z", "y", [0.0]).collect()
    w = np.array(r["weights"])
    assert np.isfinite(w).all() and np.allclose(w[:3], w[3:6]) and w[6] == 0


@pytest.mark.parametrize("n_classes", [None, 3])
def test_the_selected_point_is_that_of_separate_fits(spark, n_classes):
    df, data = rows_of(spark, 900, 4)
    grid = DeclaredGrid({"kind": ("a", "b"), "ridge_lambda": (1e5, 0.5, 50.0)})
    both = df.withColumn("kind", F.lit("a")).withColumn("f", F.col("x")).unionByName(df.withColumn("kind", F.lit("b")).withColumn("f", F.concat("x", "h")))
    got = {r["fold_id"]: r for r in selection.select_penalty(both, ["fold_id"], "f", "label" if n_classes else "y", grid, control="kind", n_classes=n_classes).collect()}
    for fold in range(3):
        best = None
        for p in grid.points():
            part = lambda s, fold=fold: [d for d in data if d[1] == fold and d[2] == s]
            f = lambda rows, p=p: np.array([d[3] + (d[4] if p["kind"] == "b" else []) for d in rows])
            t, v = part("train"), part("val")
            y = np.eye(3)[[d[6] for d in t]] if n_classes else np.array([d[5] for d in t])
            out = np.column_stack([f(v), np.ones(len(v))]) @ weights(f(t), y, p["ridge_lambda"])
            if n_classes:
                said, truth = out.argmax(1), np.array([d[6] for d in v])
                each = [2 * ((said == c) & (truth == c)).sum() / max(1, (said == c).sum() + (truth == c).sum()) for c in range(3)]
                score = float(np.mean(each))
            else:
                score = -float(np.abs(out - [d[5] for d in v]).mean())
            if best is None or score > best[0] + 1e-12:
                best = score, p
        assert (got[fold]["kind"], got[fold]["ridge_lambda"]) == (best[1]["kind"], best[1]["ridge_lambda"])
        assert got[fold]["score"] == pytest.approx(best[0], abs=1e-9) and got[fold]["n_candidates"] == 6


def test_the_first_declared_point_wins_ties_and_a_group_needs_validation_rows(spark):
    df, _ = rows_of(spark)
    flat = df.withColumn("f", F.array(F.lit(0.0)))
    grid = DeclaredGrid({"ridge_lambda": (5.0, 1e-9)})
    tied = flat.withColumn("y", F.lit(0.0))
    assert {r["ridge_lambda"] for r in selection.select_penalty(tied, ["fold_id"], "f", "y", grid).collect()} == {5.0}
    with pytest.raises(ValueError, match="no validation rows"):
        selection.select_penalty(df.where("NOT (fold_id = 1 AND split = 'val')"), ["fold_id"], "x", "y", grid)


@pytest.mark.parametrize("n_classes", [None, 3])
def test_five_arms_equal_five_separate_fits(spark, n_classes):
    df, data = rows_of(spark, 600, 2)
    mixed = selection.shuffled_states(df, ["fold_id", "split"], ["id"], F.xxhash64("id"))
    dealt = {r["id"]: r["h_shuffled"] for r in mixed.select("id", "h_shuffled").collect()}
    for fold in range(3):
        for split in ("train", "val", "test"):
            own = [d for d in data if d[1] == fold and d[2] == split]
            assert sorted(dealt[d[0]] for d in own) == sorted(d[4] for d in own)
    assert sum(dealt[d[0]] != d[4] for d in data) > 500
    arms = {"X": lambda d: d[3], "H": lambda d: d[4], "X+H": lambda d: d[3] + d[4], "X+shuffled H": lambda d: d[3] + dealt[d[0]], "zero H": lambda d: d[3] + [0.0] * 4}
    for r in selection.readout_arms(mixed, ["fold_id"], "x", "h", "label" if n_classes else "y", 0.5, n_classes).collect():
        part = lambda s: [d for d in data if d[1] == r["fold_id"] and d[2] == s]  # noqa: E731, B023
        t, v = part("train"), part("val")
        f = lambda rows: np.array([arms[r["arm"]](d) for d in rows])  # noqa: E731, B023
        y = np.eye(3)[[d[6] for d in t]] if n_classes else np.array([d[5] for d in t])
        out = np.column_stack([f(v), np.ones(len(v))]) @ weights(f(t), y, 0.5)
        if n_classes:
            said, truth = out.argmax(1), np.array([d[6] for d in v])
            want = np.mean([2 * ((said == c) & (truth == c)).sum() / max(1, (said == c).sum() + (truth == c).sum()) for c in range(3)])
        else:
            want = -np.abs(out - [d[5] for d in v]).mean()
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["n"] == len(v)


def _states(spark, data, radius, size):
    """split, fold_id, label and the state of each standardised window, by numpy."""
    from lattica.operators import windows
    from lattica.plans import sensor

    f, d = sensor.frame(spark, data), sensor.folds(spark, data)
    w = windows.sliding_windows(f, sensor.FEATURES, sensor.LENGTH, 4, order=sensor.ORDER).join(d, "specimen_id")
    w = windows.scaled_windows(w, windows.fold_scalers(f, d, sensor.FEATURES), sensor.FEATURES, ["fold_id"]).select("fold_id", "split", "label", "x").toPandas()
    r = reservoir.random_reservoir(3, 1, reservoir_size=size, **radius)
    return w, np.column_stack([r.states(np.array([np.vstack(x) for x in w.x])), np.ones(len(w))])


def _readout(h, label, train, penalty, n_classes=4):
    return np.linalg.solve(h[train].T @ h[train] + penalty * np.eye(h.shape[1]), h[train].T @ np.eye(n_classes)[label[train]])


def test_the_readout_query_equals_numpy(spark, data):
    from lattica.plans import learning

    w, h = _states(spark, data, {}, 50)
    one, label = (w.fold_id == 0).to_numpy(), w.label.to_numpy()
    weights = _readout(h, label, one & (w.split == "train").to_numpy(), 1e-3)
    test = one & (w.split == "test").to_numpy()
    hit = (h[test] @ weights).argmax(1) == label[test]
    got = {r.label: (r.n, r.recall) for r in learning.ridge_readout(spark, data).collect()}
    assert got.keys() == set(label[test].tolist())
    for k, (n, recall) in got.items():
        assert n == (label[test] == k).sum() and recall == pytest.approx(hit[label[test] == k].mean())


def test_the_selection_query_equals_numpy(spark, data):
    from lattica.plans import tuning

    best = {}
    for radius in (0.5, 0.9, 1.1):
        w, h = _states(spark, data, {"spectral_radius": radius, "washout": 0}, 40)
        label = w.label.to_numpy()
        for penalty in (0.001, 0.1, 10.0):
            for fold in range(5):
                part = lambda s, fold=fold: ((w.fold_id == fold) & (w.split == s)).to_numpy()  # noqa: E731, B023
                said, truth = (h[part("val")] @ _readout(h, label, part("train"), penalty)).argmax(1), label[part("val")]
                f1 = np.mean([2 * ((said == c) & (truth == c)).sum() / max(1, (said == c).sum() + (truth == c).sum()) for c in range(4)])
                if fold not in best or f1 > best[fold][0] + 1e-9:
                    best[fold] = f1, radius, penalty
    for r in tuning.reservoir_selection(spark, data).collect():
        assert (r.spectral_scaling, r.ridge_lambda) == best[r.fold_id][1:] and r.score == pytest.approx(best[r.fold_id][0], abs=1e-6)
