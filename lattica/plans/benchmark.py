"""The benchmark: a grid of window lengths, seeds, folds, models and tasks, each cell a run record."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, records, reservoir, splits, windows
from ..storage import materialise


def fold_windows(frame: DataFrame, folds: DataFrame, fold: int, features: Sequence[str], length: int, stride: int, order: Sequence[str]) -> DataFrame:
    """One fold's windows by split, standardised by its training rows only."""
    one = folds.where(F.col("fold_id") == fold)
    w = windows.sliding_windows(frame, features, length, stride, order=order).join(one, "specimen_id")
    return windows.scaled_windows(w, windows.fold_scalers(frame, one, features), features, ["fold_id"])


class FitError(RuntimeError):
    """A model that could not be fitted to its data, or predict with them."""


#: What a fit raises for its data or for Spark's sake; other errors are mistakes in the program and end a run.
FIT_ERRORS = (ArithmeticError, ValueError, np.linalg.LinAlgError, PySparkException, Py4JError)


def evaluate(model: models.Model, w: DataFrame, n_classes: int) -> dict[str, float | None]:
    try:
        done = materialise(model.fit(w.where("split = 'train'")).predict(w.where("split = 'test'")).drop("x"), "predictions")
    except FIT_ERRORS as e:
        raise FitError(f"{type(e).__name__}: {e}") from e
    if model.task == models.CLASSIFICATION:
        row = metrics.classification(done.select(F.col("label").alias("truth"), F.col("predicted").cast("int").alias("predicted")), n_classes).first()
        return {k: row[k] for k in ("macro_f1", "balanced_accuracy", "accuracy")}
    row = metrics.regression(done.select("target", F.col("predicted").alias("estimate"))).first()
    return {k: row[k] for k in ("mae", "rmse", "r2")}


def dealt_windows(frame: DataFrame, folds: DataFrame, features: Sequence[str], length: int, stride: int, order: Sequence[str]) -> DataFrame:
    """All windows with `splits`, their specimen's split in each fold: written once, a fold is then a filter and no join."""
    splits_of = folds.groupBy("specimen_id").agg(F.map_from_entries(F.collect_list(F.struct("fold_id", "split"))).alias("splits"))
    return materialise(windows.sliding_windows(frame, features, length, stride, order=order).join(splits_of, "specimen_id"), "grid-windows")


def run(frame: DataFrame, dataset: str, features: Sequence[str], names: Sequence[str], tasks: Sequence[str] = (models.CLASSIFICATION,), lengths: Sequence[int] = (16,), seeds: Sequence[int] = (0,), strategy: str = "group_kfold", max_folds: int = 5, stride: int = 1, order: Sequence[str] = ("time_index",), n_classes: int = 4, experiment: str = "E1", done: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """Run records of all cells.  Cells that `done` has are skipped; a failed fit is a record with its reason and never
    ends the run, and so is a model that isn't available.  Windows are cut and written once for all folds, models and tasks."""
    spark, rows = frame.sparkSession, []
    keys = ["dataset", "model", "task", "seed", "fold_id", "window_length"]
    seen = {tuple(r) for r in done.where("status = 'ok'").select(*keys).distinct().collect()} if done is not None else set()
    for seed in seeds:
        folds = materialise(splits.make_folds(strategy, frame, seed=seed).where(F.col("fold_id") < max_folds), "grid-folds")
        scalers: list[DataFrame] = []
        cut: dict[int, DataFrame] = {}

        def fold_rows(fold: int, length: int, folds=folds, scalers=scalers, cut=cut) -> DataFrame:
            try:
                if not scalers:
                    scalers.append(materialise(windows.fold_scalers(frame, folds, features), "grid-scalers"))
                if length not in cut:
                    cut[length] = dealt_windows(frame, folds, features, length, stride, order)
            except FIT_ERRORS as e:
                raise FitError(f"{type(e).__name__}: {e}") from e
            w = cut[length].withColumns({"fold_id": F.lit(fold), "split": F.col("splits")[fold]}).where("split IS NOT NULL").drop("splits")
            return windows.scaled_windows(w, scalers[0], features, ["fold_id"])

        for fold in sorted(r.fold_id for r in folds.select("fold_id").distinct().collect()):
            for length in lengths:
                for name, task in [(m, t) for m in names for t in tasks if (dataset, m, t, seed, fold, length) not in seen]:
                    began, status, reason, found = time.perf_counter(), "ok", None, {}
                    try:
                        extra = {"n_classes": n_classes} if name in ("svm_rbf", "pca_svm", "esn") else {}
                        model = models.build_model(name, task, **extra, **(options or {}).get(name, {}))
                        found = evaluate(model, fold_rows(fold, length), n_classes)
                    except (FitError, NotImplementedError) as e:  # a failed cell is a result
                        status, reason = "failed", f"{type(e).__name__}: {e}"[:300]
                    rid = f"{dataset}|{name}|{task}|seed{seed:02d}|fold{fold:02d}|w{length}"
                    rows.append((rid, experiment, dataset, name, task, status, reason, seed, fold, length, time.perf_counter() - began, {k: v for k, v in found.items() if v is not None}))
    schema = "run_id string, experiment string, dataset string, model string, task string, status string, failure_reason string, seed int, fold_id int, window_length int, duration_s double, metrics map<string,double>"
    return spark.createDataFrame(rows, schema)


def reservoir_grid(frame: DataFrame, folds: DataFrame, family: dict[str, reservoir.Reservoir], features: Sequence[str], length: int, stride: int, order: Sequence[str], n_classes: int = 4) -> DataFrame:
    """control, fold_id and the metrics of each reservoir in each fold, with readouts of the fold's training windows.

    Windows are cut and written once and scaled by fold; all readouts are fitted together.  States, a long array for
    each window, fold and reservoir, are never written: training and test windows are driven through all reservoirs in
    the pass that uses them."""
    cut = materialise(windows.sliding_windows(frame, features, length, stride, order=order).select("specimen_id", "label", "x"), "grid-windows")
    w = windows.scaled_windows(cut.join(folds, "specimen_id"), windows.fold_scalers(frame, folds, features), features, ["fold_id"])
    states = lambda split: reservoir.window_states_of(w.where(F.col("split") == split), family, ["fold_id", "label"])
    by = ["control", "fold_id"]
    weights = reservoir.ridge_by(states("train"), by, "state", "label", n_classes=n_classes)
    done = reservoir.read_out_by(states("test"), by, "state", weights)
    return metrics.classification(done.select(*by, F.col("label").alias("truth"), F.col("predicted").cast("int").alias("predicted")), n_classes, by)


def summary(done: DataFrame, names: Sequence[str]) -> DataFrame:
    flat = done.select("*", *[F.col("metrics")[m].alias(m) for m in names], F.lit(1).alias("n_windows"), F.lit("").alias("test_specimens"))
    return records.aggregate_runs(flat.where("status = 'ok'"), ["dataset", "model", "task", "window_length"], names)
