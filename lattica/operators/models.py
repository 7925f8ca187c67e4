"""Models with one interface: fit on window rows, predict as a column; and selection over a grid.

Trees are pyspark.ml.  An RBF machine isn't part of it: `svm_rbf`, and `pca_svm` over principal components, are
least-squares kernel machines over random features, declared as substitutes.  Recurrent and convolutional networks need
a deep-learning library that isn't installed; the registry says so instead of leaving them out."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw
from .reservoir import Reservoir, gram_blocks, random_reservoir, read_out, ridge, window_states

CLASSIFICATION, REGRESSION = "classification", "regression"
#: Random features that stand for the kernel.
KERNEL_FEATURES = 1024


class Model(Protocol):
    """rows have x (window), label and target; predict adds a column `predicted`."""

    def fit(self, rows: DataFrame) -> Model: ...
    def predict(self, rows: DataFrame) -> DataFrame: ...
    def describe(self) -> dict[str, Any]: ...


def flat_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.flatten("x")))


@dataclass
class MlModel:
    """A pyspark.ml estimator over the flattened window."""

    name: str
    task: str
    estimator: Any
    fitted: Any = None

    def fit(self, rows: DataFrame) -> MlModel:
        self.fitted = self.estimator.fit(flat_features(rows).withColumn("y", F.col("label" if self.task == CLASSIFICATION else "target").cast("double")))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.fitted.transform(flat_features(rows))
        extra = [c for c in ("rawPrediction", "probability", "features") if c in out.columns]
        return out.drop(*extra).withColumnRenamed("prediction", "predicted")

    def describe(self) -> dict[str, Any]:
        return {"model": self.name, "task": self.task, "parameters": str(self.estimator)}


@dataclass
class ReservoirModel:
    """A reservoir's pooled states with a ridge readout."""

    name: str
    task: str
    reservoir: Reservoir | None = None
    seed: int = 0
    n_classes: int = 4
    weights: np.ndarray | None = None
    logistic: Any = None
    readout: str = "ridge"

    def _states(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c != "x"]
        return window_states(rows, self.reservoir, keep)

    def fit(self, rows: DataFrame) -> ReservoirModel:
        if self.reservoir is None:
            channels = rows.select(F.size(F.col("x")[0]).alias("c")).first().c
            self.reservoir = random_reservoir(channels, self.seed)
        states = self._states(rows)
        if self.readout == "logistic" and self.task == CLASSIFICATION:
            v = states.select(array_to_vector("state").alias("features"), F.col("label").cast("double").alias("y"))
            self.logistic = LogisticRegression(labelCol="y", maxIter=50).fit(v)
        else:
            self.weights = ridge(states, "state", "label" if self.task == CLASSIFICATION else "target", n_classes=self.n_classes if self.task == CLASSIFICATION else None)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        states = self._states(rows)
        if self.logistic is not None:
            out = self.logistic.transform(states.withColumn("features", array_to_vector("state")))
            return out.drop("features", "rawPrediction", "probability", "state").withColumnRenamed("prediction", "predicted")
        return read_out(states, "state", self.weights).drop("state")

    def describe(self) -> dict[str, Any]:
        return {"model": self.name, "task": self.task, "n_trainable": int(np.size(self.weights)) if self.weights is not None else None}


@dataclass
class KernelMachine:
    """Least squares in a radial-basis kernel, with a constant, on all rows.

    The kernel of all pairs of rows would be a matrix of their number squared.  Random Fourier features (Rahimi and Recht)
    stand for it: cosines and sines at n_features / 2 frequencies, drawn without a look at the rows, whose products
    approach the kernel as 1 / sqrt(n_features).  Every row counts in their Gram matrix, which is summed in the tasks.

    n_components: over the rows' principal components, so many of them, or the fewest that explain that share of the
    variance; None: over the window itself."""

    name: str
    task: str
    penalty: float = 1e-2
    n_classes: int = 4
    n_features: int = KERNEL_FEATURES
    gamma: float | str = "scale"
    n_components: float | int | None = None
    seed: int = 0
    mean: np.ndarray | None = None
    components: np.ndarray | None = None
    frequencies: np.ndarray | None = None
    weights: np.ndarray | None = None
    width: float = 1.0

    def fit(self, rows: DataFrame) -> KernelMachine:
        y = "label" if self.task == CLASSIFICATION else "target"
        flat = rows.select(F.flatten("x").alias("f"), y)
        self.mean, covariance = _moments(flat, y)
        spread, self.components = np.diag(covariance).mean() + self.mean.var(), None
        if self.n_components is not None:
            size, axes = np.linalg.eigh(covariance)
            size, axes = np.maximum(size[::-1], 0), axes[:, ::-1]
            share = np.cumsum(size) / max(size.sum(), 1e-300)
            k = 1 + int(np.searchsorted(share, self.n_components - 1e-12)) if self.n_components < 1 else int(self.n_components)
            k = max(1, min(k, len(size)))
            spread, self.components = size[:k].mean(), axes[:, :k]
        d = len(self.mean) if self.components is None else self.components.shape[1]
        self.width = 1.0 / max(d * spread, 1e-12) if self.gamma == "scale" else float(self.gamma)
        self.frequencies = np.random.default_rng(self.seed).normal(0, np.sqrt(2 * self.width), (d, self.n_features // 2))
        self.weights = ridge(flat, "f", y, self.penalty, self.n_classes if self.task == CLASSIFICATION else None, self._map())
        return self

    def _map(self) -> Callable[[np.ndarray], np.ndarray]:
        mean, components, frequencies = self.mean, self.components, self.frequencies

        def features(x: np.ndarray) -> np.ndarray:
            turned = (x - mean if components is None else (x - mean) @ components) @ frequencies
            return np.hstack([np.cos(turned), np.sin(turned)]) / np.sqrt(frequencies.shape[1])

        return features

    def predict(self, rows: DataFrame) -> DataFrame:
        return read_out(rows.withColumn("_f", F.flatten("x")), "_f", self.weights, mapped=self._map()).drop("_f", "x")

    def describe(self) -> dict[str, Any]:
        return {"model": self.name, "task": self.task, "substitute_for": "support vector machine", "features": self.n_features}


def _moments(rows: DataFrame, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the column f over all rows, from sums about one of them."""
    one = rows.first()
    if one is None:
        raise ValueError("no rows to fit on")
    about = np.array(one["f"])
    blocks = gram_blocks(rows, [], "f", y, mapped=lambda x: x - about).collect()
    sums = np.concatenate([r["cells"] for r in sorted(blocks, key=lambda r: r["block"])]).reshape(len(about) + 1, -1)[:, :-1]
    mean = sums[-1, :-1] / sums[-1, -1]
    return about + mean, sums[:-1, :-1] / sums[-1, -1] - np.outer(mean, mean)


def random_forest(task: str, n_estimators: int = 300, max_depth: int | None = None, min_samples_leaf: int = 1, seed: int = 0) -> Model:
    """max_depth: None is as deep as Spark grows trees, 30."""
    kind = RandomForestClassifier if task == CLASSIFICATION else RandomForestRegressor
    return MlModel("random_forest", task, kind(labelCol="y", numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth, minInstancesPerNode=min_samples_leaf, seed=seed))


def boosted_trees(task: str, n_estimators: int = 300, max_depth: int = 6, learning_rate: float = 0.1, subsample: float = 0.9, seed: int = 0) -> Model:
    kind = GBTClassifier if task == CLASSIFICATION else GBTRegressor
    trees = kind(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample, seed=seed)
    return MlModel("boosted_trees", task, OneVsRest(classifier=trees, labelCol="y") if task == CLASSIFICATION else trees.setLabelCol("y"))


_DEEP = "needs a deep-learning library that isn't installed"
REGISTRY: dict[str, Callable[..., Model]] = {
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
    "pca_svm": lambda task, **kw: KernelMachine("pca_svm", task, **{"n_components": 0.95, **kw}),
    "svm_rbf": lambda task, **kw: KernelMachine("svm_rbf", task, **kw),
    "esn": lambda task, **kw: ReservoirModel("esn", task, **kw),
}
UNAVAILABLE = dict.fromkeys(("gru", "lstm", "cnn1d", "tcn"), _DEEP)


def availability() -> dict[str, str]:
    """model -> `available` or the reason why not."""
    return {**dict.fromkeys(REGISTRY, "available"), **UNAVAILABLE}


def build_model(name: str, task: str = CLASSIFICATION, **options: Any) -> Model:
    """A model with its options; one that it doesn't have is an error."""
    if name in UNAVAILABLE:
        raise NotImplementedError(f"{name}: {UNAVAILABLE[name]}")
    return REGISTRY[name](task, **options)


def grid(options: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """Every combination, in the order of the options."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


def grid_frame(spark: SparkSession, options: dict[str, Sequence[Any]]) -> DataFrame:
    """The same as a table: a cross join of the options' values, of which there are few."""
    out = spark.range(1).select()
    for name, values in options.items():
        out = out.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], [name])))
    return out


def first_best(scores: DataFrame, by: Sequence[str], score: str, order: str, higher_is_better: bool = True, all_groups: bool = False) -> DataFrame:
    """The best score of each group; NaN and null never win, and the first in order (nulls last) wins ties.

    A group without a score has no row; with all_groups it has its first NaN, or else its first null."""
    bad = F.col(score).isNull() | F.isnan(score)
    direction = F.desc_nulls_last(score) if higher_is_better else F.asc_nulls_last(score)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(bad, direction, F.asc_nulls_last(order)))
    won = F.col("_rank") == 1
    return scores.withColumn("_rank", rank).where(won if all_groups else won & ~bad).drop("_rank")


def select_hyperparameters(build: Callable[..., Model], options: dict[str, Sequence[Any]], train: DataFrame, validation: DataFrame, task: str = CLASSIFICATION) -> tuple[dict[str, Any], list[float]]:
    """The grid point with the best validation score (accuracy, or negative mean absolute error); the first wins ties."""
    points, scores = grid(options), []
    for p in points:
        done = build(task, **p).fit(train).predict(validation)
        if task == CLASSIFICATION:
            value = done.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
        else:
            value = done.agg(-F.avg(F.abs(F.col("predicted") - F.col("target")))).first()[0]
        scores.append(float("nan") if value is None else float(value))
    best = max((i for i, s in enumerate(scores) if s == s), key=lambda i: (scores[i], -i), default=None)
    if best is None:
        raise ValueError("no grid point has a score")
    return points[best], scores


def masked_channels(frame: DataFrame, features: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Robustness: channels set to zero in a seeded share of the rows."""
    return frame.withColumns({c: F.when(draw("drop", seed, c, F.col("event_id")) < F.lit(int(share * 2**32)), 0.0).otherwise(F.col(c)) for c in features})


def drifted(frame: DataFrame, features: Sequence[str], gain: float, offset: float) -> DataFrame:
    return frame.withColumns({c: F.col(c) * gain + offset for c in features})
