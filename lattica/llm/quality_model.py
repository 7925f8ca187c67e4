"""Quality classifier (operator 10): a regularised quadratic discriminant.

Each class has a mean and a covariance over transformed statistics of a whole text; each covariance
is shrunk towards the pooled one and its diagonal, and its Cholesky factor is cached in the model.
A score is the logistic of the difference of the two log densities (Mahalanobis distances and
log determinants) plus the log prior odds.

Defined results: a null or empty text is scored like any other (all statistics zero).  Repeated rows
score alike.  A null id is scored and counts as not held out.  Without labelled rows of both classes
the score is the share of label 1 among them (0.5 without any).  No other input column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, labelled_sample, slices
from .textstats import counts_of, rates

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 10_000
#: Weight of the pooled covariance in each class's, and of its diagonal in the result.
POOLED, DIAGONAL = 0.5, 0.05
FOLDS = 5
CUT = 0.3


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(counts: np.ndarray) -> np.ndarray:
    """Rates, and the logarithm of the word count with a mark for empty texts."""
    n = counts[:, :1].astype(np.float64)
    return np.hstack([rates(counts), np.log1p(n), (n == 0).astype(np.float64)])


@dataclass
class Discriminant:
    mean: np.ndarray  # (class, feature)
    factor: np.ndarray  # inverse Cholesky factors (class, feature, feature)
    log_det: np.ndarray
    log_prior: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
        if len(np.unique(y)) < 2:
            return None
        parts = [x[y == k] for k in (0, 1)]
        n = np.array([len(p) for p in parts], np.float64)
        cov = [np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((x.shape[1],) * 2) for p in parts]
        both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        both += np.diag(1e-4 + 0 * np.diag(both))
        factor, log_det = [], []
        for c in cov:
            s = (1 - pooled) * c + pooled * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s))
            low = np.linalg.cholesky(s)
            factor.append(np.linalg.inv(low))
            log_det.append(2 * np.log(np.diag(low)).sum())
        return cls(np.array([p.mean(0) for p in parts]), np.array(factor), np.array(log_det), np.log(n / n.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            density.append(-0.5 * ((z * z).sum(1) + self.log_det[k]) + self.log_prior[k])
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Discriminant | float:
    """A model from labelled rows that aren't held out; a constant score if they are all of one class."""
    rows = labelled_sample(docs, labels, ["quality"], sample_rows, ~held_out("doc_id"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = counts_of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.tolist(), pa.list_(pa.int64())), b.column(2)], ["doc_id", "counts", "quality"])

    got = rows.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id bigint, counts array<bigint>, quality int").toPandas().sort_values("doc_id")
    if not len(got):
        return 0.5
    y = (got.quality.to_numpy() > 0).astype(int)
    return Discriminant.fit(features(np.vstack(got.counts.to_numpy())), y) or float(y.mean())


def classify(docs: DataFrame, model: Discriminant | float, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = counts_of(b.column(1).to_pylist())
            s = np.full(len(c), model) if isinstance(model, float) else model.score(features(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = id_text(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
