"""Toxicity (operator 3): a classifier chain over toxicity categories.

Linear (logistic) models predict the categories one after another.  Each reads marks of the words and
word beginnings that a text contains, and the probabilities of all earlier categories; those that it is
trained with are out-of-fold predictions, so that it doesn't trust them more than it may later.
The last category is the verdict itself.  Its threshold is calibrated on predictions of whole chains, marks and categories
included, that were made without the rows' fold.  Texts of equal words are in one fold, and most near copies: a
fold goes by the least hash of a text's five-word shingles.

A labels table may have a column for each category.  The query's table marks toxic documents only; for
it, the earlier categories are found in the data: the toxic rows are put into KINDS clusters by the marks that
they have in common (spherical k-means), whatever their language, and each cluster is a category.

Defined results: a null or empty text has no marks and gets the models' base rates.  Repeated rows score
alike; a null id is kept as null.  Without labelled rows of both kinds every probability is the share
of toxic rows (0 without any) and nothing is rejected.  Other columns are passed through by `keep_clean`
and ignored by `classify`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, labelled_sample, materialise, slices

#: Categories before the verdict where the labels have none of their own: clusters of the toxic rows.
KINDS = 3
VERDICT = "toxic"
#: Labelled rows that the chain is fitted on, at most; marks that it reads, at most.
SAMPLE_ROWS = 15_000
MARKS = 400
MIN_Z = 4.0  # of a mark's share among toxic rows against the others
FOLDS = 3
#: Share of the rows labelled clean that calibration may reject.
CLEAN_LOSS = 0.001

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


def marks_of(text: str) -> set[str]:
    """Distinct words in lower case, and their first letters, with the number of letters before them."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({f"{k}:{w[:k]}" for w in words if len(w) > k} for k in PREFIXES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model (the last is the intercept), by accelerated gradient descent."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(a.shape[1], x.dtype)
    for _ in range(12):  # largest eigenvalue of a'a / n, for the step
        v = a.T @ (a @ v) / len(a)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * max(float(np.linalg.norm(a @ v) ** 2 / len(a)), 1e-6) * 1.05 + l2)
    w, last, t = np.zeros(a.shape[1], x.dtype), np.zeros(a.shape[1], x.dtype), 1.0
    base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w[-1] = last[-1] = np.log(base / (1 - base))
    for _ in range(steps):
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (was - 1) / t * (w - last)
        grad = a.T @ (_sigmoid(a @ ahead) - y).astype(x.dtype) / len(a) + l2 * ahead
        last, w = w, (ahead - step * grad).astype(x.dtype)
    return w


@dataclass
class Chain:
    categories: list[str]
    marks: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = np.inf
    base: float = 0.0

    def matrix(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), len(self.marks)), np.float32)
        known = self.marks.keys()
        for i, t in enumerate(texts):
            for m in known & marks_of(t):
                x[i, self.marks[m]] = 1
        return x

    def predict(self, texts) -> np.ndarray:
        """Probability of each category, a row a text."""
        if not self.weights:
            return np.full((len(texts), len(self.categories)), self.base)
        x = self.matrix(texts)
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            p = _sigmoid(np.hstack([x, out]) @ w[:-1] + w[-1])
            out = np.hstack([out, p[:, None].astype(np.float32)])
        return out.astype(np.float64)


def choose_marks(rows: DataFrame, most: int = MARKS, min_z: float = MIN_Z) -> list[str]:
    """Marks whose share among the rows of `verdict` 1 exceeds that among the others most significantly.
    They are counted on the executors; only those chosen come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = [Counter(), Counter()]
            for text, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[k].update(marks_of(text))
            found = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array([c[m] for m in found], pa.int64()) for c in counts]], ["mark", "c0", "c1"])

    n = {r.verdict: r.n for r in rows.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    counts = rows.select("text", "verdict").mapInArrow(count, "mark string, c0 bigint, c1 bigint")
    counts = counts.groupBy("mark").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c1 > 0")
    p = (F.col("c0") + F.col("c1") + 1) / (n0 + n1 + 2)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    return [r.mark for r in counts.withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.desc("z"), "mark").limit(most).collect()]


def kinds(x: np.ndarray, k: int = KINDS, rounds: int = 25) -> np.ndarray:
    """A cluster from 0 for each row of marks, the largest first.  The first centre is the row that is nearest to the mean,
    each further one the row least like those before; rows without marks go with the first."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    if not len(unit):
        return np.zeros(0, int)
    centres = unit[[int((unit @ unit.mean(0)).argmax())]]
    marked = np.flatnonzero(x.any(1))
    while len(centres) < k and len(marked):
        likeness = (unit[marked] @ centres.T).max(1)
        if likeness.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, unit[marked[int(likeness.argmin())]]])
    for _ in range(rounds):
        group = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[group == c].sum(0) for c in range(len(centres))])
        moved = np.where(sums.any(1)[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    order = np.argsort(-np.bincount(group, minlength=len(centres)), kind="stable")
    return np.argsort(order)[group]


def train(x: np.ndarray, labels: np.ndarray, categories: list[str], marks: list[str], fold: np.ndarray | None = None) -> Chain:
    """x: a 0/1 column for each mark; labels: one for each category, the verdict last; fold: of each row."""
    chain = Chain(categories, {m: i for i, m in enumerate(marks)}, base=float(labels[:, -1].mean()) if len(labels) else 0.0)
    if not len(labels) or len(np.unique(labels[:, -1])) < 2:
        return chain
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    apart = np.zeros((len(x), 0), np.float32)
    for k in range(len(categories)):
        both, y = np.hstack([x, apart]), labels[:, k].astype(np.float32)
        chain.weights.append(fit_linear(both, y))
        p = np.zeros(len(x), np.float32)
        for f in np.unique(fold):
            rest = fold != f if (fold != f).any() else fold == f
            w = fit_linear(both[rest], y[rest])
            p[fold == f] = _sigmoid(both[fold == f] @ w[:-1] + w[-1])
        apart = np.hstack([apart, p[:, None]])
    calibrate(chain, apart[:, -1].astype(np.float64), labels[:, -1] == 0)
    return chain


def calibrate(chain: Chain, score: np.ndarray, clean: np.ndarray) -> None:
    """The threshold that rejects most toxic rows beyond clean ones, among those rejecting at most CLEAN_LOSS of the clean."""
    chain.threshold = np.inf
    if clean.all() or not clean.any():
        return
    order = np.argsort(-score, kind="stable")
    s, c = score[order], clean[order]
    toxic_part, clean_part = np.cumsum(~c) / (~c).sum(), np.cumsum(c) / c.sum()
    gain = np.where(np.append(s[1:] != s[:-1], True) & (clean_part <= CLEAN_LOSS), toxic_part - clean_part, -np.inf)
    best = int(gain.argmax())
    if gain[best] > 0:
        below = s[best + 1] if best + 1 < len(s) else s[best] - 1e-6
        chain.threshold = float((s[best] + below) / 2)


def fold_of(text: str) -> int:
    """By the least of the hashes of a text's five-word shingles (of all its words, if they are fewer)."""
    words = _WORD.findall((text or "").lower())
    k = min(5, len(words))
    return min((zlib.crc32(" ".join(words[i : i + k]).encode("utf-8", "surrogatepass")) for i in range(len(words) - k + 1)), default=0) % FOLDS if k else 0


def fit(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain from at most `sample_rows` labelled rows.  columns: category -> 0/1 column of labels, the verdict
    last; without it, kinds of toxic rows before labels.toxic.  Of each row, only its marks come to the driver."""
    cols = list(columns.values()) if columns else [VERDICT]
    schema = "text string, doc_id bigint, fold int, verdict int, " + ", ".join(f"`{c}` int" for c in cols if c != "verdict")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.set_column(2, "fold", pa.array([fold_of(t.as_py()) for t in b.column(0)], pa.int32()))

    verdict = (F.col(cols[-1]) > 0).cast("int")
    rows = labelled_sample(docs, labels, cols, sample_rows).select("text", "doc_id", F.lit(0).alias("fold"), verdict.alias("verdict"), *[c for c in cols if c != "verdict"])
    rows = materialise(rows.mapInArrow(folded, schema), "toxic-sample")
    score, clean = [], []
    for f in range(FOLDS):
        got = _scored(rows.where(F.col("fold") == f), _chain(rows.where(F.col("fold") != f), columns))
        score.append(got.p.to_numpy())
        clean.append(got.verdict.to_numpy() == 0)
    chain = _chain(rows, columns)
    if chain.weights:
        calibrate(chain, np.concatenate(score), np.concatenate(clean))
    return chain


def _scored(rows: DataFrame, chain: Chain) -> pd.DataFrame:
    """verdict (the label) and p (the chain's) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(chain.predict(b.column(0).to_pylist())[:, -1])], ["verdict", "p"])

    return rows.select("text", "verdict").mapInArrow(run, "verdict int, p double").toPandas()


def _chain(rows: DataFrame, columns: dict[str, str] | None) -> Chain:
    """A chain of the sample's rows.  Of each, only its marks come to the driver."""
    names = list(columns or [*(f"kind_{i + 1}" for i in range(KINDS)), VERDICT])
    cols = list(columns.values()) if columns else [VERDICT]
    marks = choose_marks(rows)
    at = {m: i for i, m in enumerate(marks)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(at[k] for k in at.keys() & marks_of(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32())), *[b.column(3 + i) for i in range(len(cols))]], ["doc_id", "fold", "found", *cols])

    schema = "doc_id bigint, fold int, found array<int>, " + ", ".join(f"`{c}` int" for c in cols)
    got = rows.select("doc_id", "fold", "text", *cols).mapInArrow(reduce, schema).toPandas().sort_values("doc_id")
    x = np.zeros((len(got), len(marks)), np.float32)
    for i, f in enumerate(got.found):
        x[i, f] = 1
    y = (got[cols].to_numpy() > 0).astype(int) if len(got) else np.zeros((0, len(cols)), int)
    if not columns:
        toxic = y[:, 0] == 1
        kind = np.zeros((len(y), KINDS), int)
        kind[np.flatnonzero(toxic), kinds(x[toxic])] = 1
        y = np.hstack([kind, y])
    return train(x, y, names, marks, got.fold.to_numpy())


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the verdict) and kept (its opposite), a row for each row."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = chain.predict(b.column(1).to_pylist())
            bad = p[:, -1] >= chain.threshold
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(bad), pa.array(~bad)], ["doc_id", *names, "toxic", "kept"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean, kept boolean")


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows below the verdict's threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(chain.predict(b.column(at).to_pylist())[:, -1] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)
