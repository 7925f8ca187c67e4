"""Quality rules (operator 4): an isolation forest over rule statistics.

Base rules count words, symbols, repeated lines and repeated eight-word windows of every whole text.
An isolation forest isolates a document by random splits over length-free rates of those statistics;
a short mean path marks an anomaly.  Every tree draws its rows (the method's subsample) from all labelled documents,
and the score above which a document is rejected is calibrated with the quality labels of all of them, on scores of
forests that each row wasn't grown on.

Defined results: a null or empty text has all counts zero and fails the base rules.  Repeated rows
are judged alike.  A null id stays null.  Without labelled rows of both kinds there is no
calibration, and the base rules alone decide.  Input columns other than the id and the text are
passed through by `keep_good` and ignored by `judge`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_running_total
from .common import id_text, materialise, slices
from .textstats import COUNTS, counts_of, rates

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TREES, SUBSAMPLE = 200, 1024
#: Rows dealt to a tree, as a multiple of its subsample: by chance they may be fewer.
DEALT = 1.25
#: Steps without a common divisor with TREES, by which a row goes from tree to tree.
STEPS = (1, 3, 7, 9, 11, 13, 17, 19, 21, 23, 27, 29, 31, 33, 37, 39)
#: Parts of the labelled rows, each scored by trees grown on the others; the threshold is calibrated on these scores.
FOLDS = 3
#: Share of rows labelled bad among those that trees are grown on: more of them hide one another.
BAD_SHARE = 0.01
#: Bad rows up to which exactly that share is taken, by their hashes' order; of more, by the hashes' size.
EXACT_ROWS = 10_000
#: Share of the rows labelled good that calibration may reject.
CLEAN_LOSS = 0.005


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


def _grow_tree(x: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator, feature: np.ndarray, cut: np.ndarray, path: np.ndarray) -> None:
    """Fill a tree's arrays with random splits of the rows."""
    todo = [(0, 0, rows)]
    while todo:
        node, d, rows = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if d == depth or len(rows) < 2 or not len(open_):
            path[node] = d + _mean_path(len(rows))
            continue
        f = rng.choice(open_)
        feature[node], cut[node] = f, rng.uniform(low[f], high[f])
        left = x[rows, f] < cut[node]
        todo += [(2 * node + 1, d + 1, rows[left]), (2 * node + 2, d + 1, rows[~left])]


@dataclass
class IsolationForest:
    """Trees as arrays (tree, node): children of node i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = np.inf

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1, np.int16)
        cut, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            _grow_tree(x, rng.choice(len(x), size, replace=False), depth, rng, feature[t], cut[t], path[t])
        return cls(feature, cut, path, float(_mean_path(size)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: 2 ** -(mean path / expected path)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, 2 * node + 1 + (x[rows, f] >= cut[node]), node)
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.norm)

    def calibrate(self, score: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> None:
        """The threshold that rejects most bad rows beyond good ones, among those rejecting at most
        `clean_loss` of the good."""
        order = np.argsort(-score, kind="stable")
        s, g = score[order], good[order]
        bad_part = np.cumsum(~g) / max(1, (~g).sum())
        good_part = np.cumsum(g) / max(1, g.sum())
        last = np.append(s[1:] != s[:-1], True)  # a threshold can't part equal scores
        gain = np.where(last & (good_part <= clean_loss), bad_part - good_part, -np.inf)
        best = int(gain.argmax())
        if gain[best] > 0:
            below = s[best + 1] if best + 1 < len(s) else s[best] - 1e-6
            self.threshold = float((s[best] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> IsolationForest | None:
    """Grow and calibrate a forest on all labelled rows; None if they are all of one kind.

    The threshold comes from scores of rows by forests that weren't grown on them; rows of equal counts, such as copies, are
    in one part.  The driver gets trees, of a fixed size, and a threshold."""
    rows = _labelled(docs, labels)
    kinds = {(r.part, r.good): r.n for r in rows.groupBy("part", "good").agg(F.count("*").alias("n")).collect()}
    if len({good for _, good in kinds}) < 2:
        return None
    forests = _grown(rows, kinds)
    forest = forests.pop(FOLDS)
    threshold = _threshold(_scored(rows, forests))
    if threshold is not None:
        forest.threshold = threshold
    return forest


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, x (rates), part, good of every labelled document; of repeated ids one row counts.  Texts aren't shuffled."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = counts_of(b.column(1).to_pylist())
            part = pa.array([zlib.crc32(row.tobytes()) % FOLDS for row in c], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rates(c)), pa.list_(pa.float64())), part], ["doc_id", "x", "part"])

    measured = id_text(docs).where("doc_id IS NOT NULL").mapInArrow(measure, "doc_id bigint, x array<double>, part int")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    one = measured.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "part", "good")).alias("one"))
    return materialise(one.select("doc_id", "one.*"), "quality-rates")


def _grown(rows: DataFrame, kinds: dict[tuple[int, bool], int]) -> dict[int, IsolationForest]:
    """A forest of the rows outside each part, and as FOLDS one of all rows: good rows and a few bad ones.

    Each row is dealt to as many trees, by hashes of its id, as give every tree a little more than its subsample; a tree
    takes those with the least hashes and is grown in a task."""
    dealt = None
    for f in range(FOLDS + 1):
        good, bad = (sum(n for (part, g), n in kinds.items() if part != f and g == kind) for kind in (True, False))
        if not good:
            continue
        few = min(bad, max(2, int(BAD_SHARE / (1 - BAD_SHARE) * good)))
        rate = min(float(TREES), DEALT * TREES * SUBSAMPLE / (good + few))
        u = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(f), F.lit(salt)), F.lit(1 << 32))  # noqa: B023, E731
        last = (few << 32) // max(1, bad)
        if few <= EXACT_ROWS:  # few hashes may lie unevenly
            last = rows.where((F.col("part") != f) & ~F.col("good")).select(u("bad").alias("u")).orderBy("u").limit(few).agg(F.max("u")).first()[0] or 0
        pool = rows.where((F.col("part") != f) & (F.col("good") | (u("bad") <= last)))
        pool = pool.withColumn("times", F.floor(rate + u("times") / (1 << 32)).cast("int")).where("times > 0")
        step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.shiftright(u("step"), 8) % len(STEPS) + 1).cast("int"))
        trees = F.transform(F.sequence(F.lit(0), F.least("times", F.lit(TREES)) - 1), lambda j: ((u("tree") + j * step) % TREES).cast("int"))
        one = pool.select(F.lit(f).alias("forest"), F.explode(trees).alias("tree"), "doc_id", "x")
        dealt = one if dealt is None else dealt.unionByName(one)

    depth = max(1, int(np.ceil(np.log2(SUBSAMPLE))))
    nodes = 2 ** (depth + 1) - 1

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        f, t = int(part.forest.iloc[0]), int(part.tree.iloc[0])
        part = part.sort_values(["_h", "doc_id"]).head(SUBSAMPLE)
        feature, cut, path = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
        own = max(1, int(np.ceil(np.log2(max(len(part), 2)))))
        _grow_tree(np.vstack(part.x.to_numpy()), np.arange(len(part)), own, np.random.default_rng([11, f, t]), feature, cut, path)
        return pd.DataFrame({"forest": [f], "tree": [t], "size": [len(part)], "feature": [feature.tobytes()], "cut": [cut.tobytes()], "path": [path.tobytes()]})

    hashed = dealt.withColumn("_h", F.xxhash64("doc_id", "tree", "forest"))
    grown: dict[int, list] = {}
    for r in hashed.groupBy("forest", "tree").applyInPandas(grow, "forest int, tree int, size int, feature binary, cut binary, path binary").collect():
        grown.setdefault(r.forest, []).append(r)
    out = {}
    for f, trees in grown.items():
        trees.sort(key=lambda r: r.tree)
        feature, cut, path = (np.stack([np.frombuffer(r[c], kind) for r in trees]) for c, kind in (("feature", np.int16), ("cut", np.float64), ("path", np.float64)))
        out[f] = IsolationForest(feature, cut, path, float(np.mean([_mean_path(r["size"]) for r in trees])) or 1.0)
    return out


def _scored(rows: DataFrame, forests: dict[int, IsolationForest]) -> DataFrame:
    """score, good of the rows of each part that has a forest."""
    sent = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(1).to_numpy()
            for f, forest in sent.value.items():
                own = b.filter(pa.array(part == f))
                if own.num_rows:
                    x = own.column(0).flatten().to_numpy().reshape(own.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), own.column(2)], ["score", "good"])

    return rows.select("x", "part", "good").mapInArrow(run, "score double, good boolean")


def _threshold(scored: DataFrame, clean_loss: float = CLEAN_LOSS) -> float | None:
    """What `IsolationForest.calibrate` finds, from running totals of the distinct scores; None where no threshold gains."""
    ties = materialise(scored.groupBy((-F.col("score")).alias("at")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "quality-scores")
    total = ties.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    placed = with_running_total(with_running_total(ties, ["at"], "good", "good_before"), ["at"], "bad", "bad_before")
    good_part = (F.col("good_before") + F.col("good")) / F.lit(max(1, total.good or 0))
    gain = (F.col("bad_before") + F.col("bad")) / F.lit(max(1, total.bad or 0)) - good_part
    best = placed.where(good_part <= clean_loss).select("at", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "at").first()
    if best is None:
        return None
    below = ties.where(F.col("at") > best["at"]).agg(F.min("at")).first()[0]
    return -best["at"] - 1e-6 if below is None else -(best["at"] + below) / 2


def base_fails(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])


def _verdicts(texts, forest: IsolationForest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = counts_of(texts)
    failed = base_fails(c)
    score = forest.score(rates(c)) if forest and len(c) else np.zeros(len(c))
    kept = ~failed if forest is None else ~failed & (score < forest.threshold)
    return c, failed, score, kept


def judge(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly (the forest's score) and kept, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c, failed, score, kept = _verdicts(b.column(1).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c[:, i]) for i in range(5)], pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{x} bigint" for x in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, forest: IsolationForest | None, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(_verdicts(b.column(at).to_pylist(), forest)[3]))

    return docs.mapInArrow(run, docs.schema)
