"""Leakage-safe splits of specimens into folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw
from .ordering import with_position


def permuted(specimens: DataFrame, seed: int, salt: str = "perm") -> DataFrame:
    """specimen_id, pos (0-based) in a seeded order by hash, and n.

    Positions come from counts of 65,536 hash ranges and ranks inside them, so a task that sorts a range has a 65,536th of
    the specimens; only the counts of ranges are broadcast."""
    ids = specimens.select("specimen_id").distinct()
    keyed = ids.withColumn("h", draw(salt, seed, F.col("specimen_id"))).withColumn("range", F.shiftright("h", 16))
    counts = keyed.groupBy("range").agg(F.count("*").alias("c"))
    before = counts.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", "specimen_id")) - 1
    return keyed.withColumn("rank", rank).join(F.broadcast(before), "range").select("specimen_id", (F.col("before") + F.col("rank")).alias("pos"), "n")


def _block(pos: Column, n: Column, k: Column | int) -> Column:
    """Block of a position where the first n % k of k blocks have one more."""
    k = F.lit(k) if isinstance(k, int) else k
    small, extra = F.floor(n / k), n % k
    head = extra * (small + 1)
    return F.when(pos < head, F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - head) / F.greatest(small, F.lit(1)))).cast("int")


def _folds(placed: DataFrame, k: int) -> DataFrame:
    """Every fold's split of each specimen: test is the fold's own block, validation the next, training the rest."""
    every = placed.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("block") == F.col("fold_id"), "test").when(F.col("block") == (F.col("fold_id") + 1) % k, "val").otherwise("train")
    return every.select("fold_id", "specimen_id", split.alias("split"))


def group_kfold(specimens: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    if k < 3:
        raise ValueError("at least three folds: training, validation and test differ")
    placed = permuted(specimens, seed)
    return _folds(placed.withColumn("block", _block(F.col("pos"), F.col("n"), k)), k)


def loso(specimens: DataFrame, seed: int = 0, folds: int | None = None) -> DataFrame:
    """Leave one specimen out: a fold for each; validation is the next in the permutation.  folds: the first so many."""
    placed = permuted(specimens, seed)
    n = placed.agg(F.max("n")).first()[0] or 0
    if n < 3:
        raise ValueError("at least three specimens")
    k = min(folds or n, n)
    every = placed.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("pos") == F.col("fold_id"), "test").when(F.col("pos") == (F.col("fold_id") + 1) % F.col("n"), "val").otherwise("train")
    return every.select("fold_id", "specimen_id", split.alias("split"))


def time_block_holdout(specimens: DataFrame, k: int = 5) -> DataFrame:
    """As k folds, in the order of the ids instead of a permutation; k is n - 2 at most."""
    ids = specimens.select("specimen_id").distinct()
    n = ids.count()
    if n < 5:
        raise ValueError("at least five blocks")
    k = min(k, n - 2)
    placed = with_position(ids, ["specimen_id"])
    return _folds(placed.withColumn("block", _block(F.col("pos"), F.lit(n), k)), k)


def train_fraction(specimens: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The first ceil(fraction * n) specimens of a permutation: smaller fractions are nested in larger ones."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    p = permuted(specimens, seed, "pool")
    return p.where(F.col("pos") < F.ceil(F.lit(fraction) * F.col("n"))).select("specimen_id")


def fold_train_pool(folds: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The same for each fold's training side: places by ranges of hashes inside each fold, so no task sorts a fold."""
    train = folds.where("split = 'train'").withColumn("h", draw("pool", seed, F.col("specimen_id"))).withColumn("range", F.shiftright("h", 22))
    counts = train.groupBy("fold_id", "range").agg(F.count("*").alias("c"))
    along = Window.partitionBy("fold_id")
    before = counts.select("fold_id", "range", (F.sum("c").over(along.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(along).alias("n"))
    rank = F.row_number().over(Window.partitionBy("fold_id", "range").orderBy("h", "specimen_id")) - 1
    placed = train.withColumn("rank", rank).join(before, ["fold_id", "range"])
    return placed.where(F.col("before") + F.col("rank") < F.ceil(F.lit(fraction) * F.col("n"))).select("fold_id", "specimen_id")


def fingerprints(folds: DataFrame, strategy: str, seed: int) -> DataFrame:
    """A short hash of each fold's specimens by split."""
    parts = [F.to_json(F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("specimen_id"))))) for s in ("train", "val", "test")]
    text = F.concat_ws("|", F.lit(strategy), F.lit(str(seed)), *parts)
    return folds.groupBy("fold_id").agg(F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(12)).alias("fingerprint"))


STRATEGIES = {"group_kfold": group_kfold, "loso": loso, "time_block_holdout": lambda specimens, k=5, seed=0: time_block_holdout(specimens, k)}


def make_folds(strategy: str, specimens: DataFrame, **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](specimens, **options)


def nested_sizes(n: int, fractions: list[float]) -> list[int]:
    return [math.ceil(f * n) for f in fractions]
