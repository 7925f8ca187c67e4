"""Leakage audits.  Each returns the violations it finds; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_audit(folds: DataFrame, specimens: DataFrame) -> DataFrame:
    """fold_id, specimen_id, problem: specimens in several splits of a fold, missing from it or unknown.

    Folds are compared with all specimens only where their numbers of known ones differ, so whole folds cost a count."""
    known = specimens.select("specimen_id").distinct()
    several = folds.groupBy("fold_id", "specimen_id").agg(F.count("*").alias("n")).where("n > 1").select("fold_id", "specimen_id", F.lit("overlap").alias("problem"))
    held = folds.select("fold_id", "specimen_id").distinct().join(known, "specimen_id", "left_semi").groupBy("fold_id").agg(F.count("*").alias("n"))
    total = known.agg(F.count("*").alias("total"))
    short = folds.select("fold_id").distinct().join(held, "fold_id", "left").crossJoin(F.broadcast(total)).where(F.coalesce("n", F.lit(0)) != F.col("total"))
    every = short.select("fold_id").crossJoin(known)
    missing = every.join(folds, ["fold_id", "specimen_id"], "left_anti").withColumn("problem", F.lit("missing"))
    unknown = folds.join(known, "specimen_id", "left_anti").select("fold_id", "specimen_id", F.lit("unexpected").alias("problem"))
    return several.unionByName(missing).unionByName(unknown)


def scaler_audit(train: DataFrame, everything: DataFrame, features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """channel, same_as_train, distinguishable: whether statistics agree with the training rows', and whether a scaler
    fitted on all rows could be told from them at all."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in features]))
        return df.select(rows.alias("r")).groupBy("r.channel").agg(F.avg("r.v").alias(f"{tag}_mean"), F.stddev_pop("r.v").alias(f"{tag}_std"))

    both = stats(train, "train").join(stats(everything, "all"), "channel")
    gap = F.greatest(F.abs(F.col("train_mean") - F.col("all_mean")), F.abs(F.col("train_std") - F.col("all_std")))
    return both.select("channel", (gap > tolerance).alias("distinguishable"), gap.alias("gap"))


def window_owner_audit(windows: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Windows whose rows belong to other specimens or sessions than the window's own."""
    each = windows.select("specimen_id", "session_id", "window_no", F.explode("row_ids").alias(row_id))
    owner = rows.select(row_id, F.col("specimen_id").alias("row_specimen"), F.col("session_id").alias("row_session"))
    joined = each.join(owner, row_id)
    return joined.where("specimen_id <> row_specimen OR session_id <> row_session").select("specimen_id", "session_id", "window_no").distinct()


def split_membership_audit(windows: DataFrame, folds: DataFrame) -> DataFrame:
    """Windows filed under a split that their specimen isn't in."""
    return windows.join(folds, ["fold_id", "specimen_id", "split"], "left_anti")


def row_reuse(windows: DataFrame, row_id: str = "row_ids") -> DataFrame:
    """Rows that occur in windows of more than one split of a fold."""
    each = windows.select("fold_id", "split", F.explode(row_id).alias("row_id"))
    return each.groupBy("fold_id", "row_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def class_coverage(frame: DataFrame, folds: DataFrame, n_classes: int) -> DataFrame:
    """Classes that a fold's split has no row of."""
    seen = frame.join(folds, "specimen_id").groupBy("fold_id", "split").agg(F.collect_set("freshness_class").alias("seen"))
    absent = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(n_classes - 1)), "seen"))
    return seen.select("fold_id", "split", F.size(absent).alias("n_absent"), F.array_join(absent, ",").alias("absent"))


def leakage_report(frame: DataFrame, folds: DataFrame) -> DataFrame:
    return frame.join(folds, "specimen_id").groupBy("fold_id", "split").agg(F.count_distinct("specimen_id").alias("n_specimens"), F.count("*").alias("n_rows"))
