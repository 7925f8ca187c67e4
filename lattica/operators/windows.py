"""Standardisation and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import with_position

EPS = 1e-8


def fit_scaler(frame: DataFrame, features: Sequence[str], by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """mean and population std + eps of each channel, a row for each group: one aggregate over the rows."""
    stats = [x for c in features for x in (F.avg(c).alias(f"{c}_mean"), (F.stddev_pop(c) + eps).alias(f"{c}_std"))]
    return frame.groupBy(*by).agg(F.count("*").alias("n_fit_rows"), *stats)


def fold_scalers(frame: DataFrame, folds: DataFrame, features: Sequence[str], eps: float = EPS) -> DataFrame:
    """The same statistics of each fold's training rows, without a copy of the rows for each fold.

    The rows are read once, into moments of each specimen; folds only combine those: a fold's variance is the
    mean of its specimens' variances and squared distances from the fold's mean."""
    parts = [x for c in features for x in (F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_a"), F.var_pop(c).alias(f"{c}_v"))]
    each = frame.groupBy("specimen_id").agg(F.count("*").alias("_rows"), *parts)
    train = folds.where("split = 'train'").select("fold_id", "specimen_id").join(each, "specimen_id")
    means = [(F.sum(F.col(f"{c}_n") * F.col(f"{c}_a")) / F.sum(f"{c}_n")).alias(f"{c}_mean") for c in features]
    centre = train.groupBy("fold_id").agg(F.sum("_rows").alias("n_fit_rows"), *means)
    spread = []
    for c in features:
        n, gap = F.col(f"{c}_n"), F.col(f"{c}_a") - F.col(f"{c}_mean")
        spread.append((F.sqrt(F.sum(n * (F.col(f"{c}_v") + gap * gap)) / F.sum(n)) + eps).alias(f"{c}_std"))
    stds = train.join(F.broadcast(centre), "fold_id").groupBy("fold_id").agg(*spread)
    return centre.join(F.broadcast(stds), "fold_id").select("fold_id", "n_fit_rows", *[f"{c}_{s}" for c in features for s in ("mean", "std")])


def _with_scaler(rows: DataFrame, scaler: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with their scaler's columns.  A scaler has a row for each fold and is broadcast: joined by shuffles, all rows of a
    fold would meet in one task."""
    few = F.broadcast(scaler.drop("n_fit_rows"))
    return rows.join(few, list(by)) if by else rows.crossJoin(few)


def scaled_windows(windows: DataFrame, scaler: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Windows standardised after they were cut: scaling a channel is the same before and after, and so windows are cut
    once for all folds."""
    joined = _with_scaler(windows, scaler, by)
    row = lambda r: F.array(*[(r[i] - F.col(f"{c}_mean")) / F.col(f"{c}_std") for i, c in enumerate(features)])
    return joined.withColumn("x", F.transform("x", row)).drop(*[f"{c}_{s}" for c in features for s in ("mean", "std")])


def standardise(frame: DataFrame, scaler: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / std."""
    joined = _with_scaler(frame, scaler, by)
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in features}
    return joined.withColumns(scaled).drop(*[f"{c}_{s}" for c in features for s in ("mean", "std")])


def unstandardise(frame: DataFrame, scaler: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    joined = _with_scaler(frame, scaler, by)
    back = {c: F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in features}
    return joined.withColumns(back).drop(*[f"{c}_{s}" for c in features for s in ("mean", "std")])


def sliding_windows(frame: DataFrame, features: Sequence[str], length: int, stride: int = 1, rule: str = "last", by: Sequence[str] = (), order: Sequence[str] = ("time_index",), row_id: str | None = None) -> DataFrame:
    """Windows of `length` rows inside one specimen and session, starting every `stride` rows; rests are discarded.

    x: rows of channel values; label and target by the rule `last` (the last row's) or `majority` (most frequent
    class, ties to the larger; mean target).  row_id: a column whose values are kept for the audits."""
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    if rule not in ("last", "majority"):
        raise ValueError(f"unknown label rule {rule}")
    keys = [*by, "specimen_id", "session_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    span = w.rowsBetween(-(length - 1), 0)
    out = {"rn": F.row_number().over(w), "x": F.collect_list(F.array(*features)).over(span), "start_time": F.min(order[0]).over(span)}
    if row_id:
        out["row_ids"] = F.collect_list(row_id).over(span)
    if rule == "majority":
        out["labels"] = F.collect_list("freshness_class").over(span)
        out["target"] = F.avg("tvc").over(span)
    rows = frame.withColumns(out)
    rows = rows.where((F.col("rn") >= length) & ((F.col("rn") - length) % stride == 0))
    if rule == "majority":
        labels = F.col("labels")
        best = F.array_max(F.transform(F.array_distinct(labels), lambda c: F.struct(F.size(F.filter(labels, lambda y: y == c)).alias("n"), c.alias("c"))))
        rows = rows.withColumn("label", best["c"])
    else:
        rows = rows.withColumns({"label": F.col("freshness_class"), "target": F.col("tvc")})
    extra = ["row_ids"] if row_id else []
    return rows.select(*keys, F.floor((F.col("rn") - length) / stride).cast("int").alias("window_no"), "start_time", F.col(order[0]).alias("end_time"), "label", "target", "x", *extra)


def long_session_windows(frame: DataFrame, features: Sequence[str], length: int, stride: int = 1, rule: str = "last", by: Sequence[str] = (), order: Sequence[str] = ("time_index",), row_id: str | None = None, block_rows: int = 100_000) -> DataFrame:
    """The same windows where a session may be too long for one task.

    Rows get their place in their session from global positions; a session is cut into blocks of block_rows rows, each
    of which also gets the length - 1 rows before it, and windows that end in those are left to the block before."""
    if block_rows < length:
        raise ValueError("a block must hold a window")
    keys = [*by, "specimen_id", "session_id"]
    placed = with_position(frame, [*keys, *order])
    first = placed.groupBy(*keys).agg(F.min("pos").alias("_first"))
    rows = placed.join(first, keys).withColumn("_at", F.col("pos") - F.col("_first")).drop("pos", "_first")
    own = F.floor(F.col("_at") / block_rows)
    next_too = F.col("_at") % block_rows >= block_rows - (length - 1)
    blocks = F.when(next_too, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumn("_block", F.explode(blocks)).withColumn("session_id", F.to_json(F.struct("session_id", "_block")))
    order_in = ["_at", *order]
    wide = sliding_windows(cut, features, length, 1, rule, by, order_in, row_id)
    parts = F.from_json("session_id", "session_id string, _block bigint")
    last = F.col("end_time")
    kept = wide.withColumns({"_s": parts, "_last": last}).where(F.floor(F.col("_last") / block_rows) == F.col("_s._block"))
    number = F.col("_last") - (length - 1)
    kept = kept.where((number >= 0) & (number % stride == 0))
    out = kept.withColumns({"session_id": F.col("_s.session_id"), "window_no": F.floor(number / stride).cast("int"), "start_at": F.col("start_time"), "end_at": F.col("_last")})
    return out.drop("_s", "_last", "start_time", "end_time")


def skipped_sessions(frame: DataFrame, length: int) -> DataFrame:
    """Sessions too short for a window: they give none, without an error."""
    return frame.groupBy("specimen_id", "session_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < length)


def check_specimens(frame: DataFrame, length: int) -> None:
    """A specimen too short for a window is an error."""
    short = frame.groupBy("specimen_id").agg(F.count("*").alias("n")).where(F.col("n") < length).limit(5).collect()
    if short:
        raise ValueError(f"specimens with fewer than {length} rows: {[r.specimen_id for r in short]}")


def window_features(frame: DataFrame, value: str, by: Sequence[str], order: str) -> DataFrame:
    """mean, population std, min, max and last minus first of a channel in each group."""
    return frame.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max_by(value, order) - F.min_by(value, order)).alias("change"),
    )
