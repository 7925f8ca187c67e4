"""The canonical sensor frame: renaming, casts, labels, filters, specimens and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import block_name, digitize, is_finite, map_label

RESERVED = ("specimen_id", "session_id", "time_index", "freshness_class", "tvc")
#: Sources of specimen ids that a compliant protocol accepts.
COMPLIANT_SOURCES = ("published", "series_file")


@dataclass(frozen=True)
class FrameConfig:
    """How a provider's columns become the canonical frame; columns are mapped by name only."""

    columns: dict[str, str]  # canonical name -> source column
    features: dict[str, str]  # channel -> source column
    label_map: dict[str, int] | None = None
    thresholds: Sequence[float] | None = None
    label_source: str = "tvc"
    n_classes: int = 4
    keep: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.features or len(set(self.features)) != len(self.features):
            raise ValueError("channels must be given, and differ")
        if self.thresholds is not None and any(b <= a for a, b in zip(self.thresholds, self.thresholds[1:], strict=False)):
            raise ValueError("thresholds must strictly increase")


def normalise(raw: DataFrame, config: FrameConfig) -> DataFrame:
    """Select, rename and cast strictly (a value that can't be read is an error), then derive the class."""
    wanted = [*config.columns.values(), *config.features.values(), *config.keep]
    if missing := sorted(set(wanted) - set(raw.columns)):
        raise ValueError(f"missing columns {missing}; available: {raw.columns}")
    kinds = {"time_index": "double", "tvc": "double", "specimen_id": "string", "session_id": "string"}
    picked = [F.col(f"`{s}`").cast(kinds.get(c, "string")).alias(c) for c, s in config.columns.items()]
    picked += [F.col(f"`{s}`").cast("double").alias(c) for c, s in config.features.items()]
    out = raw.select(*picked, *[F.col(c) for c in config.keep])
    if config.thresholds is not None:
        return out.withColumn("freshness_class", digitize(config.label_source, config.thresholds))
    if config.label_map is not None:
        return out.withColumn("freshness_class", map_label("freshness_class", config.label_map))
    return out.withColumn("freshness_class", F.col("freshness_class").cast("int"))


def finite_rows(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows all of whose channels are finite; the target isn't looked at."""
    keep = F.lit(True)
    for c in features:
        keep = keep & is_finite(c)
    return frame.where(keep)


def finite_report(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in features:
        bad = bad | ~is_finite(c)
    return frame.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_dropped"), F.count_if(~is_finite("tvc")).alias("n_target_not_finite"))


def label_range_violations(frame: DataFrame, n_classes: int) -> DataFrame:
    c = F.col("freshness_class")
    return frame.where(c.isNull() | (c < 0) | (c >= n_classes)).groupBy("freshness_class").agg(F.count("*").alias("n"))


def time_blocks(frame: DataFrame, size: int, by: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """specimen_id from blocks of `size` rows (by="rows") or distinct times (by="time").

    With `within`, blocks are numbered inside each group, which keeps the ranking distributed."""
    w = Window.partitionBy(*within).orderBy(*order) if within else Window.orderBy(*order)
    rank = (F.row_number() if by == "rows" else F.dense_rank()).over(w) - 1
    name = block_name(rank, size)
    if within:
        name = F.concat_ws("/", *within, name)
    return frame.withColumn("specimen_id", name)


def straddling_sessions(frame: DataFrame) -> DataFrame:
    """Sessions that belong to more than one specimen: must be empty."""
    n = F.count_distinct("specimen_id")
    return frame.groupBy("session_id").agg(n.alias("n_specimens")).where("n_specimens > 1")


def label_summary(frame: DataFrame) -> DataFrame:
    """One row: rows, specimens, sessions, and rows of a specimen (least, most, median)."""
    per = frame.groupBy("specimen_id").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s"))
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_specimens"),
        F.sum("s").alias("n_sessions"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        F.percentile("n", F.lit(0.5)).alias("median_rows"),
    )


def class_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("freshness_class").agg(F.count("*").alias("n_rows"))


def usable_specimens(frame: DataFrame, length: int) -> DataFrame:
    return frame.groupBy("specimen_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= length)


def compliant(source: Column | str) -> Column:
    return (F.col(source) if isinstance(source, str) else source).isin(*COMPLIANT_SOURCES)
