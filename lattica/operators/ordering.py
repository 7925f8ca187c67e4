"""Global positions of rows in an order, without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise


def with_running_total(df: DataFrame, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows before each row in the order (a unique one).

    Rows are dealt by ranges of the order, written with their range's number, summed, and placed inside it; only
    the sums of ranges meet in one place.  The written table fixes the ranges, so that a task that runs again
    can't see others."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_range_before"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order)) - F.col(value)
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_range_before") + F.col("_inside")).drop("_range", "_inside", "_range_before")


#: Bits of a row's number inside its task, in the ids that Spark gives.
ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """df with the 0-based place of each row in the order (a unique one).

    Ranges of the order are sorted and numbered in the task that writes them, so rows are shuffled once."""
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialise(numbered, "ranged")
    counts = ranged.groupBy(F.shiftright("_id", ROW_BITS).alias("_range")).agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranged.withColumn("_range", F.shiftright("_id", ROW_BITS)).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)).drop("_range", "_id", "_before")


def in_file_order(df: DataFrame, name: str = "_at") -> DataFrame:
    """df, a scan of files, with a number that grows with the file's path and the row's place in the file.

    Floating-point sums depend on their order; taken in this one, they don't depend on how files are split into tasks."""
    keyed = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = df.select(F.col("_metadata.file_path").alias("_file")).distinct()
    files = files.select("_file", F.row_number().over(Window.orderBy("_file")).cast("bigint").alias("_file_no"))
    return keyed.join(F.broadcast(files), "_file").withColumn(name, F.col("_file_no") * (1 << 40) + F.col("_row")).drop("_file", "_file_no", "_row")
