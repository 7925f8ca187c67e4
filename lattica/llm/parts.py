"""Tables in a global order, in numbered parts of bounded size that tasks work through one by one.

A group (a conversation, a source) of any size may run over several parts: the parts of a group are told apart by
segments, one for each group in a part, with the number of the group's rows before it and in all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise


def in_parts(df: DataFrame, order: Sequence[str], rows: int, name: str) -> DataFrame:
    """df in the order (nulls first), written, with `part` and `pos`, the place in the part; about `rows` in a part.

    Rows that agree in the order are told apart by their place in df, which must be a written table, so that
    any number of them can be dealt to several parts."""
    parts = max(1, -(-df.count() // rows))
    keyed = df.withColumn("_uid", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, *order, "_uid").sortWithinPartitions(*order, "_uid").drop("_uid")
    return materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), name)


def segments(ordered: DataFrame, group: str, name: str) -> DataFrame:
    """part, group, first (pos), m (rows), before (the group's rows in earlier parts), n (the group's rows in all)."""
    each = ordered.groupBy("part", group).agg(F.min("pos").alias("first"), F.count("*").alias("m"))
    along = Window.partitionBy(group).orderBy("part")
    return materialise(each.withColumn("before", F.sum("m").over(along) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(group))), name)
