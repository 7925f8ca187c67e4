"""The engine's Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lattica", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; skewed joins are split.  On a cluster leave `shuffle_partitions` unset and
    size `spark.sql.adaptive.advisoryPartitionSizeInBytes` instead."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **more,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()
