"""Intermediate tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir.  Where that is unset, a local master (tests) gets a local
    folder; on a cluster it is an error, since executors wouldn't see each other's files."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        folder = sc.getCheckpointDir()
    own = f"{folder.rstrip('/')}/lattica-{sc.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_clean, spark, own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, path: str) -> None:
    """Delete an application's intermediate tables when it ends, if its session is still there."""
    with contextlib.suppress(Exception):
        remove(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage is cut, and it survives lost executors, which a
    cached or locally checkpointed one doesn't."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
