"""Materialised graph blocks: edges written in order with a tree of digests, so that a whole graph has one hash and a change is
found by its branch.

Rows are dealt by ranges of (src, dst) and numbered; FAN rows make a branch, FAN branches the next one above, up to the
root.  No row or task holds more than FAN digests, whatever the graph's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from ..storage import materialise

FAN = 1000


def row_digest() -> Column:
    """SHA-256 of an edge: its ends and weight as text, parted by bars; null as nothing."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", part("src"), part("dst"), part("w")).cast("binary"), 256)


def _above(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """The nodes one level up: each the SHA-256 of its children's digests in order."""
    inside = F.array_sort(F.collect_list(F.struct("place", "digest")))
    joined = F.array_join(F.transform(inside, lambda x: x["digest"]), "")
    return nodes.groupBy((F.expr(f"place div {fan}")).alias("above")).agg(F.sha2(joined.cast("binary"), 256).alias("digest")).select(F.lit(level).alias("level"), F.col("above").alias("place"), "digest")


def digest_tree(numbered: DataFrame, fan: int = FAN) -> DataFrame:
    """level (1: branches of rows), place, digest of all nodes over rows with `pos`, written; the last level has one."""
    n = numbered.agg(F.max("pos")).first()[0]
    rows = numbered.select(F.col("pos").alias("place"), row_digest().alias("digest"))
    if n is None:
        return rows.sparkSession.createDataFrame([], "level int, place bigint, digest string")
    out, here, level, width = None, rows, 0, n + 1
    while width > 1 or level == 0:
        level, width = level + 1, -(-width // fan)
        here = materialise(_above(here, level, fan), "digest-level")
        out = here if out is None else out.unionByName(here)
    return out


def write_block(edges: DataFrame, path: str, fan: int = FAN) -> DataFrame:
    """Edges (src, dst, w) in order below `path`/edges with their place `pos`, and the tree below `path`/digests; the tree."""
    given = materialise(edges.select("src", "dst", "w"), "block-edges")
    with_position(given, ["src", "dst", "w"], "pos").write.parquet(f"{path}/edges")
    spark = edges.sparkSession
    digest_tree(spark.read.parquet(f"{path}/edges"), fan).withColumn("fan", F.lit(fan)).write.parquet(f"{path}/digests")
    return spark.read.parquet(f"{path}/digests").drop("fan")


def read_block(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/edges").select("src", "dst", "w")


def verify_block(spark: SparkSession, path: str) -> DataFrame:
    """level, place, digest, found, status of every node: whole, changed, missing (no rows found) or extra (not in the tree).

    A changed row changes its branch and every node above it, and no other."""
    stored = spark.read.parquet(f"{path}/digests")
    fan = stored.agg(F.max("fan")).first()[0] or FAN
    found = digest_tree(spark.read.parquet(f"{path}/edges"), fan).withColumnRenamed("digest", "found")
    both = stored.drop("fan").join(found, ["level", "place"], "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("found") == F.col("digest"), "whole").otherwise("changed")
    return both.select("level", "place", "digest", "found", status.alias("status"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """file, n_branches: files that have rows of branches that aren't whole."""
    bad = verify_block(spark, path).where("level = 1 AND status <> 'whole'").select("place")
    fan = spark.read.parquet(f"{path}/digests").agg(F.max("fan")).first()[0] or FAN
    rows = spark.read.parquet(f"{path}/edges").select(F.col("_metadata.file_name").alias("file"), F.expr(f"pos div {fan}").alias("place"))
    return rows.join(bad, "place").groupBy("file").agg(F.count_distinct("place").alias("n_branches"))
