"""What the operators of this subpackage share: bounded labelled samples, slices of batches and the state of Python
workers; and the engine's storage for intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_path

__all__ = ["WORD", "id_text", "labelled_sample", "materialise", "remembered", "shared_path", "slices", "table"]

#: Word separators of the contracts: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (bigint) and the text (null: empty), so that no other column's name can clash."""
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], bound: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, *label_cols) of at most `bound` labelled documents: those whose hashed id is smallest.

    Labels with a null id or a null label are left out; of repeated ids one row counts.  The bound makes
    the broadcast and what a classifier's fit collects the same at every size of the corpus."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in label_cols])
    rows = rows.where(F.col("doc_id").isNotNull())
    for c in label_cols:
        rows = rows.where(F.col(c).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in label_cols])
    n = rows.count()
    if n > 4 * bound:  # so that the sort below gets about twice the bound from all tasks together, not the bound from each
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int((1 << 32) * 2 * bound / n)))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return id_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def remembered(kind: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next (functions pickled by value keep nothing).  Only the
    last kind asked for is kept, so that the stages of a pipeline don't add up."""
    module = sys.modules.get("_lattica_worker")
    if module is None:
        module = sys.modules["_lattica_worker"] = types.ModuleType("_lattica_worker")
    held = vars(module).setdefault("held", {})
    if kind not in held:
        held.clear()
        held[kind] = make()
    return held[kind]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows, so that few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
