"""Scans and sinks: CSV, series files named by pattern, whitespace text, run records, edge tables, integrity."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import REQUIRED, SCHEMA


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A header row; blanks around column names (not values) are cut.  Without a schema all columns are text, to be
    cast strictly later: no second pass over the data infers types.  Files may order their columns differently:
    give them one by one to `read_series`."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names repeat: {names}")
    return df.toDF(*names)


def read_series(spark: SparkSession, files: dict[str, tuple[str, str | None]]) -> DataFrame:
    """An explicit list: path -> (specimen, session or None for the specimen), united by column name."""
    out = None
    for path, (specimen, session) in sorted(files.items()):
        one = read_csv(spark, path).withColumns({"series_specimen": F.lit(specimen), "series_session": F.lit(session or specimen)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files")
    return out


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_glob(spark: SparkSession, glob: str, pattern: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Files whose names give the keys: named groups `specimen` and `session` (default: the file's stem).

    A name that doesn't match is an error, as is an alias (wrong name -> right name) that no file uses."""
    compiled = re.compile(pattern)
    if "specimen" not in compiled.groupindex:
        raise ValueError("the pattern needs a group named specimen")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    df = read_csv(spark, glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    raw = df.select("*", name.alias("series_file"))
    used = F.col("series_file")
    if aliases:
        seen = {r.series_file for r in raw.select("series_file").where(F.col("series_file").isin(list(aliases))).distinct().collect()}
        if unused := sorted(set(aliases) - seen):
            raise ValueError(f"aliases that no file uses: {unused}")
        pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        used = F.coalesce(pairs[F.col("series_file")], F.col("series_file"))
    part = lambda group: F.regexp_extract(used, java, compiled.groupindex[group])
    specimen = F.when(used.rlike(java), part("specimen")).otherwise(F.raise_error(F.concat(F.lit("file name doesn't match: "), used)))
    session = part("session") if "session" in compiled.groupindex else file_stem(used)
    return raw.withColumns({"series_specimen": specimen, "series_session": session})


def with_row_index(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of text files with their 0-based position in each.

    Files are read whole, since only inside one file is the order of lines defined; meant for series of small files."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.col("content").cast("string").alias("text"))
    each = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")).alias("row_index", "line"))
    return each.where("row_index > 0").select("path", (F.col("row_index") - 1).cast("bigint").alias("row_index"), "line")


def read_whitespace(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Numbers of chosen columns (name -> 0-based place) of whitespace-separated text, with the file's name."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_name").alias("file"), *[F.get(parts, F.lit(i)).cast("double").alias(c) for c, i in columns.items()])


def read_records(spark: SparkSession, base: str) -> DataFrame:
    """Run records (JSON lines or a document a file) below a folder; one without a required field is an error."""
    df = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(base)
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("record without a required field: "), F.to_json(F.struct(*REQUIRED))))).otherwise(F.col("run_id"))
    return df.withColumn("run_id", checked)


def write_records(records: DataFrame, base: str, mode: str = "append") -> None:
    """The folder names the experiment, data set and model; they are kept in the documents too."""
    keys = ["experiment", "dataset", "model"]
    copies = records.withColumns({f"by_{k}": F.col(k) for k in keys})
    copies.write.mode(mode).partitionBy(*[f"by_{k}" for k in keys]).json(base)


def write_folds(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).partitionBy("fold_id", "split").parquet(path)


def write_scalers(scalers: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scalers (n_fit_rows, <channel>_mean and _std, and keys such as fold_id), a row each."""
    scalers.write.mode(mode).parquet(path)


def read_scalers(spark: SparkSession, path: str, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scalers as written; a table that lacks a channel's statistics, holds other types, has a deviation that isn't positive
    or several rows for a key is an error."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    wanted = {"n_fit_rows": "bigint", **{f"{c}_{s}": "double" for c in features for s in ("mean", "std")}}
    if bad := sorted(c for c, k in wanted.items() if kinds.get(c) != k) + sorted(set(keys) - set(kinds)):
        raise ValueError(f"no scaler: {bad} are missing or of another type")
    wrong = F.lit(False)
    for c in features:
        wrong = wrong | F.col(f"{c}_mean").isNull() | F.isnan(f"{c}_mean") | ~F.coalesce(F.col(f"{c}_std") > 0, F.lit(False))
    faults = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(wrong).alias("wrong")).where("n > 1 OR wrong")
    if not faults.isEmpty():
        raise ValueError("no scaler: deviations must be positive, and keys differ")
    return df.select(*keys, *wanted)


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.write.mode(mode).parquet(path)


def read_npz_edges(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """src, dst, w of a compressed sparse row matrix in an NPZ file: keys <prefix>_data, _indices and _indptr."""
    with np.load(path) as z:
        indptr, indices, data = (z[f"{prefix}_{k}"] for k in ("indptr", "indices", "data"))
    src = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    rows = list(zip(src.tolist(), indices.tolist(), data.astype(float).tolist(), strict=True))
    return spark.createDataFrame(rows, "src bigint, dst bigint, w double")


def write_npz_edges(edges: DataFrame, path: str, prefix: str, n: int) -> None:
    """The reverse, of a selected (bounded) graph with ids 0 to n - 1."""
    e = edges.orderBy("src", "dst").toPandas()
    indptr = np.concatenate([[0], np.cumsum(np.bincount(e.src, minlength=n))])
    np.savez_compressed(path, **{f"{prefix}_data": e.w.to_numpy(), f"{prefix}_indices": e.dst.to_numpy(), f"{prefix}_indptr": indptr})


def verify_manifest(spark: SparkSession, manifest: DataFrame, base: str) -> DataFrame:
    """name, status (present, missing or corrupt) of each file of a manifest (name, sha256)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    digests = found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "present").otherwise("corrupt")
    return manifest.join(digests, "name", "left").select("name", status.alias("status"))


def verify_crc(found: DataFrame) -> DataFrame:
    """path and CRC-32 of binary files, as archive members are checked."""
    return found.select("path", F.crc32("content").alias("crc32"))
