"""Evidence bundles: tables that belong together, and the integrity constraints between them, checked in one aggregation.

Every constraint says which keys of which tables it counts.  Each table is read once; its rows give a small record for each
constraint that they take part in, and one grouping by constraint and key counts them all.  Each fault is a row, so a
broken bundle is reported whole instead of by its first fault."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files of a bundle (fixed values) by table, after the bundle's name.
FILES = {"per_run": "_per_run.csv", "summary": "_summary.csv", "fingerprints": "_fingerprints.csv", "touched": "_test_touched_once.json"}
RUN_KEY = ("dataset", "model", "task", "seed", "fold_id")


class BrokenBundle(ValueError):
    """A bundle that must not be read on; the message lists its first faults."""


@dataclass(frozen=True)
class Unique:
    """Rows of a table differ in their keys."""

    table: str
    keys: Sequence[str]

    def sides(self) -> list[tuple[str, Sequence[str], Column, Column]]:
        return [(self.table, self.keys, F.lit(1), F.lit(0))]

    def fault(self) -> tuple[Column, Column, Column]:
        return F.col("one") > 1, F.col("one"), F.lit(1)


@dataclass(frozen=True)
class References:
    """Each key of a table is one of another table's."""

    table: str
    keys: Sequence[str]
    parent: str
    parent_keys: Sequence[str]

    def sides(self) -> list[tuple[str, Sequence[str], Column, Column]]:
        return [(self.table, self.keys, F.lit(1), F.lit(0)), (self.parent, self.parent_keys, F.lit(0), F.lit(1))]

    def fault(self) -> tuple[Column, Column, Column]:
        return (F.col("one") > 0) & (F.col("two") == 0), F.col("two"), F.col("one")


@dataclass(frozen=True)
class Counts:
    """A table states for each key how many rows another table has; keys of either side alone are faults too."""

    table: str
    keys: Sequence[str]
    column: str
    counted: str
    counted_keys: Sequence[str]

    def sides(self) -> list[tuple[str, Sequence[str], Column, Column]]:
        return [(self.table, self.keys, F.lit(0), F.expr(f"coalesce(try_cast({self.column} AS bigint), 0)")), (self.counted, self.counted_keys, F.lit(1), F.lit(0))]

    def fault(self) -> tuple[Column, Column, Column]:
        return F.col("one") != F.col("two"), F.col("one"), F.col("two")


@dataclass(frozen=True)
class Zero:
    """A column adds up to 0; a table without rows or values counts as -1."""

    table: str
    column: str

    def sides(self) -> list[tuple[str, Sequence[str], Column, Column]]:
        return [(self.table, (), F.expr(f"if(try_cast({self.column} AS bigint) IS NULL, 0, 1)"), F.expr(f"coalesce(abs(try_cast({self.column} AS bigint)), 0)"))]

    def fault(self) -> tuple[Column, Column, Column]:
        found = F.when(F.col("one") == 0, -1).otherwise(F.col("two"))
        return found != 0, found, F.lit(0)


Constraint = Unique | References | Counts | Zero

#: What holds in a bundle of run records.
BUNDLE: dict[str, Constraint] = {
    "run keys are unique": Unique("per_run", RUN_KEY),
    "summary counts the runs": Counts("summary", ("dataset", "model"), "n_runs", "per_run", ("dataset", "model")),
    "runs have fingerprints": References("per_run", ("run_id",), "fingerprints", ("run_id",)),
    "fingerprints belong to runs": References("fingerprints", ("run_id",), "per_run", ("run_id",)),
    "test sets are touched once": Zero("touched", "n_violations"),
}


def faults(tables: Mapping[str, DataFrame], constraints: Mapping[str, Constraint]) -> DataFrame:
    """constraint, key, found, wanted: a row for each fault; keys are their values joined by bars."""
    names, all_records = list(constraints), None
    kind = "struct<c: int, key: array<string>, one: bigint, two: bigint>"

    def record(i: int, keys: Sequence[str], one: Column, two: Column) -> Column:
        key = F.array(*[F.col(k).cast("string") for k in keys]) if keys else F.array().cast("array<string>")
        return F.struct(F.lit(i).alias("c"), key.alias("key"), one.cast("bigint").alias("one"), two.cast("bigint").alias("two")).cast(kind)

    for table, df in tables.items():
        own = [record(i, keys, one, two) for i, c in enumerate(constraints.values()) for t, keys, one, two in c.sides() if t == table]
        if own:
            rows = df.select(F.explode(F.array(*own)).alias("r")).select("r.*")
            all_records = rows if all_records is None else all_records.unionByName(rows)
    if all_records is None:
        raise ValueError("no constraint names a table of the bundle")
    spark = all_records.sparkSession
    always = [(i, [], 0, 0) for i, c in enumerate(constraints.values()) if isinstance(c, Zero)]
    if always:  # so that a table without rows is counted
        all_records = all_records.unionByName(spark.createDataFrame(always, "c int, key array<string>, one bigint, two bigint"))
    counts = all_records.groupBy("c", "key").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    bad, found, wanted = F.lit(False), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for i, c in enumerate(constraints.values()):
        is_bad, has, should = c.fault()
        bad, found, wanted = (F.when(F.col("c") == i, x).otherwise(y) for x, y in ((is_bad, bad), (has, found), (should, wanted)))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)
    return counts.where(bad).select(name.alias("constraint"), F.array_join("key", "|", "null").alias("key"), found.cast("bigint").alias("found"), wanted.cast("bigint").alias("wanted"))


def write_bundle(tables: Mapping[str, DataFrame], base: str) -> None:
    """The tables as CSV with headers, `touched` as JSON; each is a folder of part files."""
    for name, df in tables.items():
        if FILES[name].endswith(".csv"):
            df.write.option("header", True).csv(base + FILES[name])
        else:
            df.write.json(base + FILES[name])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_bundle(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the bundle that are there, with columns as text."""
    found = {}
    for name, suffix in FILES.items():
        if _exists(spark, base + suffix):
            found[name] = spark.read.option("header", True).csv(base + suffix) if suffix.endswith(".csv") else spark.read.option("primitivesAsString", True).json(base + suffix)
    return found


def scan_bundle(spark: SparkSession, base: str, required_models: Sequence[str] = (), constraints: Mapping[str, Constraint] | None = None) -> DataFrame:
    """All faults of a bundle: files and columns that are missing, models that are required and absent, and broken
    constraints (those that need what is missing aren't checked)."""
    tables, wanted = read_bundle(spark, base), dict(BUNDLE if constraints is None else constraints)
    if required_models:
        tables["required"] = spark.createDataFrame([(m,) for m in required_models], "model string")
        wanted["required models are there"] = References("required", ("model",), "per_run", ("model",))
    read = lambda c: [(t, k) for t, keys, *_ in c.sides() for k in [*keys, *([c.column] if t == c.table and hasattr(c, "column") else [])]]
    absent = [("files are there", s, 0, 1) for n, s in FILES.items() if n not in tables]
    lacking = {(t, k) for c in wanted.values() for t, k in read(c) if t in tables and k not in tables[t].columns}
    absent += [("columns are there", f"{t}.{k}", 0, 1) for t, k in sorted(lacking)]
    there = {n: c for n, c in wanted.items() if all(t in tables for t, *_ in c.sides()) and not lacking & set(read(c))}
    schema = "constraint string, key string, found bigint, wanted bigint"
    out = spark.createDataFrame(absent, schema)
    return out.unionByName(faults(tables, there)) if there else out


def load_bundle(spark: SparkSession, base: str, required_models: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a bundle without faults; else an error that names some."""
    bad = scan_bundle(spark, base, required_models).orderBy("constraint", "key").limit(20).collect()
    if bad:
        raise BrokenBundle("; ".join(f"{r['constraint']}: {r['key']} ({r['found']} instead of {r['wanted']})" for r in bad))
    return read_bundle(spark, base)
