"""Run records: flattening, aggregation, identity, ledgers and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A run record as written in JSON, one document for each run.
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_id", "experiment", "dataset", "model", "task", "status", "config_hash", "fold_fingerprint", "test_fingerprint", "failure_reason", "timestamp_utc", "protocol_version", "evidence_class")]
    + [T.StructField(n, T.IntegerType()) for n in ("seed", "fold_id", "window_length")]
    + [
        T.StructField("n_train_windows", T.LongType()),
        T.StructField("n_test_windows", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("protocol_compliant", T.BooleanType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("train_specimens", T.ArrayType(T.StringType())),
        T.StructField("test_specimens", T.ArrayType(T.StringType())),
    ]
)
REQUIRED = ("run_id", "experiment", "dataset", "model", "task", "seed", "fold_id", "status")


def flatten(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A flat row for each record, with a column for each declared metric; specimens joined by a bar."""
    cols = [c for c in records.columns if c not in ("metrics", "train_specimens", "test_specimens")]
    return records.select(*cols, F.array_join("test_specimens", "|").alias("test_specimens_joined"), *[F.col("metrics")[m].alias(m) for m in metrics])


def aggregate_runs(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric, counts of runs, seeds, windows and distinct specimens."""
    stats = [x for m in metrics for x in (F.avg(F.nanvl(m, F.lit(None))).alias(f"{m}_mean"), F.stddev_samp(F.nanvl(m, F.lit(None))).alias(f"{m}_std"))]
    plain = runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.count_distinct("seed").alias("n_seeds"), F.sum("n_windows").alias("n_windows"), F.avg("duration_s").alias("mean_duration_s"), *stats)
    names = runs.select(*by, F.explode(F.split("test_specimens", r"\|")).alias("s")).where("s <> ''")
    distinct = names.groupBy(*by).agg(F.count_distinct("s").alias("n_distinct_specimens"))
    on = [plain[c].eqNullSafe(distinct[c]) for c in by]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return plain.join(distinct, condition, "left").select(*[plain[c] for c in plain.columns], F.coalesce("n_distinct_specimens", F.lit(0)).alias("n_distinct_specimens"))


def seed_block_violations(runs: DataFrame, primary: int = 10) -> DataFrame:
    """Configurations that pool primary and extended seeds."""
    block = F.when(F.col("seed") < primary, "primary").otherwise("extended")
    return runs.groupBy("config_hash").agg(F.count_distinct(block).alias("n_blocks"), F.min("seed").alias("min_seed"), F.max("seed").alias("max_seed")).where("n_blocks > 1")


def parameter_table(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.percentile(value, F.lit(0.5)).alias("median"), F.count_distinct(value).alias("n_distinct"), F.count(value).alias("n_records"))


def touched_once(records: DataFrame) -> DataFrame:
    """fingerprint, n_runs, n_configs, finding: `violation` for several configurations, `repeat` for several runs."""
    ok = records.where("status = 'ok' AND fingerprint IS NOT NULL AND fingerprint <> ''")
    g = ok.groupBy("fingerprint").agg(F.count("*").alias("n_runs"), F.count_distinct("config_hash").alias("n_configs"))
    return g.withColumn("finding", F.when(F.col("n_configs") > 1, "violation").when(F.col("n_runs") > 1, "repeat").otherwise("once"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def prior_ledger(records: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The first value written under each key."""
    return records.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("prior"))


def lookup_prior(units: DataFrame, current: DataFrame, legacy: DataFrame, keys: Sequence[str], legacy_keys: Sequence[str]) -> DataFrame:
    """The prior of each unit by its current key, else by its legacy key."""
    a = units.join(current.withColumnRenamed("prior", "_current"), list(keys), "left")
    b = a.join(legacy.withColumnRenamed("prior", "_legacy"), list(legacy_keys), "left")
    return b.withColumn("prior", F.coalesce("_current", "_legacy")).withColumn("tier", F.when(F.col("_current").isNotNull(), "current").when(F.col("_legacy").isNotNull(), "legacy").otherwise("none")).drop("_current", "_legacy")


def cluster_provenance(rows: DataFrame, cluster: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return rows.groupBy(cluster).agg(joined("fold_id").alias("folds"), joined("seed").alias("seeds"), joined("model").alias("models"), F.count("*").alias("n_rows"))


def skip_reasons(rows: DataFrame, reasons: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons], F.count("*").alias("n_total"))


def unscored(units: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units that have no record yet: what a resumed run still has to do."""
    return units.join(done.select(*keys).distinct(), list(keys), "left_anti")


def migrate_identity(rows: DataFrame, old: Sequence[str], new: Sequence[str], order: Sequence[str], config: str) -> DataFrame:
    """Records re-keyed from old to new identities: `adopted` (the first under its new key), `duplicate` (a later one of
    the same configuration) or `conflict` (a later one of another), with the number of old keys that meet in the new one."""
    w = Window.partitionBy(*new)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_first": F.first(config).over(w.orderBy(*order))})
    keys = rows.groupBy(*new).agg(F.count_distinct(F.struct(*old)).alias("n_old_keys"))
    status = F.when(F.col("_r") == 1, "adopted").when(F.col(config) == F.col("_first"), "duplicate").otherwise("conflict")
    return ranked.withColumn("status", status).drop("_r", "_first").join(keys, list(new))


def ledger_units(records: DataFrame, substrate: Sequence[str], scored: Column, fingerprint: str = "fingerprint", config: str = "config_hash") -> DataFrame:
    """fingerprint, substrate, n_ok, n_scored, n_configs, n_substrates, classification: a row for each evidence unit.

    A fingerprint that can't name the substrate may cover several (a collision); only the same substrate scored twice
    is a repeat: a recomputation of one configuration, or a true repeat of several.  Records that failed or have no
    fingerprint aren't units.  Both levels are map-side aggregates; nulls in the substrate are values like others."""
    ok = records.where((F.col("status") == "ok") & (F.coalesce(F.col(fingerprint), F.lit("")) != ""))
    units = ok.groupBy(fingerprint, *substrate).agg(F.count("*").alias("n_ok"), F.count_if(scored).alias("n_scored"), F.count_distinct(F.coalesce(config, F.lit(""))).alias("n_configs"))
    kind = F.when(F.col("n_scored") <= 1, "single_scored_evaluation").when(F.col("n_configs") == 1, "recomputation_same_config").otherwise("true_repeat_different_config")
    shared = F.count("*").over(Window.partitionBy(fingerprint))
    return units.withColumns({"n_substrates": shared, "classification": kind})


def ledger_summary(units: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """One row: fingerprints, those of several substrates and those with a true repeat, units, and units of each kind."""
    repeat = F.max((F.col("classification") == "true_repeat_different_config").cast("int"))
    kinds = ("single_scored_evaluation", "recomputation_same_config", "true_repeat_different_config")
    each = units.groupBy(fingerprint).agg(F.count("*").alias("n"), repeat.alias("repeat"), *[F.count_if(F.col("classification") == k).alias(k) for k in kinds])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(F.count("*").alias("n_fingerprints"), F.count_if(F.col("n") > 1).alias("n_colliding"), total("repeat").alias("n_with_true_repeat"), total("n").alias("n_units"), *[total(k).alias(k) for k in kinds])


def fingerprint_rows(records: DataFrame, fields: Sequence[str], maps: Sequence[str] = (), time: str = "timestamp_utc") -> DataFrame:
    """The provenance of each record: identifiers and counts as they are, the time cut to seconds, and maps as JSON text
    with their keys in order (null: an empty one)."""
    cut = F.when(F.length(time) >= 19, F.concat(F.substring(time, 1, 19), F.lit("Z"))).otherwise(F.col(time))
    text = lambda c: F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit("{}"))
    return records.select(*[cut.alias(c) if c == time else F.col(c) for c in fields], *[text(c).alias(c) for c in maps])


def throughput(rows: DataFrame, by: Sequence[str], duration: str) -> DataFrame:
    """Runs, mean and sample deviation of their seconds, and runs a minute."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n_runs"), F.avg(duration).alias("mean_s"), F.stddev_samp(duration).alias("std_s"), F.sum(duration).alias("_total"))
    return g.withColumn("runs_per_minute", F.try_divide(60.0 * F.col("n_runs"), F.col("_total"))).drop("_total")
