"""Sensor queries: the canonical frame from `events`, splits, scaling, windows and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import condition_label, digitize, draw, unit_id
from ..operators import audits, frames, splits, windows
from . import register, sql_cte

FEATURES = ("s1", "s2", "s3")
THRESHOLDS = (15.0, 36.0, 72.0)
SEED, K, LENGTH, STRIDE = 7, 5, 8, 4
CONFIG = frames.FrameConfig(
    columns={"specimen_id": "user", "session_id": "session", "time_index": "micros", "tvc": "target"},
    features={"s1": "value", "s2": "target", "s3": "k"},
    thresholds=THRESHOLDS,
    label_source="s1",
    keep=("event_id",),
)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as sensor rows: a user is a specimen, half a month of theirs a session."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "value",
        F.concat(F.lit("u"), "user_id").alias("user"),
        F.concat(F.lit("u"), "user_id", F.when(F.dayofmonth("ts") <= 15, "-a").otherwise("-b")).alias("session"),
        F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")).alias("micros"),
        F.log1p("value").alias("target"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    return frames.finite_rows(frames.normalise(raw, CONFIG), FEATURES)


FRAME = """frame AS (
    SELECT 'u' || user_id AS specimen_id, 'u' || user_id || CASE WHEN day(ts) <= 15 THEN '-a' ELSE '-b' END AS session_id,
           epoch_us(ts)::DOUBLE AS time_index, ln(1 + value) AS tvc, value AS s1, ln(1 + value) AS s2,
           regexp_extract(props, '"k": *(-?[0-9]+)', 1)::DOUBLE AS s3, event_id,
           (value >= 15)::INT + (value >= 36)::INT + (value >= 72)::INT AS freshness_class
    FROM events)"""
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
PLACED = f"""spec AS (SELECT DISTINCT specimen_id FROM frame),
placed AS (SELECT specimen_id, row_number() OVER (ORDER BY h, specimen_id) - 1 AS pos, count(*) OVER () AS n
    FROM (SELECT specimen_id, {DRAW.format(f"'perm|{SEED}|' || specimen_id")} AS h FROM spec))"""
BLOCK = "(CASE WHEN pos < (n % {k}) * (n // {k} + 1) THEN pos // (n // {k} + 1) ELSE (n % {k}) + (pos - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END)"
FOLDS = f"""{PLACED},
folds AS (SELECT f.fold_id, specimen_id, CASE WHEN b = fold_id THEN 'test' WHEN b = (fold_id + 1) % {K} THEN 'val' ELSE 'train' END AS split
    FROM (SELECT specimen_id, {BLOCK.format(k=K)} AS b FROM placed) p, (SELECT unnest(range({K}))::INT AS fold_id) f)"""
WINDOWS = f"""w0 AS (SELECT *, row_number() OVER o AS rn, list([s1, s2, s3]) OVER r AS x, list(event_id) OVER r AS row_ids, list(freshness_class) OVER r AS labels,
        avg(tvc) OVER r AS mean_tvc, min(time_index) OVER r AS start_time
    FROM frame WINDOW o AS (PARTITION BY specimen_id, session_id ORDER BY time_index, event_id),
        r AS (PARTITION BY specimen_id, session_id ORDER BY time_index, event_id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)),
win AS (SELECT *, ((rn - {LENGTH}) // 1)::INT AS window_no FROM w0 WHERE rn >= {LENGTH})"""

query = register("sensor")
ORDER = ("time_index", "event_id")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_kfold(frame(spark, sf_dir), K, SEED)


def plain_windows(df: DataFrame, rule: str = "last", stride: int = 1, by: tuple = ()) -> DataFrame:
    return windows.sliding_windows(df, FEATURES, LENGTH, stride, rule, by, ORDER, "event_id")


@query(sql_cte(FRAME, "SELECT specimen_id, session_id, time_index, event_id, round(s1, 6) AS s1, round(s2, 6) AS s2, s3, round(tvc, 6) AS tvc, freshness_class FROM frame"))
def ingest_canonical(spark, sf_dir):
    return frame(spark, sf_dir).select("specimen_id", "session_id", "time_index", "event_id", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "s3", F.round("tvc", 6).alias("tvc"), "freshness_class")


@query("SELECT event_id, (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS label FROM events")
def digitize_labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", digitize("value", [10, 50, 100]).alias("label"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS n_dropped,
    count(*) FILTER (event_id % 13 = 0) AS n_target_not_finite FROM events""")
def finite_filter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s1 = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    s2 = F.when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    tvc = F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    return frames.finite_report(e.select(s1.alias("s1"), s2.alias("s2"), tvc.alias("tvc")), ["s1", "s2"])


@query(sql_cte(FRAME, """SELECT session_id, event_id, session_id || '/block_' || lpad(((row_number() OVER (PARTITION BY session_id ORDER BY time_index, event_id) - 1) // 10)::VARCHAR, 4, '0') AS specimen_id FROM frame"""))
def time_block_rows(spark, sf_dir):
    return frames.time_blocks(frame(spark, sf_dir).drop("specimen_id"), 10, "rows", ORDER, ["session_id"]).select("session_id", "event_id", "specimen_id")


@query(sql_cte(FRAME, """SELECT session_id, event_id, session_id || '/block_' || lpad(((dense_rank() OVER (PARTITION BY session_id ORDER BY floor(time_index / 3600000000)) - 1) // 5)::VARCHAR, 4, '0') AS specimen_id FROM frame"""))
def time_block_time(spark, sf_dir):
    hours = frame(spark, sf_dir).drop("specimen_id").withColumn("hour", F.floor(F.col("time_index") / 3600000000))
    return frames.time_blocks(hours, 5, "time", ["hour"], ["session_id"]).select("session_id", "event_id", "specimen_id")


@query("""SELECT event_type || '-' || day(ts) AS session_id, count(DISTINCT user_id) AS n_specimens FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1""")
def session_straddle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return frames.straddling_sessions(e.select(F.concat_ws("-", "event_type", F.dayofmonth("ts")).alias("session_id"), F.col("user_id").alias("specimen_id")))


@query(sql_cte(FRAME, FOLDS, "SELECT * FROM folds"))
def group_kfold_assign(spark, sf_dir):
    return folds(spark, sf_dir)


@query(sql_cte(FRAME, PLACED, """SELECT fold_id, specimen_id, CASE WHEN pos = fold_id THEN 'test' WHEN pos = (fold_id + 1) % n THEN 'val' ELSE 'train' END AS split
    FROM placed, (SELECT unnest(range(10))::INT AS fold_id)"""))
def loso_assign(spark, sf_dir):
    return splits.loso(frame(spark, sf_dir), SEED, folds=10)


@query(sql_cte(FRAME, f"""placed AS (SELECT specimen_id, row_number() OVER (ORDER BY specimen_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT specimen_id FROM frame))""", f"""SELECT fold_id, specimen_id, CASE WHEN b = fold_id THEN 'test' WHEN b = (fold_id + 1) % {K} THEN 'val' ELSE 'train' END AS split
    FROM (SELECT specimen_id, {BLOCK.format(k=K)} AS b FROM placed), (SELECT unnest(range({K}))::INT AS fold_id)"""))
def time_block_holdout_assign(spark, sf_dir):
    return splits.time_block_holdout(frame(spark, sf_dir), K)


@query(sql_cte(FRAME, FOLDS, f"""r AS (SELECT fold_id, specimen_id, row_number() OVER (PARTITION BY fold_id ORDER BY {DRAW.format("'pool|7|' || specimen_id")}, specimen_id) - 1 AS pos, count(*) OVER (PARTITION BY fold_id) AS n FROM folds WHERE split = 'train')""",
    "SELECT f.name AS condition, fold_id, specimen_id FROM r, (VALUES (0.25, 'train25pct'), (0.5, 'train50pct'), (0.125, 'train12p5'), (1.0, 'full')) f(fraction, name0) , LATERAL (SELECT CASE WHEN fraction = 0.125 THEN 'train0p125' ELSE name0 END AS name) WHERE pos < ceil(fraction::DOUBLE * n)".replace("f.name AS", "name AS")))
def train_fraction_nested(spark, sf_dir):
    base, out = folds(spark, sf_dir), None
    for fraction in (0.25, 0.5, 0.125, 1.0):
        one = splits.fold_train_pool(base, fraction, SEED).select(condition_label(F.lit(fraction)).alias("condition"), "fold_id", "specimen_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql_cte(FRAME, FOLDS, "SELECT fold_id, count(*) AS n_fit_rows, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}) + 1e-8, 6) AS {c}_std" for c in FEATURES) + " FROM frame JOIN folds USING (specimen_id) WHERE split = 'train' GROUP BY fold_id"))
def scaler_fit(spark, sf_dir):
    s = windows.fold_scalers(frame(spark, sf_dir), folds(spark, sf_dir), FEATURES)
    return s.select("fold_id", "n_fit_rows", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


SCALED = ("sc AS (SELECT fold_id, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS d_{c}" for c in FEATURES) + " FROM frame JOIN folds USING (specimen_id) WHERE split = 'train' GROUP BY fold_id)")


@query(sql_cte(FRAME, FOLDS, SCALED, "SELECT f.fold_id, f.split, event_id, " + ", ".join(f"round(({c} - m_{c}) / d_{c}, 5) AS {c}" for c in FEATURES) + " FROM frame JOIN folds f USING (specimen_id) JOIN sc USING (fold_id)"))
def standardise(spark, sf_dir):
    f, assigned = frame(spark, sf_dir), folds(spark, sf_dir)
    out = windows.standardise(f.join(assigned, "specimen_id"), windows.fold_scalers(f, assigned, FEATURES), FEATURES, ["fold_id"])
    return out.select("fold_id", "split", "event_id", *[F.round(c, 5).alias(c) for c in FEATURES])


def _item(i: int):
    return lambda row: row[i]


@query(sql_cte(FRAME, WINDOWS, "SELECT specimen_id, session_id, window_no, start_time, time_index AS end_time, freshness_class AS label, round(tvc, 6) AS target, len(x) AS rows, round(list_sum(flatten(x)), 4) AS total FROM win"))
def windows_last(spark, sf_dir):
    w = plain_windows(frame(spark, sf_dir))
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v)
    return w.select("specimen_id", "session_id", "window_no", "start_time", "end_time", "label", F.round("target", 6).alias("target"), F.size("x").cast("bigint").alias("rows"), F.round(total, 4).alias("total"))


@query(sql_cte(FRAME, WINDOWS, """c AS (SELECT specimen_id, session_id, window_no, u.l AS l, count(*) AS n FROM win, LATERAL (SELECT unnest(labels) AS l) u GROUP BY ALL),
    b AS (SELECT specimen_id, session_id, window_no, l, row_number() OVER (PARTITION BY specimen_id, session_id, window_no ORDER BY n DESC, l DESC) AS r FROM c)""",
    "SELECT specimen_id, session_id, window_no, l AS label, round(mean_tvc, 6) AS target FROM win JOIN b USING (specimen_id, session_id, window_no) WHERE r = 1"))
def windows_majority(spark, sf_dir):
    return plain_windows(frame(spark, sf_dir), "majority").select("specimen_id", "session_id", "window_no", "label", F.round("target", 6).alias("target"))


@query(sql_cte(FRAME, WINDOWS, f"SELECT specimen_id, session_id, ((rn - {LENGTH}) // {STRIDE})::INT AS window_no, freshness_class AS label, row_ids[1] AS first_row, row_ids[{LENGTH}] AS last_row FROM win WHERE (rn - {LENGTH}) % {STRIDE} = 0"))
def windows_stride(spark, sf_dir):
    return plain_windows(frame(spark, sf_dir), stride=STRIDE).select("specimen_id", "session_id", "window_no", "label", F.element_at("row_ids", 1).alias("first_row"), F.element_at("row_ids", LENGTH).alias("last_row"))


@query(sql_cte(FRAME, "SELECT specimen_id, session_id, count(*) AS n_rows FROM frame GROUP BY ALL HAVING count(*) < 32"))
def skipped_sessions(spark, sf_dir):
    """Sessions that are too short for windows of 32 rows."""
    return windows.skipped_sessions(frame(spark, sf_dir), 32)


@query(sql_cte(FRAME, FOLDS, SCALED, f"""z AS (SELECT f.fold_id, f.split, specimen_id, session_id, time_index, event_id, freshness_class, tvc, {", ".join(f"({c} - m_{c}) / d_{c} AS {c}" for c in FEATURES)} FROM frame JOIN folds f USING (specimen_id) JOIN sc USING (fold_id)),
    w AS (SELECT *, row_number() OVER o AS rn, avg(s1) OVER r AS a1, avg(s2) OVER r AS a2, avg(s3) OVER r AS a3 FROM z
        WINDOW o AS (PARTITION BY fold_id, split, specimen_id, session_id ORDER BY time_index, event_id),
        r AS (PARTITION BY fold_id, split, specimen_id, session_id ORDER BY time_index, event_id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW))""",
    f"SELECT fold_id, split, freshness_class AS label, count(*) AS n_windows, round(avg(a1), 5) AS mean_s1, round(avg(a2), 5) AS mean_s2, round(avg(a3), 5) AS mean_s3, round(avg(tvc), 5) AS mean_target FROM w WHERE rn >= {LENGTH} GROUP BY ALL"))
def window_fold_summary(spark, sf_dir):
    """Flagship: folds, training-only scaling, windows that cross no specimen or session; counts and means.

    Windows are cut once, whatever the number of folds; a window's channel sums are scaled by each fold's statistics."""
    f, assigned = frame(spark, sf_dir), folds(spark, sf_dir)
    scaler = windows.fold_scalers(f, assigned, FEATURES)
    sums = [F.aggregate(F.transform("x", _item(i)), F.lit(0.0), lambda a, v: a + v) for i in range(len(FEATURES))]
    w = plain_windows(f).select("specimen_id", "label", "target", *[(s / LENGTH).alias(f"m{i}") for i, s in enumerate(sums)])
    # a fold's mean over windows is linear in the windows' means, so specimens are summed before folds multiply them
    per = w.groupBy("specimen_id", "label").agg(F.count("*").alias("n"), F.sum("target").alias("t"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(FEATURES))])
    g = per.join(assigned, "specimen_id").groupBy("fold_id", "split", "label").agg(F.sum("n").alias("n_windows"), F.sum("t").alias("t"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(FEATURES))])
    g = g.join(scaler, "fold_id")
    means = [F.round((F.col(f"m{i}") / F.col("n_windows") - F.col(f"{c}_mean")) / F.col(f"{c}_std"), 5).alias(f"mean_{c}") for i, c in enumerate(FEATURES)]
    return g.select("fold_id", "split", "label", "n_windows", *means, F.round(F.col("t") / F.col("n_windows"), 5).alias("mean_target"))


@query(sql_cte(FRAME, FOLDS, """bad AS (SELECT * FROM folds WHERE NOT (fold_id = 2 AND specimen_id LIKE '%3') UNION ALL SELECT 1, specimen_id, 'extra' FROM folds WHERE fold_id = 1 AND specimen_id LIKE '%5' UNION ALL SELECT 0, 'ghost', 'test')""",
    """SELECT fold_id, specimen_id, 'overlap' AS problem FROM bad GROUP BY fold_id, specimen_id HAVING count(*) > 1
    UNION ALL SELECT fold_id, specimen_id, 'missing' FROM (SELECT DISTINCT b.fold_id, s.specimen_id FROM bad b, spec s EXCEPT SELECT fold_id, specimen_id FROM bad)
    UNION ALL SELECT fold_id, specimen_id, 'unexpected' FROM bad WHERE specimen_id NOT IN (SELECT specimen_id FROM spec)"""))
def audit_fold(spark, sf_dir):
    """The audit on folds with planted faults."""
    f, good = frame(spark, sf_dir), folds(spark, sf_dir)
    bad = good.where(~((F.col("fold_id") == 2) & F.col("specimen_id").endswith("3")))
    bad = bad.unionByName(good.where((F.col("fold_id") == 1) & F.col("specimen_id").endswith("5")).withColumn("split", F.lit("extra")))
    bad = bad.unionByName(spark.createDataFrame([(0, "ghost", "test")], "fold_id int, specimen_id string, split string"))
    return audits.fold_audit(bad, f)


@query(sql_cte(FRAME, FOLDS, "t AS (SELECT * FROM frame JOIN folds USING (specimen_id) WHERE fold_id = 0 AND split = 'train')", " UNION ALL ".join(f"SELECT '{c}' AS channel, greatest(abs(a.m - b.m), abs(a.d - b.d)) > 1e-6 AS distinguishable FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM t) a, (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM frame) b" for c in FEATURES)))
def audit_scaler(spark, sf_dir):
    f = frame(spark, sf_dir)
    train = f.join(folds(spark, sf_dir).where("fold_id = 0 AND split = 'train'"), "specimen_id")
    return audits.scaler_audit(train, f, FEATURES).select("channel", "distinguishable")


@query(sql_cte(FRAME, f"""w AS (SELECT specimen_id, session_id, list(session_id) OVER (PARTITION BY specimen_id ORDER BY time_index, event_id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS owners,
        row_number() OVER (PARTITION BY specimen_id ORDER BY time_index, event_id) AS rn FROM frame)""", f"SELECT specimen_id, count(*) AS n_bad_windows FROM w WHERE rn >= {LENGTH} AND len(list_distinct(owners)) > 1 GROUP BY specimen_id"))
def audit_windows(spark, sf_dir):
    """Windows that were cut without regard to sessions, found by their rows' owners."""
    f = frame(spark, sf_dir)
    careless = plain_windows(f.withColumn("session_id", F.col("specimen_id")))
    owner = f.select("event_id", "specimen_id", F.col("session_id"))
    each = careless.select("specimen_id", "window_no", F.explode("row_ids").alias("event_id")).join(owner.drop("specimen_id"), "event_id")
    bad = each.groupBy("specimen_id", "window_no").agg(F.count_distinct("session_id").alias("n")).where("n > 1")
    return bad.groupBy("specimen_id").agg(F.count("*").alias("n_bad_windows"))


@query(sql_cte(FRAME, FOLDS, WINDOWS, "SELECT f.fold_id, count(*) AS n_violations FROM win JOIN folds f USING (specimen_id) WHERE f.split <> 'train' AND specimen_id LIKE '%1' GROUP BY f.fold_id"))
def audit_split_membership(spark, sf_dir):
    """Windows of some specimens filed under training everywhere."""
    base = folds(spark, sf_dir)
    w = plain_windows(frame(spark, sf_dir)).join(base, "specimen_id")
    wrong = w.withColumn("split", F.when(F.col("specimen_id").endswith("1"), "train").otherwise(F.col("split")))
    return audits.split_membership_audit(wrong, base).groupBy("fold_id").agg(F.count("*").alias("n_violations"))


@query(sql_cte(FRAME, WINDOWS, """h AS (SELECT *, CASE WHEN (window_no // 4) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM win),
    e AS (SELECT split, unnest(row_ids) AS row_id FROM h)""", "SELECT 0 AS fold_id, row_id, count(DISTINCT split) AS n_splits FROM e GROUP BY row_id HAVING count(DISTINCT split) > 1"))
def row_reuse(spark, sf_dir):
    """A split by windows instead of specimens reuses rows on both sides."""
    naive = plain_windows(frame(spark, sf_dir)).withColumns({"split": F.when(F.floor(F.col("window_no") / 4) % 2 == 0, "train").otherwise("test"), "fold_id": F.lit(0)})
    return audits.row_reuse(naive)


@query(sql_cte(FRAME, FOLDS, """c AS (SELECT fold_id, split, l FROM (SELECT DISTINCT fold_id, split FROM folds), (SELECT unnest(range(6)) AS l)),
    s AS (SELECT DISTINCT fold_id, split, freshness_class AS l FROM frame JOIN folds USING (specimen_id))""",
    "SELECT fold_id, split, count(*) FILTER (s.l IS NULL)::INT AS n_absent, coalesce(string_agg(c.l::VARCHAR, ',' ORDER BY c.l) FILTER (s.l IS NULL), '') AS absent FROM c LEFT JOIN s USING (fold_id, split, l) GROUP BY fold_id, split"))
def class_coverage(spark, sf_dir):
    return audits.class_coverage(frame(spark, sf_dir), folds(spark, sf_dir), 6)


@query(sql_cte(FRAME, FOLDS, "SELECT fold_id, split, count(DISTINCT specimen_id) AS n_specimens, count(*) AS n_rows FROM frame JOIN folds USING (specimen_id) GROUP BY ALL"))
def leakage_report(spark, sf_dir):
    return audits.leakage_report(frame(spark, sf_dir), folds(spark, sf_dir))


@query(sql_cte(FRAME, """p AS (SELECT specimen_id, count(*) AS n, count(DISTINCT session_id) AS s FROM frame GROUP BY 1)""", "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_specimens, sum(s)::BIGINT AS n_sessions, min(n) AS min_rows, max(n) AS max_rows, quantile_cont(n::DOUBLE, 0.5) AS median_rows FROM p"))
def label_summary(spark, sf_dir):
    return frames.label_summary(frame(spark, sf_dir))


@query(sql_cte(FRAME, WINDOWS, "SELECT specimen_id, freshness_class AS label, count(*) AS n_windows FROM win GROUP BY ALL"))
def window_label_summary(spark, sf_dir):
    return plain_windows(frame(spark, sf_dir)).groupBy("specimen_id", "label").agg(F.count("*").alias("n_windows"))


@query(sql_cte(FRAME, "SELECT freshness_class, count(*) AS n_rows FROM frame GROUP BY 1"))
def class_counts(spark, sf_dir):
    return frames.class_counts(frame(spark, sf_dir))


@query(sql_cte(FRAME, "SELECT specimen_id, count(*) AS n_rows FROM frame GROUP BY 1 HAVING count(*) >= 66"))
def usable_specimens(spark, sf_dir):
    return frames.usable_specimens(frame(spark, sf_dir), 66)


@query(sql_cte(FRAME, """SELECT session_id, round(avg(s1), 6) AS mean, round(stddev_pop(s1), 6) AS std_pop, min(s1) AS min, max(s1) AS max, round(arg_max(s1, time_index) - arg_min(s1, time_index), 6) AS change FROM frame GROUP BY 1"""))
def window_features(spark, sf_dir):
    w = windows.window_features(frame(spark, sf_dir), "s1", ["session_id"], "time_index")
    return w.select("session_id", F.round("mean", 6).alias("mean"), F.round("std_pop", 6).alias("std_pop"), "min", "max", F.round("change", 6).alias("change"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '^(Supplier#0000000[0-4]).*$') THEN regexp_extract(s_name, '^(Supplier#0000000[0-4]).*$', 1) ELSE s_name END AS unit FROM supplier")
def unit_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", unit_id("s_name", r"^(Supplier#0000000[0-4]).*$").alias("unit"))


@query(sql_cte(FRAME, PLACED, f"SELECT specimen_id, pos, {DRAW.format(chr(39) + 'perm|7|' + chr(39) + ' || specimen_id')} AS h FROM placed WHERE pos < 10"))
def sample_specimens(spark, sf_dir):
    """Ten specimens without replacement, in a seeded order."""
    p = splits.permuted(frame(spark, sf_dir), SEED)
    return p.where("pos < 10").select("specimen_id", "pos", draw("perm", SEED, F.col("specimen_id")).alias("h"))
