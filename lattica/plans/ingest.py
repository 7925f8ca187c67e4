"""Ingestion and sink queries: files named by pattern, labels, scalers, folds and edges written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import map_label
from ..operators import frames, graph, splits, windows
from ..sources import files
from ..storage import materialise, shared_path
from . import register, sql_cte
from .network import RAW, edges, nodes
from .sensor import DRAW, FEATURES, FOLDS, FRAME, LENGTH, SEED, WINDOWS, K, folds, frame, plain_windows

query = register("ingest")


@query("SELECT 'n' || lpad(s_nationkey::VARCHAR, 2, '0') AS specimen, 'day' || (s_suppkey % 3 + 1) AS session, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY ALL")
def glob_scan(spark, sf_dir):
    """Files whose names give specimen and session; one is misnamed and known by an alias."""
    path = shared_path(spark, "glob")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_acctbal", F.format_string("n%02d", "s_nationkey").alias("nation"), (F.col("s_suppkey") % 3 + 1).alias("day"))
    s.withColumn("file", F.concat("nation", F.lit("_d"), "day")).repartition("file").write.partitionBy("file").option("header", True).csv(path)
    # a folder a file: the pattern is matched against names, so each folder's part is moved up under its key's name
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = fs.Path(path)
    system = root.getFileSystem(conf)
    for folder in [x.getPath() for x in system.listStatus(root) if x.isDirectory()]:
        key = folder.getName().removeprefix("file=")
        name = "typo_d1.csv" if key == "n03_d1" else f"{key}.csv"
        (part,) = [x.getPath() for x in system.listStatus(folder) if x.getPath().getName().startswith("part-")]
        system.rename(part, fs.Path(f"{path}/{name}"))
        system.delete(folder, True)
    here = system.exists(fs.Path(f"{path}/typo_d1.csv"))
    df = files.read_glob(spark, f"{path}/*.csv", r"(?P<specimen>n\d\d)_(?P<session>d\d)\.csv", {"typo_d1.csv": "n03_d1.csv"} if here else None)
    named = df.groupBy(F.col("series_specimen").alias("specimen"), F.replace("series_session", F.lit("d"), F.lit("day")).alias("session"))
    return named.agg(F.count("*").alias("n"), F.round(F.sum(F.col("s_acctbal").cast("double")), 2).alias("total"))


@query("SELECT o_orderstatus AS series, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row_index, o_orderkey FROM orders WHERE o_custkey % 10 = 3")
def row_index_scan(spark, sf_dir):
    """The place of each line in its file: a tenth of the customers' orders, a file for each status, sorted by key."""
    path = shared_path(spark, "rows")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 10 = 3").select("o_orderkey", "o_orderstatus")
    o.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").write.partitionBy("o_orderstatus").option("header", True).csv(path)
    rows = files.with_row_index(spark, [f"{path}/o_orderstatus=*"])
    return rows.select(F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("series"), "row_index", F.col("line").cast("bigint").alias("o_orderkey"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '3' THEN 1 ELSE 2 END AS freshness_class FROM orders")
def label_mapping(spark, sf_dir):
    """Label texts with other case and blanks around them, mapped to classes; one that isn't known would be an error."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" "))
    classes = {"1-URGENT": 0, " 2-high ": 0, "3-Medium": 1, "4-NOT SPECIFIED": 2, "5-Low": 2}
    return o.select("o_orderkey", map_label(text, classes).alias("freshness_class"))


@query("SELECT l_linenumber::INT - 2 AS freshness_class, count(*) AS n FROM lineitem WHERE l_linenumber - 2 < 0 OR l_linenumber - 2 >= 4 GROUP BY 1")
def label_range(spark, sf_dir):
    """Labels outside the declared classes, with their rows."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return frames.label_range_violations(li.select((F.col("l_linenumber") - 2).cast("int").alias("freshness_class")), 4)


@query(sql_cte(FRAME, FOLDS, "SELECT fold_id, count(*) AS n_fit_rows, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}) + 1e-8, 6) AS {c}_std" for c in FEATURES) + " FROM frame JOIN folds USING (specimen_id) WHERE split = 'train' GROUP BY fold_id"))
def scaler_round_trip(spark, sf_dir):
    """Each fold's scaler, written and read back with its columns and types checked."""
    path = shared_path(spark, "scalers")
    files.write_scalers(windows.fold_scalers(frame(spark, sf_dir), folds(spark, sf_dir), FEATURES), path)
    s = files.read_scalers(spark, path, FEATURES, ["fold_id"])
    return s.select("fold_id", "n_fit_rows", *[F.round(c, 6).alias(c) for c in s.columns if c.endswith(("_mean", "_std"))])


@query(sql_cte(FRAME, FOLDS, "SELECT fold_id, event_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM frame JOIN folds USING (specimen_id)"))
def inverse_standardise(spark, sf_dir):
    """Standardised rows of every fold, brought back to the sensors' units."""
    f, d = frame(spark, sf_dir), folds(spark, sf_dir)
    s = windows.fold_scalers(f, d, FEATURES)
    rows = windows.standardise(f.join(d, "specimen_id"), s, FEATURES, ["fold_id"])
    back = windows.unstandardise(rows, s, FEATURES, ["fold_id"])
    return back.select("fold_id", "event_id", *[F.round(c, 6).alias(c) for c in FEATURES])


@query(sql_cte(FRAME, FOLDS, "SELECT fold_id, split, count(*) AS n, count(DISTINCT specimen_id) AS n_specimens, round(sum(s1), 4) AS s1 FROM frame JOIN folds USING (specimen_id) GROUP BY ALL"))
def fold_round_trip(spark, sf_dir):
    """The frame by fold and split, a folder each, written and read back."""
    path = shared_path(spark, "folds")
    files.write_folds(frame(spark, sf_dir).join(folds(spark, sf_dir), "specimen_id"), path)
    back = spark.read.parquet(path)
    return back.groupBy("fold_id", "split").agg(F.count("*").alias("n"), F.count_distinct("specimen_id").alias("n_specimens"), F.round(F.sum("s1"), 4).alias("s1"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY ALL")
def edge_round_trip(spark, sf_dir):
    """The contact graph of all rows, written and read back."""
    path = shared_path(spark, "edges")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    files.write_edges(graph.aggregate_edges(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))), path)
    return spark.read.parquet(path)


@query(sql_cte(FRAME, WINDOWS, f"SELECT specimen_id, session_id, (window_no // {LENGTH // 2})::INT AS window_no, len(flatten(x)) AS n_values, round(list_sum(list_transform(flatten(x), lambda v, i: v * i)), 4) AS weighted FROM win WHERE window_no % {LENGTH // 2} = 0"))
def flat_windows(spark, sf_dir):
    """Windows as flat vectors, time first; each value weighted by its place, so that the order shows."""
    w = plain_windows(frame(spark, sf_dir), stride=LENGTH // 2)
    flat = F.flatten("x")
    weighted = F.aggregate(F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return w.select("specimen_id", "session_id", "window_no", F.size(flat).cast("bigint").alias("n_values"), F.round(weighted, 4).alias("weighted"))


@query(sql_cte(FRAME, f"h AS (SELECT specimen_id, row_number() OVER (ORDER BY {DRAW.format(repr(f'perm|{SEED}|') + ' || specimen_id')}, specimen_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT specimen_id FROM frame))",
    f"t AS (SELECT 'group_kfold' AS strategy, fold_id::INT AS fold_id, count(*) AS n_test FROM (SELECT CASE WHEN pos < (n % {K}) * (n // {K} + 1) THEN pos // (n // {K} + 1) ELSE (n % {K}) + (pos - (n % {K}) * (n // {K} + 1)) // greatest(n // {K}, 1) END AS fold_id FROM h) GROUP BY ALL)",
    "l AS (SELECT 'loso' AS strategy, pos::INT AS fold_id, 1::BIGINT AS n_test FROM h)", f"b AS (SELECT 'time_block_holdout' AS strategy, fold_id, n_test FROM t)", "SELECT * FROM t UNION ALL SELECT * FROM l UNION ALL SELECT * FROM b"))
def split_strategies(spark, sf_dir):
    """Test specimens of each fold under each strategy, by name."""
    ids, out = materialise(frame(spark, sf_dir).select("specimen_id").distinct(), "specimens"), None
    for name, options in (("group_kfold", {"k": K, "seed": SEED}), ("loso", {"seed": SEED}), ("time_block_holdout", {"k": K})):
        made = splits.make_folds(name, ids, **options).where("split = 'test'")
        one = made.groupBy("fold_id").agg(F.count("*").alias("n_test")).select(F.lit(name).alias("strategy"), "fold_id", "n_test")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql_cte(RAW, "signed AS (SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN -w WHEN src % 7 = 2 THEN 0 ELSE w END AS w FROM edges)", "SELECT src, dst, round(coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY src), 0), 0) * 0.75, 8) AS w FROM signed"))
def absolute_row_norms(spark, sf_dir):
    """Signed weights over the absolute sums of their rows, at a scale that is given."""
    signed = F.when((F.col("src") + F.col("dst")) % 3 == 0, -F.col("w")).when(F.col("src") % 7 == 2, 0).otherwise(F.col("w"))
    return graph.absolute_norm(edges(spark, sf_dir).withColumn("w", signed), 0.75).select("src", "dst", F.round("w", 8).alias("w"))


@query("WITH RECURSIVE " + sql_cte(RAW, """sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    p(step, id, x, norm) AS (SELECT 0, src, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM sym)
        UNION ALL SELECT step + 1, dst, s / norm, norm FROM (SELECT step, dst, sum(x) AS s, sqrt(sum(sum(x) * sum(x)) OVER ()) AS norm FROM p JOIN sym ON sym.src = p.id WHERE step < 60 GROUP BY step, dst))""",
    "SELECT src, dst, round(0.9 / (SELECT max(norm) FROM p WHERE step = 60) * w, 8) AS w FROM edges").removeprefix("WITH "))
def rescaled_edges(spark, sf_dir):
    """Weights scaled so that the binary, symmetrised graph's radius would be 0.9."""
    e = materialise(edges(spark, sf_dir), "edges")
    return graph.rescaled(e, graph.spectral_radius(e), 0.9).select("src", "dst", F.round("w", 8).alias("w"))


DRAWS = 20


@query("WITH RECURSIVE " + sql_cte(RAW, "el AS (SELECT src, dst FROM edges WHERE src <> dst)", "pick AS (SELECT -1 AS b, id FROM nodes WHERE id % 4 = 1)",
    f"draws AS (SELECT b, id FROM (SELECT b, id, row_number() OVER (PARTITION BY b ORDER BY ('0x' || substr(md5('select|9|' || b || '|' || id), 1, 8))::BIGINT, id) AS r FROM nodes, (SELECT unnest(range({DRAWS})) AS b)) WHERE r <= (SELECT count(*) FROM pick))",
    "every AS (SELECT * FROM pick UNION ALL SELECT * FROM draws)", "ins AS (SELECT a.b, src, dst FROM el JOIN every a ON a.id = src JOIN every c ON c.id = dst AND c.b = a.b)",
    "u AS (SELECT b, src AS x, dst AS y FROM ins UNION SELECT b, dst, src FROM ins)", "reach(b, id, label) AS (SELECT b, id, id FROM every UNION SELECT r.b, u.y, r.label FROM reach r JOIN u ON u.b = r.b AND u.x = r.id)",
    "parts AS (SELECT b, count(DISTINCT label) AS n FROM (SELECT b, id, min(label) AS label FROM reach GROUP BY ALL) GROUP BY 1)", "kept AS (SELECT e.b, count(i.src) AS n FROM (SELECT DISTINCT b FROM every) e LEFT JOIN ins i USING (b) GROUP BY 1)",
    "m AS (SELECT b, k.n / (SELECT count(*) FROM el) AS share, p.n AS parts FROM kept k JOIN parts p USING (b))",
    "SELECT round(max(share) FILTER (b = -1), 8) AS retention, max(parts) FILTER (b = -1) AS n_components, round(avg(share) FILTER (b >= 0), 8) AS random_retention, round(avg(parts) FILTER (b >= 0), 8) AS random_components, round(avg((share <= (SELECT share FROM m WHERE b = -1))::INT) FILTER (b >= 0), 8) AS percentile FROM m").removeprefix("WITH "))
def selection_against_random(spark, sf_dir):
    """A selection's retained edges and components, beside 20 random selections of its size: all from one pass."""
    n = nodes(spark)
    found = graph.selection_against_random(edges(spark, sf_dir), n, n.where("id % 4 = 1"), DRAWS, 9)
    return found.select(*[F.round(c, 8).alias(c) if c != "n_components" else F.col(c) for c in found.columns])
