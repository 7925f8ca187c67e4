"""Metric queries: a nearest-centroid predictor on the canonical frame, fitted on each fold's training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import metric_value, p_text, pick_evenly, softmax
from ..operators import metrics
from . import register, sql_cte
from .sensor import FOLDS, FRAME, folds, frame

query = register("scores")
N = 4

CENTROIDS = """cen AS (SELECT fold_id, freshness_class AS label, avg(s2) AS c FROM frame JOIN folds USING (specimen_id) WHERE split = 'train' GROUP BY ALL),
scored AS (SELECT f.fold_id, event_id, freshness_class AS truth, tvc AS target, s3, label, -abs(s2 - c) AS score FROM frame JOIN folds f USING (specimen_id) JOIN cen USING (fold_id) WHERE f.split = 'test'),
pred AS (SELECT fold_id, event_id, any_value(truth) AS truth, any_value(target) AS target, any_value(s3) AS s3, arg_max(label, score) AS predicted FROM scored GROUP BY fold_id, event_id)"""


def scored(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir).join(folds(spark, sf_dir), "specimen_id")
    centroids = rows.where("split = 'train'").groupBy("fold_id", F.col("freshness_class").alias("label")).agg(F.avg("s2").alias("c"))
    test = rows.where("split = 'test'").select("fold_id", "event_id", F.col("freshness_class").alias("truth"), F.col("tvc").alias("target"), "s2", "s3")
    return test.join(centroids, "fold_id").withColumn("score", -F.abs(F.col("s2") - F.col("c"))).drop("s2", "c")


def predictions(spark, sf_dir) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.groupBy("fold_id", "event_id").agg(F.first("truth").alias("truth"), F.first("target").alias("target"), F.first("s3").alias("s3"), F.max_by("label", "score").alias("predicted"))


CM = """cm AS (SELECT fold_id, truth, predicted, count(*) AS n FROM pred GROUP BY ALL),
pc AS (SELECT f.fold_id, l.label, coalesce((SELECT sum(n) FROM cm WHERE cm.fold_id = f.fold_id AND truth = l.label), 0)::BIGINT AS support,
    coalesce((SELECT sum(n) FROM cm WHERE cm.fold_id = f.fold_id AND predicted = l.label), 0)::BIGINT AS n_predicted,
    coalesce((SELECT sum(n) FROM cm WHERE cm.fold_id = f.fold_id AND predicted = l.label AND truth = l.label), 0)::BIGINT AS tp
    FROM (SELECT DISTINCT fold_id FROM pred) f, (SELECT unnest(range(4))::INT AS label) l)"""
F1 = "coalesce(2 * tp / nullif(support + n_predicted, 0), 0)"


@query(sql_cte(FRAME, FOLDS, CENTROIDS, "SELECT fold_id, truth, predicted, count(*) AS n FROM pred GROUP BY ALL"))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["fold_id"])


@query(sql_cte(FRAME, FOLDS, CENTROIDS, CM, f"SELECT fold_id, label, support, n_predicted, tp, round(coalesce(tp / nullif(n_predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round({F1}, 6) AS f1 FROM pc"))
def per_class_metrics(spark, sf_dir):
    c = metrics.per_class(predictions(spark, sf_dir), N, ["fold_id"])
    return c.select("fold_id", "label", "support", "n_predicted", "tp", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(sql_cte(FRAME, FOLDS, CENTROIDS, CM, f"""SELECT fold_id, round(avg({F1}), 6) AS macro_f1, round(avg({F1}) FILTER (support + n_predicted > 0), 6) AS macro_f1_present,
    round(avg(tp / support) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(tp) / sum(support), 6) AS accuracy, sum(support)::BIGINT AS n FROM pc GROUP BY fold_id"""))
def classification_metrics(spark, sf_dir):
    m = metrics.classification(predictions(spark, sf_dir), N, ["fold_id"])
    return m.select("fold_id", *[F.round(x, 6).alias(x) for x in ("macro_f1", "macro_f1_present", "balanced_accuracy", "accuracy")], "n")


@query(sql_cte(FRAME, FOLDS, CENTROIDS, CM, f"""pooled AS (SELECT label, sum(support) AS support, sum(n_predicted) AS n_predicted, sum(tp) AS tp FROM pc GROUP BY 1)""",
    f"""SELECT round(p.f, 6) AS pooled_macro_f1, round(m.f, 6) AS mean_fold_macro_f1, round(m.f - p.f, 6) AS gap FROM (SELECT avg({F1}) AS f FROM pooled) p, (SELECT avg(f) AS f FROM (SELECT fold_id, avg({F1}) AS f FROM pc GROUP BY 1)) m"""))
def pooled_oof_metrics(spark, sf_dir):
    """F1 of pooled out-of-fold predictions against the folds' mean."""
    p = predictions(spark, sf_dir)
    pooled = metrics.classification(p, N).select(F.col("macro_f1").alias("p"))
    mean = metrics.classification(p, N, ["fold_id"]).agg(F.avg("macro_f1").alias("m"))
    return pooled.crossJoin(mean).select(F.round("p", 6).alias("pooled_macro_f1"), F.round("m", 6).alias("mean_fold_macro_f1"), F.round(F.col("m") - F.col("p"), 6).alias("gap"))


@query(sql_cte(FRAME, FOLDS, CENTROIDS, """r AS (SELECT fold_id, label, truth = label AS pos, rank() OVER (PARTITION BY fold_id, label ORDER BY score) + (count(*) OVER (PARTITION BY fold_id, label, score) - 1) / 2 AS rk FROM scored),
    a AS (SELECT fold_id, label, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM r GROUP BY ALL)""",
    "SELECT fold_id, round(CASE WHEN count(auc) = 4 THEN avg(auc) END, 6) AS auroc, count(auc) AS n_classes_scored FROM a GROUP BY fold_id"))
def auroc_one_vs_rest(spark, sf_dir):
    return metrics.auroc_ovr(scored(spark, sf_dir), N, ["fold_id"]).select("fold_id", F.round("auroc", 6).alias("auroc"), "n_classes_scored")


@query(sql_cte(FRAME, FOLDS, CENTROIDS, """e AS (SELECT fold_id, target, s3 / 20 AS estimate FROM pred)""", """SELECT fold_id, round(avg(abs(target - estimate)), 6) AS mae, round(sqrt(avg((target - estimate) ** 2)), 6) AS rmse,
    round(1 - sum((target - estimate) ** 2) / (var_pop(target) * count(*)), 6) AS r2, count(*) AS n FROM e GROUP BY fold_id"""))
def regression_metrics(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("estimate", F.col("s3") / 20)
    return metrics.regression(p, ["fold_id"]).select("fold_id", *[F.round(x, 6).alias(x) for x in ("mae", "rmse", "r2")], "n")


@query(sql_cte(FRAME, FOLDS, CENTROIDS, "SELECT greatest(max(truth), max(predicted)) + 1 AS n_classes FROM pred"))
def observed_classes(spark, sf_dir):
    return metrics.observed_classes(predictions(spark, sf_dir))


@query(sql_cte(FRAME, FOLDS, CENTROIDS, "s AS (SELECT fold_id, event_id, label, exp(score - max(score) OVER (PARTITION BY fold_id, event_id)) AS e FROM scored)", "SELECT fold_id, event_id, label, round(e / sum(e) OVER (PARTITION BY fold_id, event_id), 6) AS p FROM s"))
def softmax_scores(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("fold_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("a"))
    p = s.withColumn("p", softmax(F.transform("a", lambda x: x["score"])))
    each = p.select("fold_id", "event_id", F.explode(F.arrays_zip(F.col("a.label").alias("label"), "p")).alias("z"))
    return each.select("fold_id", "event_id", F.col("z.label").alias("label"), F.round("z.p", 6).alias("p"))


@query(sql_cte("""v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'x' || l_quantity WHEN l_linenumber = 2 THEN 'NaN' WHEN l_linenumber = 3 THEN '' ELSE l_discount::VARCHAR END AS t FROM lineitem)""",
    "SELECT l_linenumber, count(*) AS n, count(d) AS n_numbers, round(sum(d), 4) AS total FROM (SELECT *, CASE WHEN isfinite(try_cast(t AS DOUBLE)) THEN try_cast(t AS DOUBLE) END AS d FROM v) GROUP BY 1"))
def metric_coercion(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    t = F.when(n == 1, F.concat(F.lit("x"), "l_quantity")).when(n == 2, "NaN").when(n == 3, "").otherwise(F.col("l_discount").cast("string"))
    return li.withColumn("d", metric_value(t)).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("d").alias("n_numbers"), F.round(F.sum("d"), 4).alias("total"))


@query("""SELECT p_size, CASE WHEN p_size = 50 THEN 'n/a' WHEN p_size = 1 THEN '<1e-12' ELSE printf('%.6g', p_size / 77 / p_size ** 5) END AS p_text FROM (SELECT DISTINCT p_size FROM part)""")
def p_value_text(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct()
    p = F.when(F.col("p_size") == 50, float("nan")).when(F.col("p_size") == 1, 1e-13).otherwise(F.col("p_size") / 77 / F.pow("p_size", F.lit(5)))
    return sizes.select("p_size", p_text(p).alias("p_text"))


@query(sql_cte(FRAME, "g AS (SELECT session_id, list(s1 ORDER BY time_index, event_id) AS v FROM frame GROUP BY 1)", "SELECT session_id, " + ", ".join(f"v[floor({i} * (len(v) - 1) / 4)::INT + 1] AS v{i}" for i in range(5)) + " FROM g"))
def temporal_downsample(spark, sf_dir):
    ordered = frame(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("time_index", "event_id", "s1"))).alias("a"))
    picked = pick_evenly(F.col("a.s1"), F.size("a"), 5)
    return ordered.select("session_id", *[picked[i].alias(f"v{i}") for i in range(5)])
