"""Model queries: reservoirs, readouts, trees and selection over the canonical windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, models, reservoir, robustness
from ..operators.ordering import in_file_order
from ..storage import materialise
from . import benchmark, register, sql_cte
from .network import edges, nodes
from .sensor import FEATURES, FRAME, LENGTH, ORDER, folds, frame

query = register("learning")


def fold_windows(spark, sf_dir, fold: int = 0) -> DataFrame:
    """One fold's windows, standardised by its training rows."""
    return benchmark.fold_windows(frame(spark, sf_dir), folds(spark, sf_dir), fold, FEATURES, LENGTH, 4, ORDER)


@query()
def reservoir_states(spark, sf_dir):
    w = fold_windows(spark, sf_dir)
    s = reservoir.window_states(w, reservoir.random_reservoir(len(FEATURES), 1, reservoir_size=50), ["split", "specimen_id", "session_id", "window_no"])
    return s.select("split", "specimen_id", "session_id", "window_no", F.round(F.aggregate("state", F.lit(0.0), lambda a, x: a + x), 6).alias("state_sum"))


def _scored(model: models.Model, w: DataFrame) -> DataFrame:
    done = model.fit(w.where("split = 'train'")).predict(w.where("split = 'test'"))
    if model.task == models.CLASSIFICATION:
        return done.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("recall"))
    return done.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mae"))


@query()
def ridge_readout(spark, sf_dir):
    r = reservoir.random_reservoir(len(FEATURES), 1, reservoir_size=50)
    return _scored(models.ReservoirModel("esn", models.CLASSIFICATION, r), fold_windows(spark, sf_dir))


@query()
def forest_predictions(spark, sf_dir):
    """50 trees of depth 5: the query's parameters."""
    return _scored(models.build_model("random_forest", models.CLASSIFICATION, n_estimators=50, max_depth=5), materialise(fold_windows(spark, sf_dir), "windows"))


@query()
def kernel_regression(spark, sf_dir):
    return _scored(models.build_model("svm_rbf", models.REGRESSION), materialise(fold_windows(spark, sf_dir), "windows"))


@query()
def graph_reservoir_audit(spark, sf_dir):
    """Criteria A1 and A3 to A5 of the graph's reservoir."""
    e, chosen = edges(spark, sf_dir), nodes(spark)
    sub = graph.induced(e, chosen)
    labels = graph.strong_components(sub)
    top = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    r = reservoir.from_edges(e, chosen, 3)
    rows = reservoir.audit(r.a, r.w_in, top / max(1, len(r.a)))
    return spark.createDataFrame([(c, s, None if v is None else float(v), float(t)) for c, s, v, t in rows], "criterion string, state string, value double, threshold double")


@query()
def krylov_rank(spark, sf_dir):
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), 3)
    return spark.createDataFrame([(float(reservoir.krylov_rank(r.a, r.w_in)), float(reservoir.controllability_rank(r.a, r.w_in)), float(reservoir.henrici(r.a)))], "krylov double, controllability double, henrici double")


@query()
def rewire_invariants(spark, sf_dir):
    """Degrees and each source's weights before and after a weight-preserving rewire of the graph."""
    sub = graph.induced(edges(spark, sf_dir), nodes(spark)).orderBy("src", "dst").toPandas()
    src, dst, w = reservoir.rewired(sub.src.to_numpy(), sub.dst.to_numpy(), sub.w.to_numpy(), 4 * len(sub), 3)
    after = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(src, dst, w, strict=True)], "src bigint, dst bigint, w bigint")
    before = spark.createDataFrame(sub)
    a, b = graph.multiset_hash(before), graph.multiset_hash(after).withColumnRenamed("digest", "after")
    kept = a.join(b, "src").agg(F.bool_and(F.col("digest") == F.col("after")).alias("source_weights_kept"), F.count("*").alias("n_sources"))
    error = graph.in_strength_error(before, after).select(F.col("max").alias("max_in_strength_error"))
    share = graph.edge_overlap(before, after).select(F.col("share").alias("edges_in_place"))
    return kept.crossJoin(error).crossJoin(share)


@query()
def ensemble_percentile(spark, sf_dir):
    """Where the graph's Krylov rank lies among random graphs of its size."""
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), 3)
    n, m = len(r.a), int((r.a != 0).sum())

    def scores(batches):
        for b in batches:
            out = []
            for seed in b["seed"]:
                s, d = reservoir.random_graph(n, m, int(seed))
                a = np.zeros((n, n))
                a[d, s] = np.random.default_rng(seed).uniform(-1, 1, len(s))
                out.append(float(reservoir.krylov_rank(reservoir.scaled(a, 0.9), r.w_in)))
            yield b.assign(score=out)

    null = spark.range(40).select(F.col("id").alias("seed")).mapInPandas(scores, "seed bigint, score double")
    real = float(reservoir.krylov_rank(r.a, r.w_in))
    return null.agg(F.avg((F.col("score") <= real).cast("double")).alias("percentile"), F.avg("score").alias("null_mean"), F.stddev_samp("score").alias("null_sd")).withColumn("score", F.lit(real))


@query(sql_cte(FRAME, "l AS (SELECT session_id, s1, " + ", ".join(f"lead(s3, {k}) OVER w AS x{k}" for k in (1, 4)) + " FROM frame WINDOW w AS (PARTITION BY session_id ORDER BY time_index, event_id))", " UNION ALL ".join(f"SELECT session_id, {k} AS lag, round(coalesce(CASE WHEN isnan(abs(corr(s1, x{k}))) THEN 0 ELSE abs(corr(s1, x{k})) END, 0), 6) AS mean_abs_corr FROM l GROUP BY 1" for k in (1, 4))))
def lead_correlation(spark, sf_dir):
    c = reservoir.lead_correlation(frame(spark, sf_dir), ["session_id"], list(ORDER), "s1", ["s3"], (1, 4))
    return c.withColumn("mean_abs_corr", F.round("mean_abs_corr", 6))


@query("""WITH s AS (SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE round(avg(l_discount), 3) END AS score FROM lineitem GROUP BY l_suppkey, l_linenumber)
    SELECT l_suppkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY isnan(score), score DESC, l_linenumber) AS r FROM s) WHERE r = 1""")
def first_best(spark, sf_dir):
    """Averages lie at halves of a thousandth, where their rounding shows the order of their sums: it is that of the rows.
    The SQL rounds the average times 1000, whose last bit may be lost at a half; Spark's round alone takes the decimal digits.
    A supplier without a score keeps its row."""
    li = in_file_order(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_discount"))
    inside = F.array_sort(F.collect_list(F.when(F.col("l_discount").isNotNull(), F.struct("_at", "l_discount"))))
    g = li.groupBy("l_suppkey", "l_linenumber").agg(inside.alias("d"))
    average = F.try_divide(F.aggregate("d", F.lit(0.0), lambda a, x: a + x["l_discount"]), F.size("d"))
    s = g.select("l_suppkey", "l_linenumber", (F.round(average * 1000) / 1000).alias("score"))
    s = s.withColumn("score", F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("score")))
    return models.first_best(s, ["l_suppkey"], "score", "l_linenumber", all_groups=True)


@query("""WITH m AS (SELECT list_sort(['boosted_trees', 'esn', 'pca_svm', 'random_forest', 'svm_rbf', 'cnn1d', 'gru', 'lstm', 'tcn', 'mlp']) AS names), r AS (SELECT names[o_custkey % 10 + 1] AS model, o_orderstatus AS dataset FROM orders, m)
    SELECT dataset, model, count(*) AS n_runs, CASE WHEN model IN ('cnn1d', 'gru', 'lstm', 'tcn') THEN 'needs a deep-learning library that isn''t installed' WHEN model = 'mlp' THEN 'unknown' ELSE 'available' END AS status FROM r GROUP BY ALL""")
def model_availability(spark, sf_dir):
    """Runs that are asked for (here by orders), by data set and model, with the registry's word on each."""
    known = models.availability()
    names = F.array(*[F.lit(n) for n in sorted([*known, "mlp"])])
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("dataset"), F.get(names, (F.col("o_custkey") % 10).cast("int")).alias("model"))
    table = F.broadcast(spark.createDataFrame(sorted(known.items()), "model string, status string"))
    asked = runs.groupBy("dataset", "model").agg(F.count("*").alias("n_runs")).join(table, "model", "left")
    return asked.select("dataset", "model", "n_runs", F.coalesce("status", F.lit("unknown")).alias("status"))


_MASK = "CASE WHEN ('0x' || substr(md5('drop|4|{c}|' || event_id), 1, 8))::BIGINT < 858993459 THEN 0 ELSE {c} END"


@query(sql_cte(FRAME, "SELECT event_id, " + ", ".join(f"round({_MASK.format(c=c)} * 1.1 + 0.5, 6) AS {c}" for c in FEATURES) + " FROM frame"))
def perturbed_channels(spark, sf_dir):
    """Channel dropout in a fifth of the rows, then gain and offset drift."""
    f = models.drifted(models.masked_channels(frame(spark, sf_dir), FEATURES, 0.2, 4), FEATURES, 1.1, 0.5)
    return f.select("event_id", *[F.round(c, 6).alias(c) for c in FEATURES])


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_Q = "sqrt(-2 * ln(least(u, 1 - u)))"
_TAIL = f"{_horner(robustness.TAIL_TOP, _Q)} / {_horner(robustness.TAIL_BELOW, _Q)}"
_CENTRE = f"(u - 0.5) * {_horner(robustness.CENTRE_TOP, '((u - 0.5) * (u - 0.5))')} / {_horner(robustness.CENTRE_BELOW, '((u - 0.5) * (u - 0.5))')}"
_NORMAL = f"(SELECT CASE WHEN u < {robustness.TAIL} THEN {_TAIL} WHEN u > 1 - {robustness.TAIL} THEN -({_TAIL}) ELSE {_CENTRE} END FROM (SELECT (('0x' || substr(md5('noise|5|{{c}}|' || event_id), 1, 8))::BIGINT + 0.5) / 4294967296 AS u))"


@query(sql_cte(FRAME, "n AS (SELECT event_id, " + ", ".join(f"{c} + 0.1 * {_NORMAL.format(c=c)} AS {c}" for c in FEATURES) + " FROM frame)",
    "SELECT event_id, ablated, " + ", ".join(f"round(CASE WHEN ablated = '{c}' THEN 0 ELSE {c} END, 6) AS {c}" for c in FEATURES) + f" FROM n, (SELECT unnest({['none', *FEATURES]}) AS ablated)"))
def noisy_channels(spark, sf_dir):
    """Gaussian noise of a tenth of a deviation, then each channel switched off in turn."""
    f = robustness.ablations(robustness.noisy(frame(spark, sf_dir), FEATURES, 0.1, 5, "event_id"), FEATURES)
    return f.select("event_id", "ablated", *[F.round(c, 6).alias(c) for c in FEATURES])
