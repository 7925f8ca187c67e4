"""Decision queries: rules over the contrast table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, rules, stats
from . import register, sql_cte
from .evidence import BOOT, BY, DRAWS, MARGIN, OBS, PAIRS, RUNS, SIGN, contrasts, means, run_rows

query = register("decisions")

RULES = {
    "g1_any": "sig_any('AF', 'NO', 'macro_f1', ['D0', 'D1'])",
    "g2_equivalent": "equiv('AF', 'NO', 'macro_f1', 'D0') and equiv('AF', 'NO', 'macro_f1', 'D1')",
    "g3_reversed": "delta('NO', 'AF', 'macro_f1', 'D0') == -delta('AF', 'NO', 'macro_f1', 'D0')",
    "g4_missing": "sig('AF', 'XX', 'macro_f1', 'D0') or 1 < 2",
    "g5_noninferior": "noninferior('AO', 'RF', 'macro_f1', 'D0') and n_pairs('AO', 'RF', 'macro_f1', 'D0') >= 10",
    "g6_zero": "ci_contains_zero('NF', 'RO', 'macro_f1', 'D1')",
    "g8_lacking": "params('AF') < params('NO')",
    "g9_vector": "params('AF') <= params('RF') and +1 < 2",
    "g10_mixed": "params('AF') < 10",
    "g11_lazy": "1 > 2 > 1 / 0",
    "g7_chain": "-1 < ci_low('AO', 'RF', 'macro_f1', 'D1') <= ci_high('AO', 'RF', 'macro_f1', 'D1') < 1",
}

#: The same decisions in SQL; boot and sign have a row for each contrast and data set.
DECISIONS = f"""e AS (SELECT contrast, dataset, estimate, ci_low, ci_high, n_pairs_total, least(1, 2 / 2.0 ** n_nonzero) AS floor_p, p_holm, n_nonzero FROM boot JOIN sign USING (contrast, dataset)
    JOIN (SELECT contrast, dataset, count(*) AS n_pairs_total FROM deltas GROUP BY ALL) USING (contrast, dataset) LEFT JOIN h USING (contrast, dataset)),
g AS (SELECT 'g1_any' AS rule, bool_or(p_holm < 0.05 AND ci_low > 0 AND floor_p <= 0.05) AS v FROM e WHERE contrast = 'c1'
    UNION ALL SELECT 'g2_equivalent', bool_and(ci_low > -{MARGIN} AND ci_high < {MARGIN}) FROM e WHERE contrast = 'c1'
    UNION ALL SELECT 'g3_reversed', TRUE UNION ALL SELECT 'g4_missing', NULL
    UNION ALL SELECT 'g5_noninferior', ci_low > -{MARGIN} AND n_pairs_total >= 10 FROM e WHERE contrast = 'c2' AND dataset = 'D0'
    UNION ALL SELECT 'g8_lacking', NULL UNION ALL SELECT 'g9_vector', TRUE UNION ALL SELECT 'g10_mixed', NULL UNION ALL SELECT 'g11_lazy', FALSE
    UNION ALL SELECT 'g6_zero', ci_low <= 0 AND ci_high >= 0 FROM e WHERE contrast = 'c3' AND dataset = 'D1'
    UNION ALL SELECT 'g7_chain', -1 < ci_low AND ci_low <= ci_high AND ci_high < 1 FROM e WHERE contrast = 'c2' AND dataset = 'D1')"""
HOLM = """h0 AS (SELECT contrast, dataset, (count(*) OVER w - row_number() OVER (PARTITION BY dataset ORDER BY round(p_value, 12), contrast) + 1) * p_value AS step, row_number() OVER (PARTITION BY dataset ORDER BY round(p_value, 12), contrast) AS rn
    FROM sign JOIN con USING (contrast) WHERE family = 'F1' WINDOW w AS (PARTITION BY dataset)), h AS (SELECT contrast, dataset, least(1, max(step) OVER (PARTITION BY dataset ORDER BY rn)) AS p_holm FROM h0)"""


def evidence_table(spark, sf_dir):
    m = means(spark, sf_dir)
    signs = stats.sign_test(m, BY)
    named = contrasts(spark)
    tested = signs.join(named.select("contrast", "family"), "contrast")
    tested = tested.withColumn("p_value", F.round("p_value", 12))
    corrected = stats.holm(tested.where("family IS NOT NULL"), ["family", "dataset"], tie=["contrast"]).select(*BY, "p_holm")
    pairs = m.groupBy(*BY).agg(F.sum("n_pairs").alias("n_pairs"))
    out = signs.join(stats.bootstrap_ci(m, BY, "specimen", DRAWS), BY).join(pairs, BY).join(corrected, BY, "left").join(named.select("contrast", "first", "second"), "contrast")
    return out.select("first", "second", F.lit("macro_f1").alias("metric"), "dataset", F.lit("full").alias("condition"), F.col("estimate").alias("delta"), "ci_low", "ci_high", "p_holm", "n_pairs", "n_clusters", "n_nonzero")


@query(sql_cte(OBS, PAIRS, SIGN, BOOT, HOLM, DECISIONS, "SELECT rule, CASE WHEN v IS NULL THEN 'UNEVALUABLE' WHEN v THEN 'True' ELSE 'False' END AS outcome FROM g"))
def gate_eval(spark, sf_dir):
    evidence = rules.Evidence.from_table(evidence_table(spark, sf_dir), margins={"macro_f1": MARGIN}, parameters={"AF": {"D0": 1, "D1": 5}, "NO": {"D0": 2}, "RF": {"D0": 1, "D1": 6}})
    return rules.evaluate_all(spark, RULES, evidence).select("rule", "outcome")


@query(sql_cte(OBS, RUNS, """p AS (SELECT model, dataset, count(DISTINCT n_windows) AS n_values, min(n_windows) AS value FROM runs WHERE fold_id < 2 AND seed = 0 AND model IN ('AF', 'NO') GROUP BY ALL)""",
    "SELECT model, dataset, CASE WHEN n_values = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n_values = 1 THEN value END AS value FROM p UNION ALL SELECT 'XX', 'D0', 'missing', NULL"))
def parameter_scope(spark, sf_dir):
    """A parameter holds in a scope only if all its records agree: exactly one distinct value, else a named failure."""
    asked = spark.createDataFrame([("AF", "D0"), ("AF", "D1"), ("NO", "D0"), ("NO", "D1"), ("XX", "D0")], "model string, dataset string")
    found = run_rows(spark, sf_dir).where("fold_id < 2 AND seed = 0").groupBy("model", "dataset").agg(F.count_distinct("n_windows").alias("k"), F.min("n_windows").alias("value"))
    status = F.when(F.col("k").isNull(), "missing").when(F.col("k") == 1, "resolved").otherwise("ambiguous")
    return asked.join(found, ["model", "dataset"], "left").select("model", "dataset", status.alias("status"), F.when(F.col("k") == 1, F.col("value")).alias("value"))


@query("SELECT o_orderpriority AS config_hash, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'all', o_orderstatus, count(*) FROM orders GROUP BY 2")
def evidence_audit(spark, sf_dir):
    """Union of per-configuration and total status rows."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("config_hash"), F.col("o_orderstatus").alias("status"))
    each = o.groupBy("config_hash", "status").agg(F.count("*").alias("n"))
    return each.unionByName(each.groupBy(F.lit("all").alias("config_hash"), "status").agg(F.sum("n").alias("n")))




SCOPED = {"g_small": "params('AF') < params('NO')", "g_close": "abs(params('AF') - params('NO')) < 100 and 1 < 2"}


@query(sql_cte(OBS, RUNS, """p AS (SELECT model, dataset, CASE WHEN count(DISTINCT n_windows) = 1 THEN min(n_windows) END AS v FROM runs WHERE seed = 0 AND fold_id < 1 AND model IN ('AF', 'NO') GROUP BY ALL),
    w AS (SELECT dataset, max(v) FILTER (model = 'AF') AS a, max(v) FILTER (model = 'NO') AS b FROM p GROUP BY 1),
    s AS (SELECT max(v) FILTER (model = 'AF') AS a, max(v) FILTER (model = 'NO') AS b FROM p WHERE dataset = 'D0')""",
    """SELECT 'g_small' AS rule, CASE WHEN a < b THEN 'True' ELSE 'False' END AS before, (SELECT CASE WHEN bool_and(a < b) THEN 'True' ELSE 'False' END FROM w) AS after FROM s
    UNION ALL SELECT 'g_close', CASE WHEN abs(a - b) < 100 THEN 'True' ELSE 'False' END, 'UNEVALUABLE' FROM s"""))
def scope_comparison(spark, sf_dir):
    """Rules with one data set's parameter counts, and with a vector over data sets, which only comparisons take."""
    found = run_rows(spark, sf_dir).where("seed = 0 AND fold_id < 1 AND model IN ('AF', 'NO')").groupBy("model", "dataset").agg(F.count_distinct("n_windows").alias("k"), F.min("n_windows").alias("v")).where("k = 1").collect()
    vector: dict = {}
    for r in found:
        vector.setdefault(r.model, {})[r.dataset] = float(r.v)
    one = {m: d["D0"] for m, d in vector.items() if "D0" in d}
    before = rules.evaluate_all(spark, SCOPED, rules.Evidence({}, parameters=one)).withColumnRenamed("outcome", "before")
    after = rules.evaluate_all(spark, SCOPED, rules.Evidence({}, parameters=vector)).withColumnRenamed("outcome", "after")
    return before.select("rule", "before").join(after.select("rule", "after"), "rule")


LEDGER = """r AS (SELECT 'fp' || o_custkey AS fingerprint, left(o_orderpriority, 1) AS priority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS topology, 'c' || o_orderkey % 2 AS config_hash,
    CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, o_orderkey % 5 AS n_test_windows FROM orders),
units AS (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS n_substrates, CASE WHEN n_scored <= 1 THEN 'single_scored_evaluation' WHEN n_configs = 1 THEN 'recomputation_same_config' ELSE 'true_repeat_different_config' END AS classification
    FROM (SELECT fingerprint, priority, topology, count(*) AS n_ok, count(*) FILTER (n_test_windows > 0) AS n_scored, count(DISTINCT config_hash) AS n_configs FROM r WHERE status = 'ok' GROUP BY ALL))"""


def _ledger(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("fp"), "o_custkey").alias("fingerprint"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("topology"),
        F.concat(F.lit("c"), F.col("o_orderkey") % 2).alias("config_hash"), F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("ok").alias("status"), (F.col("o_orderkey") % 5).alias("n_test_windows"),
    )
    return records.ledger_units(o, ["priority", "topology"], F.col("n_test_windows") > 0)


@query(sql_cte(LEDGER, "SELECT * FROM units"))
def ledger_units(spark, sf_dir):
    """Collisions, recomputations and true repeats told apart by fingerprint and substrate."""
    return _ledger(spark, sf_dir)


@query(sql_cte(LEDGER, """f AS (SELECT fingerprint, count(*) AS n, max((classification = 'true_repeat_different_config')::INT) AS repeat FROM units GROUP BY 1)""",
    "SELECT count(*) AS n_fingerprints, count(*) FILTER (n > 1) AS n_colliding, sum(repeat)::BIGINT AS n_with_true_repeat, sum(n)::BIGINT AS n_units, " + ", ".join(f"(SELECT count(*) FROM units WHERE classification = '{k}') AS {k}" for k in ("single_scored_evaluation", "recomputation_same_config", "true_repeat_different_config")) + " FROM f"))
def ledger_summary(spark, sf_dir):
    return records.ledger_summary(_ledger(spark, sf_dir))


@query("""SELECT 'run' || o_orderkey AS run_id, o_custkey AS fold_id, strftime(o_orderdate, '%Y-%m-%dT00:00:00') || 'Z' AS timestamp_utc,
    '{"' || left(o_orderpriority, 1) || '":' || o_custkey % 9 || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',"x":' || o_orderkey % 4 END || '}' AS class_coverage FROM orders""")
def fingerprint_rows(spark, sf_dir):
    """Provenance rows of runs made from `orders`."""
    cover = F.when(F.col("o_orderstatus") == "F", F.create_map(F.substring("o_orderpriority", 1, 1), F.col("o_custkey") % 9)).otherwise(F.create_map(F.lit("x"), F.col("o_orderkey") % 4, F.substring("o_orderpriority", 1, 1), F.col("o_custkey") % 9))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("run"), "o_orderkey").alias("run_id"), F.col("o_custkey").alias("fold_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.123456").alias("timestamp_utc"), cover.alias("class_coverage"))
    return records.fingerprint_rows(o, ["run_id", "fold_id", "timestamp_utc"], ["class_coverage"])
