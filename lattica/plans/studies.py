"""Study queries: compositions of the operators that experiments and audits are made of."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..operators import graph, models, reservoir, studies, windows
from . import benchmark, register, sql_cte
from .evidence import BY, deltas
from .network import CLASSES, CLASSED, GROW, RAW, STRENGTH, SUPPLY, WEAK, classes, edges, nodes, raw, supply
from .scores import CENTROIDS, predictions
from .sensor import FEATURES, FOLDS, FRAME, ORDER, SEED, folds, frame

query = register("studies")
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query()
def signed_rank(spark, sf_dir):
    """Exact tails need a recurrence; tests hold them against enumeration."""
    return studies.signed_rank_tests(deltas(spark, sf_dir), BY)


@query(sql_cte(FRAME, FOLDS, CENTROIDS, "p AS (SELECT truth, predicted, specimen_id FROM pred JOIN frame USING (event_id))", """u AS (SELECT specimen_id, row_number() OVER (ORDER BY specimen_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT specimen_id FROM p)),
    k AS (SELECT b, ('0x' || substr(md5('11|' || b || '|' || j), 1, 8))::BIGINT % n AS place FROM (SELECT unnest(range(60)) AS b), (SELECT unnest(range(max(n))) AS j, max(n) AS n FROM u)),
    r AS (SELECT b, truth, predicted FROM k JOIN u USING (place) JOIN p USING (specimen_id)),
    c AS (SELECT b, l, count(*) FILTER (truth = l) AS support, count(*) FILTER (predicted = l) AS named, count(*) FILTER (truth = l AND predicted = l) AS tp FROM r, (SELECT unnest(range(4)) AS l) GROUP BY ALL),
    f AS (SELECT b, sum(coalesce(2 * tp / nullif(support + named, 0), 0)) / 4 AS f1 FROM c GROUP BY b)""", "SELECT round(avg(f1), 7) AS mean, round(quantile_cont(f1, 0.025), 7) AS ci_low, round(quantile_cont(f1, 0.975), 7) AS ci_high FROM f"))
def unit_bootstrap_f1(spark, sf_dir):
    p = predictions(spark, sf_dir).join(frame(spark, sf_dir).select("event_id", "specimen_id"), "event_id")
    return studies.unit_bootstrap_f1(p, "specimen_id", 4, 60, 11).select(*[F.round(c, 7).alias(c) for c in ("mean", "ci_low", "ci_high")])


def _inflation_sql(fold: str, name: str) -> str:
    return f"""{name}_c AS (SELECT t.f, x.freshness_class AS k, avg(x.s1) AS c FROM (SELECT DISTINCT {fold} AS f FROM keyed) t JOIN keyed x ON x.{fold} <> t.f GROUP BY ALL),
{name}_p AS (SELECT event_id, any_value(freshness_class) AS truth, arg_min(k, (round(abs(s1 - c), 9), k)) AS predicted FROM keyed JOIN {name}_c ON {name}_c.f = keyed.{fold} GROUP BY event_id),
{name}_f AS (SELECT sum(coalesce(2 * tp / nullif(a + b, 0), 0)) / 4 AS f1 FROM (SELECT l, count(*) FILTER (truth = l) AS a, count(*) FILTER (predicted = l) AS b, count(*) FILTER (truth = l AND predicted = l) AS tp FROM {name}_p, (SELECT unnest(range(4)) AS l) GROUP BY l))"""


@query(sql_cte(FRAME, FOLDS, f"keyed AS (SELECT frame.*, fold_id AS g, {DRAW.format(chr(39) + 'naive|7|' + chr(39) + ' || event_id')} % 5 AS nv FROM frame JOIN folds USING (specimen_id) WHERE split = 'test')", _inflation_sql("g", "grp"), _inflation_sql("nv", "nai"), "SELECT round(grp_f.f1, 7) AS grouped_f1, round(nai_f.f1, 7) AS naive_f1, round(nai_f.f1 - grp_f.f1, 7) AS inflation FROM grp_f, nai_f"))
def leakage_inflation(spark, sf_dir):
    """What folds by row instead of by specimen add to a score."""
    rows = frame(spark, sf_dir).join(folds(spark, sf_dir).where("split = 'test'").select("specimen_id", F.col("fold_id").alias("g")), "specimen_id")
    rows = rows.withColumn("nv", draw("naive", SEED, F.col("event_id")) % 5)
    return studies.leakage_inflation(rows, "s1", 4, "g", "nv").select(*[F.round(c, 7).alias(c) for c in ("grouped_f1", "naive_f1", "inflation")])


@query("""SELECT l_linenumber AS dataset, count(*) AS n_rows, CASE WHEN count(*) < 8000 THEN 'too_small' WHEN max(l_discount) > 0.1 THEN 'not_verified' WHEN count(DISTINCT l_suppkey) < 3 THEN 'few_specimens' ELSE 'usable' END AS status FROM lineitem GROUP BY 1""")
def dataset_availability(spark, sf_dir):
    """The first reason that applies wins."""
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("dataset")).agg(F.count("*").alias("n_rows"), F.max("l_discount").alias("d"), F.count_distinct("l_suppkey").alias("s"))
    return g.select("dataset", "n_rows", F.when(F.col("n_rows") < 8000, "too_small").when(F.col("d") > 0.1, "not_verified").when(F.col("s") < 3, "few_specimens").otherwise("usable").alias("status"))


@query(sql_cte(RAW, """a AS (SELECT src AS id FROM raw WHERE flag = 'A' AND src % 4 <> 1), b AS (SELECT dst AS id FROM raw WHERE flag = 'R' AND dst % 3 <> 1)""", """SELECT (SELECT count(*) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)) AS n_union_all, (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS n_union,
    (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS n_intersect, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS n_except, (SELECT count(DISTINCT id) FROM a) AS n_distinct"""))
def set_operations(spark, sf_dir):
    r = raw(spark, sf_dir)
    a, b = r.where("flag = 'A' AND src % 4 <> 1").select(F.col("src").alias("id")), r.where("flag = 'R' AND dst % 3 <> 1").select(F.col("dst").alias("id"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(a.unionByName(b), "n_union_all")
    for df, name in ((a.unionByName(b).distinct(), "n_union"), (a.intersect(b), "n_intersect"), (a.distinct().join(b, "id", "left_anti"), "n_except"), (a.distinct(), "n_distinct")):
        out = out.crossJoin(n(df, name))
    return out


@query("""SELECT p.specimen, l.line, m.mode, coalesce(n, 0) AS n_runs FROM (SELECT DISTINCT 's' || l_suppkey AS specimen FROM lineitem) p, (SELECT DISTINCT l_linenumber::BIGINT AS line FROM lineitem) l, (SELECT DISTINCT l_returnflag AS mode FROM lineitem) m
    LEFT JOIN (SELECT 's' || l_suppkey AS specimen, l_linenumber AS line, l_returnflag AS mode, count(*) AS n FROM lineitem GROUP BY ALL) r ON r.specimen = p.specimen AND r.line = l.line AND r.mode = m.mode""")
def grid_product(spark, sf_dir):
    """Every combination of the options that occur, with the runs that there are of it: a cross join of options' values, of which
    one may be many (here suppliers), and a left join with what has run."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("s"), "l_suppkey").alias("specimen"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_returnflag").alias("mode"))
    few = {c: sorted(r[0] for r in li.select(c).distinct().collect()) for c in ("line", "mode")}
    grid = li.select("specimen").distinct().crossJoin(F.broadcast(models.grid_frame(spark, few)))
    done = li.groupBy("specimen", "line", "mode").agg(F.count("*").alias("n"))
    return grid.join(done, ["specimen", "line", "mode"], "left").select("specimen", "line", "mode", F.coalesce("n", F.lit(0)).alias("n_runs"))


FAMILIES = [("F1", None, "none (reference)", ["degree", "n", "m"], False), ("F2", "F1", "wiring", ["degree", "n"], False), ("F3", "F2", " Wiring", ["n", "x"], False), ("F4", "F9", "size", ["n"], False), ("F5", None, "size", ["n"], True), ("F4", "F1", "cycles", ["n"], False)]


@query("SELECT * FROM (VALUES ('holds no more fixed than F3', 'F2', 'F3'), ('no parent', 'F5', NULL), ('repeated', 'F4', NULL), ('same factor', 'F2', 'F3'), ('unknown parent', 'F4', 'F9')) AS t(problem, id, other)")
def contrast_matrix(spark, sf_dir):
    """Faults of a declared matrix of families, a row for each."""
    return studies.contrast_matrix_problems(spark.createDataFrame(FAMILIES, "id string, parent string, varied string, fixed array<string>, blocked boolean"))


@query(f"WITH RECURSIVE {SUPPLY}, {WEAK}" + """, d(node, r) AS (SELECT src, dst FROM supply UNION SELECT d.node, supply.dst FROM d JOIN supply ON supply.src = d.r), ends AS (SELECT src AS node FROM supply UNION SELECT dst FROM supply),
    mutual AS (SELECT a.node, a.r FROM d a JOIN d b ON b.node = a.r AND b.r = a.node), n AS (SELECT count(*) AS n FROM ends)
    SELECT n, round((SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT node, min(label) AS l FROM wl GROUP BY 1) GROUP BY l)) / n, 8) AS weak_fraction, round(greatest(1, coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT node, r FROM mutual UNION SELECT node, node FROM ends) GROUP BY node)), 1)) / n, 8) AS strong_fraction,
    round((SELECT avg((src <> dst AND (src, dst) IN (SELECT (node, r) FROM mutual))::INT) FROM supply), 8) AS cycle_edges FROM n""")
def graph_structure(spark, sf_dir):
    s = studies.structure(supply(spark, sf_dir))
    return s.select("n", *[F.round(c, 8).alias(c) for c in ("weak_fraction", "strong_fraction", "cycle_edges")])


def _capped(name: str, ids: str) -> str:
    return f"SELECT '{name}' AS candidate, id FROM (SELECT id FROM ({ids}) JOIN st USING (id) ORDER BY out_strength + in_strength DESC, id LIMIT 25)"


_BACK = "SELECT DISTINCT src AS id FROM ce WHERE pre IN ({}) AND dst IN (SELECT id FROM s2)"


@query(sql_cte(RAW, CLASSES, CLASSED, STRENGTH, GROW, " UNION ALL ".join(f"({_capped(n, q)})" for n, q in {
    "S0": "SELECT id FROM s2",
    "S1": "SELECT id FROM s2 UNION " + _BACK.format("'MBON'"),
    "S2": "SELECT id FROM classes WHERE class = 'KC' UNION SELECT src FROM ce WHERE pre = 'PN' AND post = 'KC'",
    "S3": "SELECT id FROM s2 UNION " + _BACK.format("'DAN', 'APL'"),
    "S4": "SELECT id FROM s2 UNION " + _BACK.format("'MBON', 'DAN', 'APL'"),
}.items())))
def candidate_substrates(spark, sf_dir):
    e = edges(spark, sf_dir)
    return studies.candidate_substrates(e, classes(spark), graph.strengths(e, nodes(spark)), 5, [(("PN",), 6), (("KC", "MBON"), 10)], 25)


@query("""WITH s AS (SELECT s_nationkey::VARCHAR AS candidate, round(avg(s_acctbal), 2) AS s1, max(s_acctbal) AS s2, count(*) AS n FROM supplier GROUP BY 1) SELECT * FROM s WHERE s1 >= 1000 ORDER BY s1 DESC, s2 DESC, n, candidate LIMIT 1""")
def best_candidate(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").cast("string").alias("candidate"))
    return studies.best_candidate(s.agg(F.round(F.avg("s_acctbal"), 2).alias("s1"), F.max("s_acctbal").alias("s2"), F.count("*").alias("n")), 1000)


@query()
def topology_controls(spark, sf_dir):
    """R0 to R6 of the graph: differences in size, edges and spectral radius."""
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), 3)
    rows = [(k, *map(float, studies.constraint_match(r.a, m).values())) for k, m in studies.topology_family(r.a, 1).items()]
    return spark.createDataFrame(rows, "control string, d_nodes double, d_edges double, d_radius double")


@query()
def drive_gate(spark, sf_dir):
    """The gain nearest to the drive band's centre, and memory over a ladder of spectral radii."""
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), 3)
    x = np.random.default_rng(5).normal(0, 1, (200, 3)).cumsum(0) * 0.1
    best = studies.search_gain(r.a, r.w_in, x, [0.25, 0.5, 1.0, 2.0, 4.0])
    ladder = [("ladder", float(a), float(m)) for a, m in studies.radius_ladder(r.a, r.w_in, x, [0.3, 0.6, 0.9])]
    return spark.createDataFrame([("gain", float(best["gain"]), float(best["ratio"])), *ladder], "what string, setting double, value double")


@query()
def benchmark_grid(spark, sf_dir):
    """Two models and an unavailable one over all folds, resumed once: nothing is scored twice, failures are records."""
    f = frame(spark, sf_dir)
    again = dict(dataset="events", features=FEATURES, names=["esn", "svm_rbf", "gru"], lengths=[8], stride=4, order=ORDER)
    first = benchmark.run(f, **again)
    second = benchmark.run(f, **again, done=first)
    return first.select("run_id", "status").unionByName(second.select("run_id", F.concat(F.lit("again_"), "status").alias("status")))


@query()
def reservoir_benchmark(spark, sf_dir):
    """R0 to R6 of the graph as reservoirs over all windows and folds: every control's score."""
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), len(FEATURES))
    family = {k: dataclasses.replace(r, a=a) for k, a in studies.topology_family(r.a, 1).items()}
    grid = benchmark.reservoir_grid(frame(spark, sf_dir), folds(spark, sf_dir), family, FEATURES, 8, 4, ORDER)
    return grid.select("control", "fold_id", "n", F.round("macro_f1", 6).alias("macro_f1"))


@query()
def audit_families(spark, sf_dir):
    """F1, F2, F3 and F5 of the graph: size, edges, radius and criterion A3."""
    r = reservoir.from_edges(edges(spark, sf_dir), nodes(spark), 3)
    rows = [(k, len(m), int((m != 0).sum()), round(reservoir.spectral_radius(m), 6), float(reservoir.krylov_rank(m, r.w_in))) for k, m in studies.audit_families(r.a, r.w_in, 1).items()]
    return spark.createDataFrame(rows, "family string, n int, m int, radius double, krylov double")


@query(sql_cte(FRAME, "w AS (SELECT specimen_id, session_id, row_number() OVER o AS rn, freshness_class AS label, list(event_id) OVER (PARTITION BY specimen_id, session_id ORDER BY time_index, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ids FROM frame WINDOW o AS (PARTITION BY specimen_id, session_id ORDER BY time_index, event_id))", "SELECT specimen_id, session_id, ((rn - 8) // 3)::INT AS window_no, label, ids[1] AS first_row, ids[8] AS last_row FROM w WHERE rn >= 8 AND (rn - 8) % 3 = 0"))
def long_session_windows(spark, sf_dir):
    """Windows of sessions that are cut into blocks of rows equal those of whole sessions."""
    w = windows.long_session_windows(frame(spark, sf_dir), FEATURES, 8, 3, order=ORDER, row_id="event_id", block_rows=10)
    return w.select("specimen_id", "session_id", "window_no", "label", F.element_at("row_ids", 1).alias("first_row"), F.element_at("row_ids", 8).alias("last_row"))
