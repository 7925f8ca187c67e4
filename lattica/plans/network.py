"""Graph queries: contacts from `lineitem`, folded onto a small id space so that pairs repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw, layer_class, root_id
from ..operators import graph
from ..operators.ordering import with_position
from . import register, sql_cte

query = register("network")

RAW = """raw AS (SELECT (l_suppkey * 7 + l_orderkey) % 97 AS src, (l_partkey + l_linenumber * 13) % 97 AS dst, l_returnflag AS flag FROM lineitem),
nodes AS (SELECT range AS id FROM range(97) WHERE range % 10 <> 9),
edges AS (SELECT src, dst, count(*) AS w FROM raw WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL HAVING count(*) >= 3)"""
LAYER = "(id % 70) / 10"
CASE = "CASE WHEN {x} > 0.5 AND {x} <= 1.8 THEN 'ORN' WHEN {x} > 1.8 AND {x} <= 3.5 THEN 'PN' WHEN {x} > 3.5 AND {x} <= 4.2 THEN 'higher_order' WHEN {x} > 4.2 AND {x} <= 4.8 THEN 'DAN' WHEN {x} > 4.8 AND {x} <= 5.5 THEN 'KC' WHEN {x} > 5.5 AND {x} <= 6.5 THEN 'MBON' ELSE 'other' END".format(x=LAYER)
CLASSES = f"classes AS (SELECT id, {CASE} AS class FROM nodes WHERE id % 17 <> 4)"
CLASSED = """ce AS (SELECT src, dst, w, coalesce(a.class, 'unknown') AS pre, coalesce(b.class, 'unknown') AS post FROM edges LEFT JOIN classes a ON a.id = src LEFT JOIN classes b ON b.id = dst)"""
STRENGTH = """st AS (SELECT id, coalesce((SELECT sum(w) FROM edges WHERE src = id), 0)::BIGINT AS out_strength, coalesce((SELECT sum(w) FROM edges WHERE dst = id), 0)::BIGINT AS in_strength FROM nodes)"""
SUPPLY = "supply AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"
DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def raw(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 97).alias("src"), ((F.col("l_partkey") + F.col("l_linenumber") * 13) % 97).alias("dst"), F.col("l_returnflag").alias("flag"))


def nodes(spark) -> DataFrame:
    return spark.range(97).where("id % 10 <> 9")


def edges(spark, sf_dir) -> DataFrame:
    return graph.aggregate_edges(raw(spark, sf_dir).select("src", "dst"), nodes(spark), 3)


def classes(spark) -> DataFrame:
    return nodes(spark).where("id % 17 <> 4").select("id", layer_class((F.col("id") % 70) / 10, graph.TIERS).alias("class"))


PARTS = f"parts AS (SELECT p_partkey AS id, {CASE.replace('id %', 'p_partkey %')} AS class FROM part WHERE p_partkey % 17 <> 4)"


def parts(spark, sf_dir) -> DataFrame:
    """All parts as nodes with a layer's class: it grows with the table."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")).where("id % 17 <> 4")
    return p.select("id", layer_class((F.col("id") % 70) / 10, graph.TIERS).alias("class"))


def classed(spark, sf_dir) -> DataFrame:
    return graph.classed(edges(spark, sf_dir), classes(spark))


def supplies(spark, sf_dir) -> DataFrame:
    """Supplier keys to part keys of all rows, as nodes of one id space: it grows with the tables."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def supply(spark, sf_dir) -> DataFrame:
    """The same, each pair once."""
    return supplies(spark, sf_dir).distinct()


@query(sql_cte(RAW, "SELECT src, dst, w, (SELECT count(*) FROM nodes WHERE id < src) AS src_idx, (SELECT count(*) FROM nodes WHERE id < dst) AS dst_idx, src = dst AS is_loop FROM edges"))
def edge_aggregate(spark, sf_dir):
    """Whitelisted contacts counted into weighted edges, with the nodes' positions."""
    place = with_position(nodes(spark), ["id"], "idx")
    a, b = place.withColumnsRenamed({"id": "src", "idx": "src_idx"}), place.withColumnsRenamed({"id": "dst", "idx": "dst_idx"})
    return edges(spark, sf_dir).join(a, "src").join(b, "dst").select("src", "dst", "w", "src_idx", "dst_idx", (F.col("src") == F.col("dst")).alias("is_loop"))


@query(sql_cte(RAW, "SELECT DISTINCT src AS id FROM raw WHERE src NOT IN (SELECT id FROM nodes)"))
def whitelist_difference(spark, sf_dir):
    return raw(spark, sf_dir).select(F.col("src").alias("id")).distinct().join(nodes(spark), "id", "left_anti")


@query(sql_cte(RAW, "SELECT src, dst, w, round(w / sum(w) OVER (PARTITION BY src), 8) AS n1, round(w / sum(w) OVER (PARTITION BY dst), 8) AS n2, round(w / max(w) OVER (), 8) AS n3, round(ln(1 + w) / sum(ln(1 + w)) OVER (PARTITION BY src), 8) AS n4, 1.0::DOUBLE AS n5 FROM edges"))
def edge_norms(spark, sf_dir):
    n = graph.normalised(edges(spark, sf_dir))
    return n.select("src", "dst", "w", *[F.round(f"n{i}", 8).alias(f"n{i}") for i in range(1, 5)], "n5")


@query(sql_cte(RAW, STRENGTH, "SELECT *, out_strength + in_strength AS total FROM st"))
def node_strength(spark, sf_dir):
    return graph.strengths(edges(spark, sf_dir), nodes(spark))


@query(sql_cte(RAW, STRENGTH, "t AS (SELECT out_strength + in_strength AS t FROM st WHERE out_strength + in_strength > 0)", "SELECT count(*) AS n, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std_pop, min(t) AS min, max(t) AS max, quantile_cont(t::DOUBLE, 0.5) AS median FROM t"))
def strength_stats(spark, sf_dir):
    s = graph.strength_stats(graph.strengths(edges(spark, sf_dir), nodes(spark)))
    return s.select("n", F.round("mean", 6).alias("mean"), F.round("std_pop", 6).alias("std_pop"), "min", "max", "median")


@query(sql_cte(RAW, "n AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges))", "SELECT n, count(*) AS m, count(*) FILTER (src = dst) AS n_loops, round(count(*) / (n * (n - 1)), 8) AS density FROM edges, n GROUP BY n"))
def graph_density(spark, sf_dir):
    return graph.density(edges(spark, sf_dir)).withColumn("density", F.round("density", 8))


@query(sql_cte(PARTS, "SELECT class, count(*) AS n FROM parts GROUP BY 1"))
def node_class_counts(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query(sql_cte(RAW, CLASSES, CLASSED, """p AS (SELECT CASE WHEN pre = 'unknown' OR post = 'unknown' THEN 'other' WHEN pre IN ('DAN', 'APL') OR post IN ('DAN', 'APL') THEN 'modulatory'
    WHEN (pre, post) IN (('ORN', 'PN'), ('ORN', 'higher_order'), ('PN', 'KC'), ('PN', 'MBON'), ('PN', 'higher_order'), ('KC', 'MBON'), ('KC', 'higher_order'), ('higher_order', 'PN'), ('higher_order', 'KC'), ('higher_order', 'MBON')) THEN 'forward' WHEN pre = post THEN 'lateral' ELSE 'other' END AS pathway FROM ce)""",
    "SELECT pathway, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY pathway"))
def pathway_counts(spark, sf_dir):
    from pyspark.sql.window import Window

    c = classed(spark, sf_dir).groupBy(graph.pathway(F.col("pre"), F.col("post")).alias("pathway")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(sql_cte(RAW, CLASSES, CLASSED, "SELECT pre, post, count(*) AS n_edges, sum(w)::BIGINT AS weight FROM ce GROUP BY ALL"))
def type_pair_matrix(spark, sf_dir):
    return graph.type_pairs(classed(spark, sf_dir))


@query(sql_cte(RAW, CLASSES, """e2 AS (SELECT src, dst, flag, count(*) AS w FROM raw WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL),
    t AS (SELECT coalesce(a.class, 'unknown') AS pre, coalesce(b.class, 'unknown') AS post, coalesce(sum(w) FILTER (flag = 'A'), 0) AS wb, coalesce(sum(w) FILTER (flag = 'R'), 0) AS wa FROM e2 LEFT JOIN classes a ON a.id = src LEFT JOIN classes b ON b.id = dst WHERE flag IN ('A', 'R') GROUP BY ALL)""",
    "SELECT round(sum(abs(wa - wb)) / sum(wb), 8) AS l1_change, sum(abs(wa - wb)) / sum(wb) >= 0.05 AS changed FROM t"))
def type_pair_change(spark, sf_dir):
    part = lambda f: graph.classed(graph.aggregate_edges(raw(spark, sf_dir).where(F.col("flag") == f).select("src", "dst"), nodes(spark)), classes(spark))
    return graph.type_pair_change(part("A"), part("R")).select(F.round("l1_change", 8).alias("l1_change"), "changed")


@query(sql_cte(RAW, "SELECT * FROM edges WHERE src % 3 = 0 AND dst % 3 = 0"))
def induced_subgraph(spark, sf_dir):
    return graph.induced(edges(spark, sf_dir), nodes(spark).where("id % 3 = 0"))


@query(sql_cte(RAW, CLASSES, CLASSED, "SELECT count(*) AS n_edges, count(DISTINCT dst) AS n_pn_reached, sum(w)::BIGINT AS weight FROM ce WHERE pre = 'ORN' AND post = 'PN'"))
def typed_edges(spark, sf_dir):
    return classed(spark, sf_dir).where("pre = 'ORN' AND post = 'PN'").agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_pn_reached"), F.sum("w").alias("weight"))


@query(sql_cte(RAW, CLASSES, CLASSED, "SELECT DISTINCT src AS id FROM ce WHERE pre IN ('MBON', 'DAN') AND dst IN (SELECT id FROM nodes WHERE id % 3 = 0)"))
def feedback_closure(spark, sf_dir):
    base = nodes(spark).where("id % 3 = 0").withColumnRenamed("id", "dst")
    return classed(spark, sf_dir).where("pre IN ('MBON', 'DAN')").join(base, "dst", "left_semi").select(F.col("src").alias("id")).distinct()


@query(sql_cte(PARTS, "two AS (SELECT id, CASE WHEN id % 13 = 1 THEN 'KC' ELSE class END AS class FROM parts WHERE id % 7 <> 2 UNION ALL SELECT -s_suppkey, 'PN' FROM supplier)", """SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_shared, count(*) FILTER (b.id IS NULL) AS n_first_only, count(*) FILTER (a.id IS NULL) AS n_second_only, count(*) FILTER (a.class <> b.class) AS n_disagree
    FROM parts a FULL JOIN two b ON a.id = b.id"""))
def annotation_comparison(spark, sf_dir):
    """Two annotations of all parts; suppliers are known to the second only."""
    one = parts(spark, sf_dir)
    two = one.where("id % 7 <> 2").select("id", F.when(F.col("id") % 13 == 1, "KC").otherwise(F.col("class")).alias("class"))
    two = two.unionByName(spark.read.parquet(f"{sf_dir}/supplier.parquet").select((-F.col("s_suppkey")).alias("id"), F.lit("PN").alias("class")))
    return graph.compare_annotations(one, two)


@query("SELECT l_partkey AS id, count(DISTINCT l_returnflag) AS n_classes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def annotation_conflicts(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return graph.annotation_conflicts(li.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("class")))


@query("WITH RECURSIVE " + sql_cte(RAW, """tagged AS (SELECT FALSE AS core, * FROM edges UNION ALL SELECT TRUE, * FROM edges WHERE src % 50 <= 40 AND dst % 50 <= 40),
    each AS (SELECT core, src, dst, min_w FROM tagged, (SELECT unnest([3, 5, 8, 12])::INT AS min_w) WHERE w >= min_w),
    m AS (SELECT core, min_w, count(*) AS m FROM each GROUP BY ALL), n AS (SELECT core, min_w, count(*) AS n FROM (SELECT core, min_w, src AS id FROM each UNION SELECT core, min_w, dst FROM each) GROUP BY ALL),
    sym AS (SELECT core, min_w, src, dst FROM each UNION SELECT core, min_w, dst, src FROM each),
    p(step, core, min_w, id, x, norm) AS (SELECT 0, core, min_w, src, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT core, min_w, src FROM sym)
        UNION ALL SELECT step + 1, core, min_w, dst, s / norm, norm FROM (SELECT step, sym.core, sym.min_w, dst, sum(x) AS s, sqrt(sum(sum(x) * sum(x)) OVER (PARTITION BY sym.core, sym.min_w)) AS norm
            FROM p JOIN sym ON sym.core = p.core AND sym.min_w = p.min_w AND sym.src = p.id WHERE step < 60 GROUP BY step, sym.core, sym.min_w, dst))""",
    "SELECT core, min_w, m, n, round(m / (n * (n - 1)), 8) AS density, round(radius, 6) AS radius FROM m JOIN n USING (core, min_w) JOIN (SELECT core, min_w, max(norm) AS radius FROM p WHERE step = 60 GROUP BY ALL) USING (core, min_w)").removeprefix("WITH "))
def size_curve(spark, sf_dir):
    c = graph.size_curve(edges(spark, sf_dir), nodes(spark).where("id % 50 <= 40"), [3, 5, 8, 12])
    return c.withColumns({"density": F.round("density", 8), "radius": F.round("radius", 6)})


IMPACT_ROUNDS = (1, 2, 4, 16)


@query("WITH RECURSIVE " + sql_cte(RAW, """each AS (SELECT src % 5 AS part, src, dst, min_w FROM edges, (SELECT unnest([3, 8])::INT AS min_w) WHERE w >= min_w), sym AS (SELECT part, min_w, src, dst FROM each UNION SELECT part, min_w, dst, src FROM each),
    p(step, part, min_w, id, x, norm) AS (SELECT 0, part, min_w, src, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT part, min_w, src FROM sym)
        UNION ALL SELECT step + 1, part, min_w, dst, s / norm, norm FROM (SELECT step, sym.part, sym.min_w, dst, sum(x) AS s, sqrt(sum(sum(x) * sum(x)) OVER (PARTITION BY sym.part, sym.min_w)) AS norm
            FROM p JOIN sym ON sym.part = p.part AND sym.min_w = p.min_w AND sym.src = p.id WHERE step < 60 GROUP BY step, sym.part, sym.min_w, dst)),
    n AS (SELECT DISTINCT step, part, min_w, norm FROM p)""",
    f"SELECT a.part, a.min_w, a.step AS rounds, round(abs(a.norm - b.norm), 6) AS error, round(0.95 * b.norm / a.norm, 6) AS scaled, abs(0.95 * b.norm / a.norm - 0.95) <= 0.0001 AS kept FROM n a JOIN n b ON b.part = a.part AND b.min_w = a.min_w AND b.step = 60 WHERE a.step IN {IMPACT_ROUNDS}").removeprefix("WITH "))
def radius_impact(spark, sf_dir):
    """What a few rounds of power iteration get wrong, for ten subgraphs together, and whether a scaling by them holds."""
    e = edges(spark, sf_dir).withColumn("part", F.col("src") % 5).withColumn("min_w", F.explode(F.array(F.lit(3), F.lit(8)))).where("w >= min_w")
    trace = graph.radius_trace(e, ["part", "min_w"])
    found = graph.radius_impact(trace, ["part", "min_w"], IMPACT_ROUNDS, 0.95, 1e-4)
    return found.withColumns({"error": F.round("error", 6), "scaled": F.round("scaled", 6)})


HALF = "a AS (SELECT DISTINCT src, dst FROM raw WHERE flag = 'A'), b AS (SELECT DISTINCT src, dst FROM raw WHERE flag = 'R')"


@query(sql_cte(RAW, HALF, "SELECT count(b.src) AS n_shared, count(*) AS n_first, round(count(b.src) / count(*), 8) AS share FROM a LEFT JOIN b USING (src, dst)"))
def edge_overlap(spark, sf_dir):
    r = raw(spark, sf_dir)
    return graph.edge_overlap(r.where("flag = 'A'"), r.where("flag = 'R'")).withColumn("share", F.round("share", 8))


@query(sql_cte(RAW, """o AS (SELECT src, count(*) AS ko FROM edges GROUP BY 1), i AS (SELECT dst, count(*) AS ki FROM edges GROUP BY 1), m AS (SELECT count(*) AS m FROM edges)""", "SELECT round(sum(ko * ki) / any_value(m), 6) AS expected, round(sum(ko * ki) / any_value(m) / any_value(m), 8) AS share FROM edges JOIN o USING (src) JOIN i USING (dst), m"))
def config_overlap(spark, sf_dir):
    return graph.expected_overlap(edges(spark, sf_dir)).select(F.round("expected", 6).alias("expected"), F.round("share", 8).alias("share"))


@query(sql_cte(RAW, """a AS (SELECT dst, count(*) AS r FROM raw WHERE flag = 'A' GROUP BY 1), b AS (SELECT dst, count(*) AS o FROM raw WHERE flag = 'R' GROUP BY 1), e AS (SELECT abs(coalesce(o, 0) - r) / r AS e FROM a LEFT JOIN b USING (dst))""", "SELECT round(quantile_cont(e, 0.5), 8) AS median, round(quantile_cont(e, 0.9), 8) AS p90, round(max(e), 8) AS max, count(*) AS n FROM e"))
def in_strength_error(spark, sf_dir):
    part = lambda f: graph.aggregate_edges(raw(spark, sf_dir).where(F.col("flag") == f).select("src", "dst"))
    e = graph.in_strength_error(part("A"), part("R"))
    return e.select(*[F.round(c, 8).alias(c) for c in ("median", "p90", "max")], "n")


WEAK = """und AS (SELECT src, dst FROM supply WHERE src <> dst UNION SELECT dst, src FROM supply WHERE src <> dst),
    wl(node, label) AS (SELECT src, src FROM und UNION SELECT und.dst, min(wl.label) FROM wl JOIN und ON und.src = wl.node GROUP BY und.dst)"""


@query(f"WITH RECURSIVE {SUPPLY}, {WEAK} SELECT node, min(label) AS label FROM wl GROUP BY 1")
def weak_components(spark, sf_dir):
    return graph.weak_components(supply(spark, sf_dir))


@query("WITH RECURSIVE " + SUPPLY + """, r(node, reached) AS (SELECT src, dst FROM supply UNION SELECT r.node, supply.dst FROM r JOIN supply ON supply.src = r.reached),
    ends AS (SELECT src AS node FROM supply UNION SELECT dst FROM supply)
    SELECT node, least(node, coalesce((SELECT min(a.reached) FROM r a JOIN r b ON b.node = a.reached AND b.reached = a.node WHERE a.node = ends.node), node)) AS label FROM ends""")
def strong_components(spark, sf_dir):
    return graph.strong_components(supplies(spark, sf_dir))


@query("WITH RECURSIVE " + SUPPLY + """, r(node) AS (SELECT range FROM range(3) UNION SELECT supply.dst FROM r JOIN supply ON supply.src = r.node) SELECT node FROM r""")
def reachable_nodes(spark, sf_dir):
    return graph.reachable(supply(spark, sf_dir), spark.range(3))


@query("WITH RECURSIVE " + SUPPLY + """, und AS (SELECT src, dst FROM supply UNION SELECT dst, src FROM supply),
    r(root, node, dist) AS (SELECT range, range, 0 FROM range(5) UNION SELECT r.root, und.dst, r.dist + 1 FROM r JOIN und ON und.src = r.node WHERE r.dist < 4) SELECT root, node, min(dist) AS dist FROM r GROUP BY ALL""")
def bfs_levels(spark, sf_dir):
    return graph.bfs_levels(supply(spark, sf_dir), spark.range(5), 4)


@query("WITH RECURSIVE " + SUPPLY + f""", und AS (SELECT src, dst FROM supply UNION SELECT dst, src FROM supply),
    roots AS (SELECT DISTINCT src AS root FROM supply ORDER BY {DRAW.format("'root|3|' || root")}, root LIMIT 200),
    r(root, node, dist) AS (SELECT root, root, 0 FROM roots UNION SELECT r.root, und.dst, min(r.dist + 1) FROM r JOIN und ON und.src = r.node WHERE r.dist < 12 GROUP BY ALL),
    d AS (SELECT root, node, min(dist) AS dist FROM r GROUP BY ALL) SELECT round(avg(dist), 8) AS mean, round(stddev_pop(dist), 8) AS std_pop, max(dist) AS max, count(*) AS n_paths FROM d WHERE dist > 0""")
def path_stats(spark, sf_dir):
    """Shortest paths from 200 sampled roots to all nodes: sampling roots is the operator's feature, and no depth ends it."""
    e = supply(spark, sf_dir)
    roots = e.select(F.col("src").alias("id")).distinct().orderBy(draw("root", 3, F.col("id")), "id").limit(200)
    d = graph.distance_counts(e, roots).where("dist > 0")
    total = d.agg(F.sum("n").alias("n_paths"), (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("mean"), F.max("dist").alias("max"))
    gap = F.col("dist") - F.col("mean")
    std = F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n"))
    both = d.crossJoin(F.broadcast(total)).agg(F.first("mean").alias("mean"), std.alias("std_pop"), F.first("max").alias("max"), F.coalesce(F.first("n_paths"), F.lit(0)).alias("n_paths"))
    return both.select(F.round("mean", 8).alias("mean"), F.round("std_pop", 8).alias("std_pop"), "max", "n_paths")


@query("WITH " + SUPPLY + """, w2 AS (SELECT DISTINCT a.src AS s, b.dst AS d FROM supply a JOIN supply b ON a.dst = b.src), w3 AS (SELECT DISTINCT s, c.dst AS d FROM w2 JOIN supply c ON c.src = w2.d)
    SELECT DISTINCT s AS id, 2 AS k FROM w2 WHERE s = d UNION ALL SELECT DISTINCT s, 3 FROM w3 WHERE s = d""")
def closed_walks(spark, sf_dir):
    e = supply(spark, sf_dir)
    return graph.closed_walks(e, 2).withColumn("k", F.lit(2)).unionByName(graph.closed_walks(e, 3).withColumn("k", F.lit(3)))


@query(sql_cte(RAW, STRENGTH, "SELECT id, out_strength + in_strength AS total FROM st ORDER BY total DESC, id LIMIT 12"))
def topk_strength(spark, sf_dir):
    return graph.top_by_strength(graph.strengths(edges(spark, sf_dir), nodes(spark)), 12).select("id", "total")


GROW = """named AS (SELECT c.id, class, out_strength + in_strength AS total FROM classes c JOIN st USING (id)),
s0 AS (SELECT id, 0 AS step FROM named WHERE class = 'ORN' ORDER BY total DESC, id LIMIT 5),
m1 AS (SELECT id, sum(w) AS score FROM (SELECT dst AS id, w FROM edges WHERE src IN (SELECT id FROM s0) UNION ALL SELECT src, w FROM edges WHERE dst IN (SELECT id FROM s0)) GROUP BY 1),
s1 AS (SELECT * FROM s0 UNION ALL SELECT id, 1 FROM (SELECT id FROM named JOIN m1 USING (id) WHERE class = 'PN' AND id NOT IN (SELECT id FROM s0) ORDER BY score DESC, id LIMIT 6)),
m2 AS (SELECT id, sum(w) AS score FROM (SELECT dst AS id, w FROM edges WHERE src IN (SELECT id FROM s1) UNION ALL SELECT src, w FROM edges WHERE dst IN (SELECT id FROM s1)) GROUP BY 1),
s2 AS (SELECT * FROM s1 UNION ALL SELECT id, 2 FROM (SELECT id FROM named JOIN m2 USING (id) WHERE class IN ('KC', 'MBON') AND id NOT IN (SELECT id FROM s1) ORDER BY score DESC, id LIMIT 10))"""


@query(sql_cte(RAW, CLASSES, STRENGTH, GROW, "SELECT * FROM s2"))
def frontier_selection(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.grow_selection(e, classes(spark), graph.strengths(e, nodes(spark)), 5, [(("PN",), 6), (("KC", "MBON"), 10)])


@query(sql_cte(RAW, CLASSES, STRENGTH, GROW, "el AS (SELECT * FROM edges WHERE src <> dst), ins AS (SELECT * FROM el WHERE src IN (SELECT id FROM s2) AND dst IN (SELECT id FROM s2))", """SELECT (SELECT count(*) FROM el) AS n_eligible, (SELECT count(*) FROM ins) AS n_inside,
    (SELECT count(*) FROM s2 WHERE id NOT IN (SELECT src FROM ins UNION SELECT dst FROM ins)) AS n_isolated, round((SELECT count(*) FROM ins) / (SELECT count(*) FROM el), 8) AS retention"""))
def selection_quality(spark, sf_dir):
    return graph.subgraph_quality(edges(spark, sf_dir), frontier_selection(spark, sf_dir)).withColumn("retention", F.round("retention", 8))


@query(sql_cte(RAW, CLASSES, STRENGTH, """named AS (SELECT id, class, coalesce(out_strength + in_strength, 0) AS total FROM classes LEFT JOIN st USING (id)),
    g AS (SELECT class, sum(total)::DOUBLE AS t, count(*) AS c FROM named GROUP BY 1), q0 AS (SELECT class, c, least(c, greatest(1, round_even(30 * t / (SELECT sum(t) FROM g), 0)))::BIGINT AS q FROM g),
    o AS (SELECT sum(q) - least(30, sum(c)) AS off FROM q0), room AS (SELECT class, q, sign(off) AS s, abs(off) AS off, CASE WHEN off > 0 THEN q - 1 ELSE c - q END AS room,
        row_number() OVER (ORDER BY CASE WHEN off < 0 THEN -q ELSE q END, CASE WHEN off < 0 THEN NULL ELSE class END, CASE WHEN off < 0 THEN class END DESC) AS r FROM q0, o),
    quota AS (SELECT class, q - s * greatest(0, least(room, off - coalesce(sum(room) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM room)""",
    "SELECT id, class FROM (SELECT id, class, quota, row_number() OVER (PARTITION BY class ORDER BY " + DRAW.format("'pick|3|' || id") + ", id) AS r FROM named JOIN quota USING (class)) WHERE r <= quota"))
def stratified_select(spark, sf_dir):
    """A sample of 30 nodes with quotas by strength; tests hold the quotas against brute force too."""
    e = edges(spark, sf_dir)
    return graph.stratified_sample(classes(spark), graph.strengths(e, nodes(spark)), 30, 3)


@query(sql_cte(PARTS, """c AS (SELECT class, count(*) AS weight FROM parts GROUP BY 1), q AS (SELECT class, weight, floor(weight * 25.0::DOUBLE / sum(weight) OVER ()) AS base, round(weight * 25.0::DOUBLE / sum(weight) OVER () - floor(weight * 25.0::DOUBLE / sum(weight) OVER ()), 9) AS rest FROM c)""",
    "SELECT class, weight, (base + (row_number() OVER (ORDER BY rest DESC, class) <= 25 - sum(base) OVER ())::INT)::BIGINT AS seats FROM q"))
def largest_remainder(spark, sf_dir):
    return graph.largest_remainder(parts(spark, sf_dir).groupBy("class").agg(F.count("*").alias("weight")), 25, "class")


@query(sql_cte(RAW, f"""e1 AS (SELECT src, dst, row_number() OVER (ORDER BY {DRAW.format("'edge|5|' || src || '|' || dst")}, src, dst) AS p FROM edges), e2 AS (SELECT w, row_number() OVER (ORDER BY {DRAW.format("'weight|5|' || src || '|' || dst")}, src, dst) AS p FROM edges)""", "SELECT src, dst, w FROM e1 JOIN e2 USING (p)"))
def weight_shuffle(spark, sf_dir):
    return graph.shuffled_weights(edges(spark, sf_dir), 5)


@query(sql_cte(RAW, f"""stubs AS (SELECT src, dst, unnest(range(1, w + 1)) AS i FROM edges), a AS (SELECT src, row_number() OVER (ORDER BY {DRAW.format("'src|5|' || src || '|' || dst || '|' || i")}, src, dst, i) AS p FROM stubs),
    b AS (SELECT dst, row_number() OVER (ORDER BY {DRAW.format("'dst|5|' || src || '|' || dst || '|' || i")}, src, dst, i) AS p FROM stubs)""", "SELECT src, dst, count(*) AS w FROM a JOIN b USING (p) GROUP BY ALL"))
def configuration_model(spark, sf_dir):
    return graph.configuration_model(edges(spark, sf_dir), 5)


@query(sql_cte(RAW, "SELECT src, sha256(string_agg(w::VARCHAR, ',' ORDER BY w)) AS digest FROM edges GROUP BY 1"))
def weight_multisets(spark, sf_dir):
    return graph.multiset_hash(edges(spark, sf_dir))


@query(sql_cte(RAW, "SELECT sha256(string_agg(src || '>' || dst || ':' || w, ';' ORDER BY src, dst)) AS digest FROM edges"))
def adjacency_hash(spark, sf_dir):
    """One hash of the whole graph; its text is as long as the graph, so it is meant for selected subgraphs."""
    e = edges(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "w"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"), F.lit(":"), x["w"].cast("string"))), ";")
    return e.select(F.sha2(text.cast("binary"), 256).alias("digest"))


@query(sql_cte(PARTS, f"""SELECT id, class, ((row_number() OVER (PARTITION BY class ORDER BY {DRAW.format("'map|2|' || id")}, id) - 1) % 4)::INT AS channel FROM parts"""))
def input_channels(spark, sf_dir):
    """The channels of all parts."""
    return graph.input_channels(parts(spark, sf_dir), 4, 2)


@query("SELECT s_suppkey, (s_acctbal::BIGINT - (CASE WHEN s_acctbal::BIGINT > s_acctbal AND s_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN s_acctbal::BIGINT < s_acctbal AND s_acctbal < 0 THEN 1 ELSE 0 END))::VARCHAR AS root FROM supplier")
def canonical_root_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", root_id(F.concat(F.lit("  "), F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit(" "))).alias("root"))


@query(f"WITH RECURSIVE {RAW}" + """, sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    r(step, id, x, norm) AS (SELECT 0, src, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM sym)
        UNION ALL SELECT step + 1, dst, s / norm, norm FROM (SELECT step, dst, sum(x) AS s, sqrt(sum(sum(x) * sum(x)) OVER ()) AS norm FROM r JOIN sym ON sym.src = r.id WHERE step < 60 GROUP BY step, dst))
    SELECT round(max(norm), 6) AS spectral_radius FROM r WHERE step = 60""")
def spectral_radius(spark, sf_dir):
    """Power iteration on the symmetrised, binary graph; tests hold it against dense eigenvalues too."""
    return spark.createDataFrame([(round(graph.spectral_radius(edges(spark, sf_dir)), 6),)], "spectral_radius double")


@query()
def top_eigenvalues(spark, sf_dir):
    """Moduli of the largest eigenvalues of the selected graph's symmetric part, and the gap of the first two."""
    found = graph.top_eigenvalues(edges(spark, sf_dir), nodes(spark), 8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "place int, modulus double")


@query(sql_cte(RAW, CLASSES, STRENGTH, """pick AS (SELECT id FROM classes WHERE class IN ('PN', 'KC')), need AS (SELECT greatest(0, 50 - count(*)) AS n FROM pick),
    more AS (SELECT id, row_number() OVER (ORDER BY out_strength + in_strength DESC, id) AS r FROM st WHERE id NOT IN (SELECT id FROM pick))""", "SELECT id, FALSE AS filled FROM pick UNION ALL SELECT id, TRUE FROM more, need WHERE r <= n"))
def degree_backfill(spark, sf_dir):
    """A selection filled up to 50 nodes by strength."""
    e = edges(spark, sf_dir)
    return graph.back_filled(classes(spark).where("class IN ('PN', 'KC')").select("id"), graph.strengths(e, nodes(spark)), 50)


@query("""WITH d AS (SELECT c_nationkey AS nation, c_nationkey % 12 + 1 AS din, count(*) AS nodes, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey), 0) AS available FROM customer GROUP BY 1),
    f AS (SELECT *, greatest(20, 2 * din) AS orn, 20 AS pn, greatest(50, 4 * din) AS kc, 20 AS feedback FROM d)
    SELECT nation, din::INT AS din, orn::INT AS orn, pn, kc::INT AS kc, feedback, greatest(orn + pn + kc + feedback, ceil(orn / (0.1 * din) - 1e-9))::INT AS least_nodes, least(available, floor(0.1 * din * nodes + 1e-9))::INT AS orn_budget FROM f""")
def node_budgets(spark, sf_dir):
    """A design for each nation: its customers are the nodes, its suppliers the ORN that there are."""
    have = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("available"))
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("nodes")).join(have, "nation", "left")
    d = d.withColumns({"din": (F.col("nation") % 12 + 1).cast("int"), "available": F.coalesce("available", F.lit(0))})
    return d.select("nation", "din", *graph.node_budgets(F.col("din"), F.col("nodes"), F.col("available")).values())
