"""Weighted directed graphs as edge tables (src, dst, w): aggregation, normalisation, structure and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw
from ..storage import materialise
from .ordering import with_position

#: Layers (low, high] of node classes, and the pairs of classes that edges lead forward between.
TIERS = [
    (0.5, 1.8, "ORN"),
    (1.8, 3.5, "PN"),
    (3.5, 4.2, "higher_order"),
    (4.2, 4.8, "DAN"),
    (4.8, 5.5, "KC"),
    (5.5, 6.5, "MBON"),
    (6.5, math.inf, "other"),
]
FORWARD = [
    ("ORN", "PN"),
    ("ORN", "higher_order"),
    ("PN", "KC"),
    ("PN", "MBON"),
    ("PN", "higher_order"),
    ("KC", "MBON"),
    ("KC", "higher_order"),
    ("higher_order", "PN"),
    ("higher_order", "KC"),
    ("higher_order", "MBON"),
]


def aggregate_edges(contacts: DataFrame, nodes: DataFrame | None = None, min_count: int = 1) -> DataFrame:
    """src, dst, w: contacts between known nodes, counted; pairs of at least min_count.

    Both semi-joins come before the count, which combines on the map side."""
    if nodes is not None:
        ids = nodes.select("id").distinct()
        contacts = contacts.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return contacts.groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= min_count)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def normalised(edges: DataFrame) -> DataFrame:
    """n1 by row sum, n2 by column sum, n3 by the greatest, n4 log1p then by row sum, n5 binary.

    Sums are combined on the map side and joined back, so a hub's edges don't meet in one task."""
    top = edges.agg(F.max("w").alias("_top"))
    by_src = edges.groupBy("src").agg(F.sum("w").alias("_out"), F.sum(F.log1p("w")).alias("_log"))
    by_dst = edges.groupBy("dst").agg(F.sum("w").alias("_in"))
    e = edges.crossJoin(F.broadcast(top)).join(by_src, "src").join(by_dst, "dst")
    part = lambda value, total: value / F.when(F.col(total) == 0, 1).otherwise(F.col(total))
    return e.select("src", "dst", "w", part(F.col("w"), "_out").alias("n1"), part(F.col("w"), "_in").alias("n2"), (F.col("w") / F.col("_top")).alias("n3"), part(F.log1p("w"), "_log").alias("n4"), F.lit(1.0).alias("n5"))


def strengths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, out_strength, in_strength, total of weights; with nodes, isolated ones too."""
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0).cast("bigint").alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).cast("bigint").alias("o"), F.col("w").alias("i")))).alias("e")
    s = edges.select(both).groupBy("e.id").agg(F.sum("e.o").alias("out_strength"), F.sum("e.i").alias("in_strength"))
    if nodes is not None:
        s = nodes.select("id").distinct().join(s, "id", "left").fillna(0)
    return s.withColumn("total", F.col("out_strength") + F.col("in_strength"))


def strength_stats(s: DataFrame) -> DataFrame:
    """Over nodes with a positive total: mean, population deviation, least, greatest and median."""
    t = s.where("total > 0")
    return t.agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("std_pop"), F.min("total").alias("min"), F.max("total").alias("max"), F.percentile("total", F.lit(0.5)).alias("median"))


def density(edges: DataFrame) -> DataFrame:
    """n, m and m / (n (n - 1)), self-loops counted in m."""
    n = endpoints(edges).agg(F.count("*").alias("n"))
    m = edges.agg(F.count("*").alias("m"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
    return n.crossJoin(m).withColumn("density", F.try_divide(F.col("m"), F.col("n") * (F.col("n") - 1)))


def pathway(pre: Column, post: Column) -> Column:
    """Class of an edge; the first rule that holds wins."""
    forward = F.lit(False)
    for a, b in FORWARD:
        forward = forward | ((pre == a) & (post == b))
    modulatory = pre.isin("DAN", "APL") | post.isin("DAN", "APL")
    return F.when((pre == "unknown") | (post == "unknown"), "other").when(modulatory, "modulatory").when(forward, "forward").when(pre == post, "lateral").otherwise("other")


def classed(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges with both ends' classes; nodes without one are `unknown`."""
    pre = classes.select(F.col("id").alias("src"), F.col("class").alias("pre"))
    post = classes.select(F.col("id").alias("dst"), F.col("class").alias("post"))
    return edges.join(pre, "src", "left").join(post, "dst", "left").fillna("unknown", ["pre", "post"])


def type_pairs(classed_edges: DataFrame) -> DataFrame:
    return classed_edges.groupBy("pre", "post").agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"))


def type_pair_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sum of absolute changes over the sum before, and whether that is at least 5 %."""
    b = type_pairs(before).select("pre", "post", F.col("weight").alias("wb"))
    a = type_pairs(after).select("pre", "post", F.col("weight").alias("wa"))
    both = b.join(a, ["pre", "post"], "full").fillna(0, ["wa", "wb"])
    change = F.sum(F.abs(F.col("wa") - F.col("wb"))) / F.sum("wb")
    return both.agg(change.alias("l1_change"), (change >= 0.05).alias("changed"))


def size_curve(edges: DataFrame, core: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """n, m, density and spectral radius (of the symmetrised, binary matrix) for each least weight, on all nodes and on
    core nodes: counts from one pass over the edges, radii from one power iteration of all subgraphs together."""
    tagged = induced(edges, core).withColumn("core", F.lit(True)).unionByName(edges.withColumn("core", F.lit(False)))
    each = tagged.withColumn("min_w", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("w >= min_w")
    radii = spectral_radii(each, ["core", "min_w"]).drop("rounds")
    m = each.groupBy("core", "min_w").agg(F.count("*").alias("m"))
    ends = each.select("core", "min_w", F.explode(F.array("src", "dst")).alias("id"))
    n = ends.groupBy("core", "min_w").agg(F.count_distinct("id").alias("n"))
    return m.join(n, ["core", "min_w"]).withColumn("density", F.try_divide(F.col("m"), F.col("n") * (F.col("n") - 1))).join(F.broadcast(radii), ["core", "min_w"])


def edge_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Shared edges, and their part of the first graph's."""
    b = two.select("src", "dst", F.lit(1).alias("hit")).distinct()
    return one.select("src", "dst").distinct().join(b, ["src", "dst"], "left").agg(F.count("hit").alias("n_shared"), F.count("*").alias("n_first"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def expected_overlap(edges: DataFrame) -> DataFrame:
    """Edges that a configuration model shares with the graph in expectation, and their part of m."""
    out = edges.groupBy("src").agg(F.count("*").alias("k_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("k_in"))
    m = edges.agg(F.count("*").alias("m"))
    total = edges.join(out, "src").join(into, "dst").agg(F.sum((F.col("k_out") * F.col("k_in")).cast("double")).alias("s"))
    return total.crossJoin(m).select((F.col("s") / F.col("m")).alias("expected"), (F.col("s") / F.col("m") / F.col("m")).alias("share"))


def in_strength_error(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Median, 90th percentile and greatest relative error of in-strengths, where the reference is positive."""
    r = reference.groupBy("dst").agg(F.sum("w").alias("r")).where("r > 0")
    o = other.groupBy("dst").agg(F.sum("w").alias("o"))
    e = r.join(o, "dst", "left").withColumn("e", F.abs(F.coalesce("o", F.lit(0)) - F.col("r")) / F.col("r"))
    return e.agg(F.percentile("e", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.9)).alias("p90"), F.max("e").alias("max"), F.count("*").alias("n"))


def weak_components(edges: DataFrame, written: bool = False) -> DataFrame:
    """node, label (smallest reachable id, directions ignored) of each node with an edge to another.

    Rounds of small and large stars: their number grows with the logarithm of a component's size, and
    a hub's edges are joined like any skewed key, so no task holds a component.  The small star comes first: it leaves
    little more than an edge for each node, so that only one join meets all edges.  It ends when each ray has one centre and
    no centre is a ray; each round is written once.  written: edges are a table that is read cheaply; repeated rows do no harm."""
    e = edges if written else materialise(edges.select("src", "dst").distinct(), "wcc")
    e = e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    while True:
        least = materialise(e.groupBy("u").agg(F.min("v").alias("m")), "wcc-least")
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "wcc")
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("ray"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("id"), F.lit(0).alias("ray"), F.lit(1).alias("centre")))).alias("e")
        roles = e.select(ends).groupBy("e.id").agg(F.sum("e.ray").alias("rays"), F.max("e.centre").alias("centre"))
        if roles.where("rays > 1 OR rays = 1 AND centre = 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "wcc-least")
        e = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "wcc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


#: Written tables that are read together, at most.
MAX_PIECES = 16


def _spread(edges: DataFrame, seeds: DataFrame, on: Sequence[str]) -> DataFrame:
    """All (on..., node) reached from seeds along edges (on..., src, dst), seeds included.

    A round writes what it reaches for the first time; what has been reached is the union of these tables, which are
    put together when they have become many."""
    reached = frontier = materialise(seeds, "spread")
    pieces = 1
    while True:
        step = frontier.withColumnRenamed("node", "src").join(edges, [*on, "src"])
        step = step.select(*on, F.col("dst").alias("node")).distinct().join(reached, [*on, "node"], "left_anti")
        frontier = materialise(step, "spread-step")
        if frontier.isEmpty():
            return reached
        reached, pieces = reached.unionByName(frontier), pieces + 1
        if pieces == MAX_PIECES:
            reached, pieces = materialise(reached, "spread"), 1


#: Edges up to which strong components are found on the driver: some megabytes.
LOCAL_EDGES = 200_000


def _strong_locally(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, label) by two depth-first searches: one orders nodes by when they are left, the other, against the edges
    and in reverse order, collects components."""
    ahead, back = {}, {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
        back.setdefault(b, []).append(a)
        back.setdefault(a, [])
    left, seen = [], set()
    for start in sorted(ahead):
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(ahead[start]))]
        while path:
            node, rest = path[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    path.append((b, iter(ahead[b])))
                    break
            else:
                left.append(node)
                path.pop()
    label = {}
    for start in reversed(left):
        if start in label:
            continue
        members, todo = [], [start]
        label[start] = start
        while todo:
            node = todo.pop()
            members.append(node)
            for b in back[node]:
                if b not in label:
                    label[b] = start
                    todo.append(b)
        least = min(members)
        for m in members:
            label[m] = least
    return sorted(label.items())


def _trimmed(left: DataFrame) -> DataFrame:
    """Edges without those whose end has no edge out, then those whose start has no edge in.

    The nodes that are kept are written first: where they are few, the planner knows it and sends them to the edges,
    which are then neither shuffled nor sorted."""
    heads = materialise(left.select(F.col("src").alias("dst")).distinct(), "scc-heads")
    cut = materialise(left.join(heads, "dst", "left_semi").select("src", "dst"), "scc-trim")
    tails = materialise(cut.select(F.col("dst").alias("src")).distinct(), "scc-tails")
    return materialise(cut.join(tails, "src", "left_semi").select("src", "dst"), "scc-trim")


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, written: bool = False) -> DataFrame:
    """node, label (smallest id in its strong component) of each endpoint.

    A graph of at most `local_edges` edges is searched on the driver; larger ones are never collected.
    Colouring: each node takes the smallest id that reaches it; what reaches that node back inside the colour is a
    component.  Nodes without edges in or out are trimmed first, and settled nodes leave the graph.  Repeated rows do no
    harm (they count as edges against `local_edges`): rows are made distinct when they have been trimmed, so no task holds
    the pairs of all its rows.
    written: edges are a table that is read cheaply."""
    plain = edges if written else materialise(edges.select("src", "dst"), "scc")
    if plain.count() <= local_edges:
        few = plain.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).distinct().collect()
        return edges.sparkSession.createDataFrame(_strong_locally([tuple(r) for r in few]), "node bigint, label bigint")
    left = plain.where("src <> dst").select("src", "dst")
    done = endpoints(plain).select(F.col("id").alias("node"), F.col("id").alias("label"))
    found, repeated = None, not written
    while True:
        n = left.count()
        while True:
            left, before = _trimmed(left), n
            if repeated:
                left, repeated = materialise(left.distinct(), "scc"), False
            n = left.count()
            if n == before:
                break
        if left.isEmpty():
            break
        colour = endpoints(left).select(F.col("id").alias("node"), F.col("id").alias("colour"))
        while True:
            pushed = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
            new = materialise(colour.join(pushed, "node", "left").select("node", F.least("colour", "other").alias("colour"), (F.coalesce("other", "colour") < F.col("colour")).alias("changed")), "scc-colour")
            colour = new.select("node", "colour")
            if new.where("changed").isEmpty():
                break
        a, b = colour.withColumnsRenamed({"node": "src", "colour": "ca"}), colour.withColumnsRenamed({"node": "dst", "colour": "cb"})
        inside = left.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("ca").alias("colour"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = _spread(materialise(inside, "scc-inside"), colour.where("node = colour").select("colour", "node"), ["colour"])
        part = members.select("node", F.col("colour").alias("label"))
        found = part if found is None else found.unionByName(part)
        ids = members.select("node")
        left = left.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = materialise(left.select("src", "dst"), "scc")
    if found is None:
        return done
    return done.join(found.withColumnRenamed("label", "f"), "node", "left").select("node", F.coalesce("f", "label").alias("label"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from roots along directed edges, the roots included."""
    plain = edges.select("src", "dst").distinct()
    return _spread(plain, roots.select(F.col("id").alias("node")).distinct(), [])


#: Roots that travel in one row: a bit each, in words of 64.
WORDS = 4


def _waves(edges: DataFrame, roots: DataFrame, max_level: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from all roots together, over undirected edges, up to a level or until nothing new is reached:
    (roots as root, batch, word, bit; what each level reaches first as batch, node, dist and b0 .. b3, the bits of the roots).

    A round is one join with the edges and one sum of bits for up to 256 roots, so its rows are as many as the
    edges, not as the edges times the roots."""
    words = [f"b{i}" for i in range(WORDS)]
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    e = materialise(edges.where("NOT src <=> dst").select(both).select("e.src", "e.dst").distinct(), "bfs-edges")
    at = with_position(roots.select(F.col("id").alias("root")).distinct(), ["root"], "at")
    at = materialise(at.select("root", F.expr(f"at div {64 * WORDS}").alias("batch"), F.expr(f"cast(at div 64 % {WORDS} as int)").alias("word"), F.expr("cast(at % 64 as int)").alias("bit")), "bfs-roots")
    own = [F.when(F.col("word") == i, F.expr("shiftleft(1L, bit)")).otherwise(0).alias(w) for i, w in enumerate(words)]
    frontier = materialise(at.select("batch", F.col("root").alias("node"), F.lit(0).alias("dist"), *own), "bfs")
    found = frontier
    seen, level = frontier.drop("dist"), 0
    while max_level is None or level < max_level:
        level += 1
        step = frontier.drop("dist").withColumnRenamed("node", "src").join(e, "src").groupBy("batch", F.col("dst").alias("node")).agg(*[F.bit_or(w).alias(w) for w in words])
        old = seen.select(F.col("batch").alias("_batch"), F.col("node").alias("_node"), *[F.col(w).alias(f"_{w}") for w in words])
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("bigint")))).alias(w) for w in words]
        step = step.join(old, (F.col("batch") == F.col("_batch")) & F.col("node").eqNullSafe(F.col("_node")), "left").select("batch", "node", F.lit(level).alias("dist"), *fresh)
        frontier = materialise(step.where(" OR ".join(f"{w} <> 0" for w in words)), "bfs")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        seen = materialise(seen.unionByName(frontier.drop("dist")).groupBy("batch", "node").agg(*[F.bit_or(w).alias(w) for w in words]), "bfs-seen")
    return at, found


def bfs_levels(edges: DataFrame, roots: DataFrame, max_level: int | None = None) -> DataFrame:
    """root, node, dist over undirected edges up to a level, or until nothing new is reached."""
    at, found = _waves(edges, roots, max_level)
    has = F.lit(False)
    for i in range(WORDS):
        has = has | ((F.col("word") == i) & (F.getbit(f"b{i}", F.col("bit")) == 1))
    return found.join(at, "batch").where(has).select("root", "node", "dist")


def distance_counts(edges: DataFrame, roots: DataFrame, max_level: int | None = None) -> DataFrame:
    """dist, n: pairs of a root and a node by their distance over undirected edges; pairs are counted by their bits and not made."""
    bits = sum((F.bit_count(f"b{i}") for i in range(WORDS)), F.lit(0)).cast("bigint")
    return _waves(edges, roots, max_level)[1].groupBy("dist").agg(F.sum(bits).alias("n"))


#: Rounds in which nodes without an edge in or out are trimmed, at most: a chain loses one node at each end a round.
TRIM_ROUNDS = 8


def closed_walks(edges: DataFrame, k: int) -> DataFrame:
    """Nodes on a closed walk of k steps (not only simple cycles).

    Nodes without an edge in or out are on none and are trimmed first.  One, two and three steps are looked up: a walk of
    three is a pair of edges that meet at the node of its three with the fewest edges, and a third edge that closes it; the
    pairs are at most the edges times the square root of their number.  Longer walks make all pairs of a start and a place,
    each step written, so they are meant for graphs whose cyclic part is small."""
    plain, n = materialise(edges.select("src", "dst").distinct(), "walk-edges"), None
    for _ in range(TRIM_ROUNDS):
        cut = plain.join(plain.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        plain = materialise(cut.join(cut.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "walk-edges")
        before, n = n, plain.count()
        if n == before:
            break
    if k == 1:
        return plain.where("src = dst").select(F.col("src").alias("id")).distinct()
    back = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if k == 2:
        return plain.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("id")).distinct()
    if k == 3:
        size = plain.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("size"))
        ranked = plain.join(size.select(F.col("id").alias("src"), F.struct("size", "id").alias("_from")), "src").join(size.select(F.col("id").alias("dst"), F.struct("size", "id").alias("_to")), "dst")
        ranked = materialise(ranked, "walk-ranked")
        into = ranked.where("_to <= _from").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        out = ranked.where("_from <= _to").select(F.col("src").alias("b"), F.col("dst").alias("c"))
        closing = plain.select(F.col("src").alias("c"), F.col("dst").alias("a"))
        return into.join(out, "b").join(closing, ["c", "a"], "left_semi").select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    walk = plain.select(F.col("src").alias("start"), F.col("dst").alias("at"))
    for _ in range(k - 2):
        walk = materialise(walk.join(plain.withColumnsRenamed({"src": "at", "dst": "to"}), "at").select("start", F.col("to").alias("at")).distinct(), "walk")
    return walk.join(plain.withColumnsRenamed({"src": "at", "dst": "start"}), ["at", "start"], "left_semi").select(F.col("start").alias("id")).distinct()


def spectral_radius(edges: DataFrame, rounds: int = 60, symmetric: bool = True) -> float:
    """Largest modulus by power iteration: a join, a sum and a norm in each round."""
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    if symmetric:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.lit(1.0).alias("w"))
    e = materialise(e, "power")
    v = endpoints(edges).select("id", F.lit(1.0).alias("x"))
    value = 0.0
    for _ in range(rounds):
        step = e.join(v.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        step = materialise(step, "power-step")
        norm = math.sqrt(step.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0)
        if norm == 0:
            return 0.0
        v = step.withColumn("x", F.col("x") / norm)
        if abs(norm - value) <= 1e-10 * norm:
            return norm
        value = norm
    return value


#: Subgraphs whose norms the driver follows together, at most.
MAX_SUBGRAPHS = 10_000


def radius_trace(edges: DataFrame, by: Sequence[str], rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """by, round, radius, last: the estimates of each subgraph's largest modulus (of its symmetrised, binary matrix) after each
    round of one power iteration of all; `last` is the one that it ended with.

    A round is one join and one sum for all subgraphs that are still going; each ends by its own residual, and its
    edges and vector are left out of later rounds.  The driver gets one norm a subgraph and round."""
    by = list(by)
    e = edges.select(*by, "src", "dst")
    e = e.unionByName(e.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = materialise(e, "radii-edges")
    v = e.select(*by, "src").distinct().withColumn("x", F.lit(1.0))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.select(*by).schema)
    last: dict[tuple, float] = {}
    trace: list[tuple] = []
    for k in range(1, rounds + 1):
        step = materialise(e.join(v, [*by, "src"]).groupBy(*by, F.col("dst").alias("src")).agg(F.sum("x").alias("x")), "radii-step")
        norms = step.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).limit(MAX_SUBGRAPHS + 1).collect()
        if len(norms) > MAX_SUBGRAPHS:
            raise ValueError(f"more than {MAX_SUBGRAPHS} subgraphs")
        going = []
        for r in norms:
            key, norm = tuple(r)[:-1], r["norm"]
            ended = k == rounds or abs(norm - last.get(key, math.inf)) <= tolerance * norm
            trace.append((*key, k, norm, ended))
            last[key] = norm
            if not ended:
                going.append((*key, norm))
        if not going:
            break
        scale = F.broadcast(e.sparkSession.createDataFrame(going, f"{keys}, norm double"))
        v = step.join(scale, by).select(*by, "src", (F.col("x") / F.col("norm")).alias("x"))
    return e.sparkSession.createDataFrame(trace, f"{keys}, round int, radius double, last boolean")


def spectral_radii(edges: DataFrame, by: Sequence[str], rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """by, radius, rounds: where each subgraph's iteration ended."""
    return radius_trace(edges, by, rounds, tolerance).where("last").select(*by, "radius", F.col("round").alias("rounds"))


def radius_impact(trace: DataFrame, by: Sequence[str], rounds: Sequence[int], target: float = 0.95, tolerance: float = 1e-6) -> DataFrame:
    """by, rounds, error, scaled, kept: what an estimate after so few rounds gets wrong: its absolute error against the final
    one, the radius that the graph really has when it is scaled to `target` by it, and whether that is the target.

    An iteration that ended earlier has its final estimate."""
    by = list(by)
    final = trace.where("last").select(*by, F.col("radius").alias("_final"))
    asked = trace.join(final, by).withColumn("rounds", F.explode(F.array(*[F.lit(k) for k in rounds])))
    used = asked.where(F.col("round") <= F.col("rounds")).groupBy(*by, "rounds").agg(F.max_by("radius", "round").alias("_used"), F.first("_final").alias("_final"))
    scaled = F.try_divide(target * F.col("_final"), F.col("_used"))
    kept = F.coalesce(F.abs(scaled - target) <= tolerance, F.lit(False))
    return used.select(*by, "rounds", F.abs(F.col("_used") - F.col("_final")).alias("error"), scaled.alias("scaled"), kept.alias("kept"))


#: Nodes of a graph whose matrix is brought to the driver, at most.
MAX_DENSE = 4000


def top_eigenvalues(edges: DataFrame, nodes: DataFrame, k: int = 8) -> list[float]:
    """Moduli of the k largest eigenvalues of (A + A') / 2, in falling order.  The graph is a selection of a checked size."""
    ids = [r.id for r in nodes.select("id").distinct().orderBy("id").limit(MAX_DENSE + 1).collect()]
    if len(ids) > MAX_DENSE:
        raise ValueError(f"more than {MAX_DENSE} nodes")
    at, a = {x: i for i, x in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for r in induced(edges, nodes).select("src", "dst", "w").toLocalIterator():
        a[at[r.dst], at[r.src]] += r.w
    return np.sort(np.abs(np.linalg.eigvalsh((a + a.T) / 2)))[::-1][:k].tolist() if ids else [0.0]


def rescaled(edges: DataFrame, radius: float, target: float) -> DataFrame:
    return edges.withColumn("w", F.col("w") * (target / radius))


def top_by_strength(s: DataFrame, k: int) -> DataFrame:
    return s.orderBy(F.desc("total"), "id").limit(k)


def grow_selection(edges: DataFrame, classes: DataFrame, s: DataFrame, seeds: int, layers: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """id, step: strongest ORN seeds, then for each layer the nodes with most contact mass to what is selected.

    A layer's order is frozen before its pass, so it is one join, one sum and one top-k, not a loop over nodes."""
    named = classes.join(s.select("id", "total"), "id")
    chosen = named.where("class = 'ORN'").orderBy(F.desc("total"), "id").limit(seeds).select("id", F.lit(0).alias("step"))
    chosen = materialise(chosen, "grow")
    for step, (kinds, room) in enumerate(layers, 1):
        have = chosen.select("id")
        mass = edges.join(have.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), "w")
        mass = mass.unionByName(edges.join(have.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), "w"))
        score = mass.groupBy("id").agg(F.sum("w").alias("score"))
        new = named.where(F.col("class").isin(*kinds)).join(have, "id", "left_anti").join(score, "id").orderBy(F.desc("score"), "id").limit(room)
        chosen = materialise(chosen.unionByName(new.select("id", F.lit(step).alias("step"))), "grow")
    return chosen


def proportional_quotas(shares: dict[str, float], capacity: dict[str, int], total: int) -> dict[str, int]:
    """Rounded (half to even) shares of total, one at least, as far as there is room; then the smallest above one shrink,
    or the largest with room grow, until they add up.

    The smallest stays the smallest while it shrinks, and the largest while it grows, so each is settled at once."""
    whole, room = sum(shares.values()) or 1.0, {k: c for k, c in capacity.items() if c > 0}
    quota = {k: min(c, max(1, round(total * shares[k] / whole))) for k, c in room.items()}
    off = sum(quota.values()) - min(total, sum(room.values()))
    order = sorted(quota, key=lambda k: (quota[k], k), reverse=off < 0)
    for k in order:
        step = min(off, quota[k] - 1) if off > 0 else -min(-off, room[k] - quota[k])
        quota[k] -= step
        off -= step
    return quota


def back_filled(chosen: DataFrame, s: DataFrame, total: int) -> DataFrame:
    """id, filled: a selection, and where it has fewer than `total` nodes, the strongest others."""
    chosen = chosen.select("id").distinct()
    more = s.join(chosen, "id", "left_anti").orderBy(F.desc("total"), "id").limit(max(0, total - chosen.count()))
    return chosen.withColumn("filled", F.lit(False)).unionByName(more.select("id", F.lit(True).alias("filled")))


#: Least numbers of nodes in each layer, and the share of input cells that ORN may take.
PN_FLOOR, FEEDBACK_FLOOR, ORN_DENSITY = 20, 20, 0.10


def layer_floors(din: int) -> tuple[int, int, int, int]:
    """Least numbers of ORN, PN, KC (with higher order) and feedback nodes for so many input channels."""
    return max(20, 2 * din), PN_FLOOR, max(50, 4 * din), FEEDBACK_FLOOR


def least_nodes(din: int, density: float = ORN_DENSITY) -> int:
    """The smallest graph that has room for all floors, and whose ORN budget covers the ORN floor."""
    floors = layer_floors(din)
    return max(sum(floors), math.ceil(floors[0] / (density * din) - 1e-9) if density * din > 0 else 1 << 30)


def orn_budget(nodes: int, din: int, available: int, density: float = ORN_DENSITY) -> int:
    return min(available, math.floor(density * din * nodes + 1e-9))


def node_budgets(din: Column, nodes: Column, available: Column, density: float = ORN_DENSITY) -> dict[str, Column]:
    """The floors of each layer, the least nodes and the ORN budget as columns, for many designs at once."""
    orn, kc = F.greatest(F.lit(20), 2 * din), F.greatest(F.lit(50), 4 * din)
    floors = orn + PN_FLOOR + kc + FEEDBACK_FLOOR
    room = F.when(density * din > 0, F.ceil(orn / (density * din) - 1e-9)).otherwise(F.lit(1 << 30))
    columns = {"orn": orn, "pn": F.lit(PN_FLOOR), "kc": kc, "feedback": F.lit(FEEDBACK_FLOOR), "least_nodes": F.greatest(floors, room), "orn_budget": F.least(available, F.floor(density * din * nodes + 1e-9))}
    return {k: c.cast("int").alias(k) for k, c in columns.items()}


def stratified_sample(nodes: DataFrame, s: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """id, class of a sample whose classes have quotas by their share of strength; a class's nodes are drawn by hash."""
    named = nodes.join(s.select("id", "total"), "id", "left").fillna(0, ["total"])
    g = {r["class"]: (float(r.t), r.n) for r in named.groupBy("class").agg(F.sum("total").alias("t"), F.count("*").alias("n")).collect()}
    quota = proportional_quotas({k: v[0] for k, v in g.items()}, {k: v[1] for k, v in g.items()}, total)
    limit = F.create_map(*[x for k, v in sorted(quota.items()) for x in (F.lit(k), F.lit(v))])[F.col("class")] if quota else F.lit(0)
    return _placed_in_class(named, draw("pick", seed, F.col("id"))).where(F.col("place") < limit).select("id", "class")


def _placed_in_class(nodes: DataFrame, order: Column) -> DataFrame:
    """nodes with their 0-based place in their class by `order` and id; no task orders a class."""
    keyed = materialise(nodes.select("id", "class", order.alias("_h")), "classed")
    placed = with_position(keyed, ["class", "_h", "id"], "_p")
    start = placed.groupBy("class").agg(F.min("_p").alias("_first"))
    return placed.join(F.broadcast(start), "class").select("id", "class", (F.col("_p") - F.col("_first")).alias("place"))


def largest_remainder(weights: DataFrame, total: int, tie: str) -> DataFrame:
    """Whole seats for each row's weight; the surplus goes by remainder, then by the `tie` column."""
    whole = F.sum("weight").over(Window.partitionBy())
    quota = F.col("weight") * total / whole
    w = weights.withColumns({"base": F.floor(quota), "rest": F.round(quota - F.floor(quota), 9)})
    surplus = F.lit(total) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), tie))
    return w.withColumn("seats", F.col("base") + (rank <= surplus).cast("int")).drop("base", "rest")


def shuffled_weights(edges: DataFrame, seed: int = 0) -> DataFrame:
    """The same edges with permuted weights (control R1): two orders by hash, joined on their places."""

    def placed(salt: str, keep: Sequence[str]) -> DataFrame:
        keyed = edges.withColumn("h", draw(salt, seed, F.col("src"), F.col("dst")))
        return with_position(keyed, ["h", "src", "dst"], "place").select("place", *keep)

    return placed("edge", ["src", "dst"]).join(placed("weight", ["w"]), "place").select("src", "dst", "w")


#: Stubs of an edge that one row stands for until they are spread over tasks, and stubs of a task.
STUB_RUN, TASK_STUBS = 4096, 250_000


def configuration_model(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Stubs matched by hash order; stubs that meet again add up, so there may be fewer edges than before.  Edges of
    weight 0 have no stubs.

    A graph of few edges may have many stubs: runs of them are dealt to tasks by their number before they become rows."""
    edges = materialise(edges.where("w > 0").select("src", "dst", F.col("w").cast("int").alias("w")), "stub-edges")
    tasks = 1 + (edges.agg(F.sum("w")).first()[0] or 0) // TASK_STUBS
    runs = edges.select("*", F.explode(F.sequence(F.lit(1), F.col("w"), F.lit(STUB_RUN))).alias("first")).repartition(tasks, "src", "dst", "first")
    stubs = runs.select("src", "dst", F.explode(F.sequence(F.col("first"), F.least("w", F.col("first") + (STUB_RUN - 1)))).alias("i"))

    def placed(name: str) -> DataFrame:
        keyed = stubs.withColumn("h", draw(name, seed, F.col("src"), F.col("dst"), F.col("i")))
        return with_position(keyed, ["h", "src", "dst", "i"], "place").select("place", name)

    return placed("src").join(placed("dst"), "place").groupBy("src", "dst").agg(F.count("*").alias("w"))


def multiset_hash(edges: DataFrame, by: Sequence[str] = ("src",)) -> DataFrame:
    """SHA-256 of each group's sorted weights."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x.cast("string")), ",")
    return edges.groupBy(*by).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def annotation_conflicts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("id").agg(F.count_distinct("class").alias("n_classes")).where("n_classes > 1")


def compare_annotations(one: DataFrame, two: DataFrame) -> DataFrame:
    """Counts of ids in both, in one only, and of those whose classes differ."""
    j = one.select("id", F.col("class").alias("c1")).join(two.select("id", F.col("class").alias("c2")), "id", "full")
    return j.agg(F.count_if(F.col("c1").isNotNull() & F.col("c2").isNotNull()).alias("n_shared"), F.count_if(F.col("c2").isNull()).alias("n_first_only"), F.count_if(F.col("c1").isNull()).alias("n_second_only"), F.count_if(F.col("c1") != F.col("c2")).alias("n_disagree"))


def subgraph_quality(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges without self-loops inside a selection, their part of all, and nodes left isolated."""
    eligible = edges.where("src <> dst")
    inside = induced(eligible, chosen)
    e = eligible.agg(F.count("*").alias("n_eligible"))
    i = inside.agg(F.count("*").alias("n_inside"))
    touched = endpoints(inside)
    iso = chosen.select("id").distinct().join(touched, "id", "left_anti").agg(F.count("*").alias("n_isolated"))
    return e.crossJoin(i).crossJoin(iso).withColumn("retention", F.try_divide("n_inside", "n_eligible"))


def selection_against_random(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, draws: int = 20, seed: int = 0) -> DataFrame:
    """One row: the selection's retained part of the edges (without self-loops) and its weak components, their means over
    random selections of its size, and the part of these that retain no more (percentile).

    All selections are one table: their edges come from one join, and their components from one search, in which each
    selection's nodes have ids of their own."""
    eligible = edges.where("src <> dst").select("src", "dst")
    n = eligible.count()
    picked = chosen.select("id").distinct()
    size, span = picked.count(), nodes.agg(F.max("id")).first()[0]
    span = (span or 0) + 1
    each = nodes.select("id").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(draw("select", seed, F.col("b"), F.col("id")), "id"))
    drawn = each.withColumn("r", rank).where(F.col("r") <= size).select("b", "id")
    every = materialise(picked.select(F.lit(-1).alias("b"), "id").unionByName(drawn), "selections")
    inside = eligible.join(every.withColumnRenamed("id", "src"), "src").join(every.withColumnRenamed("id", "dst"), ["b", "dst"])
    own = lambda c: ((F.col("b") + 1).cast("bigint") * span + F.col(c)).alias(c)
    inside = materialise(inside.select("b", own("src"), own("dst")), "selected-edges")
    labels = weak_components(inside.select("src", "dst")).withColumn("b", F.expr(f"cast(node div {span} as int)") - 1)
    joined = labels.groupBy("b").agg(F.count("*").alias("touched"), F.count_distinct("label").alias("parts"))
    kept = inside.groupBy("b").agg(F.count("*").alias("m"))
    table = every.select("b").distinct().join(kept, "b", "left").join(joined, "b", "left").fillna(0)
    table = table.select("b", (F.col("m") / F.lit(n)).alias("share"), (F.col("parts") + size - F.col("touched")).alias("parts"))
    of = lambda c, real: F.when((F.col("b") == -1) == F.lit(real), F.col(c))
    real = F.max(of("share", True)).alias("retention")
    summary = table.agg(real, F.max(of("parts", True)).alias("n_components"), F.avg(of("share", False)).alias("random_retention"), F.avg(of("parts", False)).alias("random_components"))
    beaten = table.where("b >= 0").crossJoin(F.broadcast(summary.select("retention"))).agg(F.avg((F.col("share") <= F.col("retention")).cast("double")).alias("percentile"))
    return summary.crossJoin(beaten)


def absolute_norm(edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """Weights over the sum of absolute weights of their source (kept where that is 0), times one scale that graphs to be
    compared share."""
    total = edges.groupBy("src").agg(F.sum(F.abs("w")).alias("_total"))
    w = F.col("w") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")) * scale
    return edges.join(total, "src").withColumn("w", w).drop("_total")


def input_channels(nodes: DataFrame, channels: int, seed: int = 0) -> DataFrame:
    """Each node's input channel: its place in a seeded order of its class, modulo the channels."""
    placed = _placed_in_class(nodes, draw("map", seed, F.col("id")))
    return placed.select("id", "class", (F.col("place") % channels).cast("int").alias("channel"))
