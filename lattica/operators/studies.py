"""Compositions: leakage inflation, unit bootstrap, exact signed-rank tests, structure and candidate selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..storage import materialise
from . import graph, metrics, reservoir
from .ordering import with_position

#: Pairs up to which the signed-rank distribution is exact.
EXACT_PAIRS = 50


def signed_rank_p(deltas: np.ndarray) -> tuple[float, float, str]:
    """(statistic, two-sided p, test).  All zero: p is 1.  Fewer than six non-zero pairs: the sign test instead.  Exact
    without ties or zeros and with few pairs, else normal with the tie correction; zeros are dropped."""
    d = deltas[deltas != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0, "sign_test"
    if n < 6:
        top = max(int((d > 0).sum()), int((d < 0).sum()))
        return float(top), min(1.0, 2 * sum(math.comb(n, i) for i in range(top, n + 1)) / 2**n), "sign_test"
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    values, start, count = np.unique(size[order], return_index=True, return_counts=True)
    rank = np.repeat(start + (count + 1) / 2, count)
    ranks = np.empty(n)
    ranks[order] = rank
    plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
    w = min(plus, minus)
    if len(values) == n == len(deltas) and n <= EXACT_PAIRS:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)), "wilcoxon_exact"
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48
    z = (w - mean) / math.sqrt(var) if var > 0 else 0.0
    return float(w), float(min(1.0, math.erfc(abs(z) / math.sqrt(2)))), "wilcoxon_normal"


def signed_rank_tests(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, statistic, p_value, test; a group is one contrast's pairs."""
    kinds = ", ".join(f"{c} {deltas.schema[c].dataType.simpleString()}" for c in by)

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *signed_rank_p(rows["delta"].dropna().to_numpy(float)))], columns=[*by, "statistic", "p_value", "test"])

    return deltas.select(*by, "delta").groupBy(*by).applyInPandas(test, f"{kinds}, statistic double, p_value double, test string")


def unit_bootstrap_f1(rows: DataFrame, unit: str, n_classes: int, draws: int, seed: int) -> DataFrame:
    """Interval of the pooled macro F1 over resampled units.  Each unit's confusion is counted once; a draw only adds up
    counts of the units that it picks."""
    both = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e")
    counted = rows.groupBy(unit, "truth", "predicted").agg(F.count("*").alias("n"))
    each = counted.select(unit, "n", both, (F.col("truth") == F.col("predicted")).cast("int").alias("hit"))
    parts = each.groupBy(unit, "e.label").agg(F.sum(F.col("n") * F.col("e.t")).alias("support"), F.sum(F.col("n") * F.col("e.p")).alias("named"), F.sum(F.col("n") * F.col("e.t") * F.col("hit")).alias("tp"))
    place = with_position(materialise(rows.select(unit).distinct(), "units"), [unit], "place")
    n = place.count()
    picks = place.select(F.col("place").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    picks = picks.select("b", (draw(str(seed), F.col("b"), F.col("j")) % max(1, n)).cast("int").alias("place")).groupBy("b", "place").agg(F.count("*").alias("times"))
    summed = picks.join(place, "place").join(parts, unit).groupBy("b", "label").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("support", "named", "tp")])
    f1 = summed.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("named")), F.lit(0.0)))
    per = f1.groupBy("b").agg((F.sum("f1") / n_classes).alias("macro_f1"))
    q = F.percentile("macro_f1", F.array(F.lit(0.025), F.lit(0.975)))
    return per.agg(F.avg("macro_f1").alias("mean"), q.alias("q")).select("mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def centroid_predictions(rows: DataFrame, fold: str, value: str, label: str = "freshness_class") -> DataFrame:
    """Each row's nearest class centroid, fitted on the other folds: sums by fold and class, minus the row's own fold."""
    sums = rows.groupBy(fold, label).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(label).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = rows.select(fold).distinct()
    out = folds.crossJoin(F.broadcast(total)).join(sums, [fold, label], "left").fillna(0, ["s", "n"])
    centroids = out.where("tn > n").select(fold, F.col(label).alias("_class"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("_c"))
    table = centroids.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct("_class", "_c"))).alias("_t"))
    best = F.array_min(F.transform("_t", lambda x: F.struct(F.round(F.abs(F.col(value) - x["_c"]), 9).alias("d"), x["_class"].alias("k"))))
    return rows.join(table, fold).withColumns({"truth": F.col(label), "predicted": best["k"]}).drop("_t")


def leakage_inflation(rows: DataFrame, value: str, n_classes: int, grouped: str, naive: str) -> DataFrame:
    """Macro F1 of the same predictor under grouped and naive folds, and the difference."""
    one = metrics.classification(centroid_predictions(rows, grouped, value), n_classes).select(F.col("macro_f1").alias("grouped_f1"))
    two = metrics.classification(centroid_predictions(rows, naive, value), n_classes).select(F.col("macro_f1").alias("naive_f1"))
    return one.crossJoin(two).withColumn("inflation", F.col("naive_f1") - F.col("grouped_f1"))


def structure(edges: DataFrame) -> DataFrame:
    """Parts of nodes in the largest weak and strong component, and of edges inside strong components of two or more."""
    edges = materialise(edges.select("src", "dst"), "structure")
    n = graph.endpoints(edges).count()
    strong = materialise(graph.strong_components(edges, written=True), "structure-strong")
    weak = graph.weak_components(edges, written=True)
    top = lambda c: c.groupBy("label").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(1)).alias("k"))
    # only components of two or more have edges inside; their nodes are written, so that few of them are sent to the edges
    several = strong.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select("label")
    cyclic = materialise(strong.join(several, "label"), "structure-cyclic")
    a, b = cyclic.select(F.col("node").alias("src"), F.col("label").alias("la")), cyclic.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    hits = edges.where("src <> dst").join(a, "src").join(b, "dst").where("la = lb").agg(F.count("*").alias("hits"))
    cyc = hits.crossJoin(edges.agg(F.count_if(F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("m"))).select(F.try_divide("hits", "m").alias("cycle_edges"))
    s, w = top(strong).withColumnRenamed("k", "s"), top(weak).withColumnRenamed("k", "w")
    return s.crossJoin(w).crossJoin(cyc).select(F.lit(n).cast("bigint").alias("n"), (F.col("w") / n).alias("weak_fraction"), (F.col("s") / n).alias("strong_fraction"), "cycle_edges")


def candidate_substrates(edges: DataFrame, classes: DataFrame, strengths: DataFrame, seeds: int, layers: Sequence[tuple[Sequence[str], int]], cap: int) -> DataFrame:
    """candidate, id.  S0 grows from seeds; S1 and S3 close it under feedback classes, S4 under both; S2 is centred on
    KC and the PN that reach them.  Each is capped by strength."""
    s0 = graph.grow_selection(edges, classes, strengths, seeds, layers).select("id")
    named = graph.classed(edges, classes)
    inside = s0.withColumnRenamed("id", "dst")
    back = lambda *kinds: named.where(F.col("pre").isin(*kinds)).join(inside, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    kc = classes.where("class = 'KC'").select("id")
    pn = named.where("pre = 'PN' AND post = 'KC'").select(F.col("src").alias("id")).distinct()
    sets = {"S0": s0, "S1": s0.union(back("MBON")), "S2": kc.union(pn), "S3": s0.union(back("DAN", "APL")), "S4": s0.union(back("MBON", "DAN", "APL"))}
    out = None
    for name, ids in sets.items():
        top = ids.distinct().join(strengths.select("id", "total"), "id").orderBy(F.desc("total"), "id").limit(cap).select(F.lit(name).alias("candidate"), "id")
        out = top if out is None else out.unionByName(top)
    return out


def best_candidate(scores: DataFrame, gate: float) -> DataFrame:
    """The eligible candidate (s1 at least the gate) with the highest s1, then s2, then the fewest nodes; none: empty."""
    return scores.where(F.col("s1") >= gate).orderBy(F.desc("s1"), F.desc("s2"), "n", "candidate").limit(1)


def topology_family(a: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """R0 the graph; R1 permuted weights; R2 weight-preserving rewire; R3 random cells, as many as its edges; R4 and R6
    random cells at a density of 0.05 and 0.5; R5 small world.  Controls have the graph's spectral radius."""
    n, rng = len(a), np.random.default_rng(seed)
    dst, src = np.nonzero(a)
    w, m, target = a[dst, src], len(src), reservoir.spectral_radius(a)

    def matrix(s: np.ndarray, d: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((n, n))
        out[d, s] = values
        return reservoir.scaled(out, target)

    off = src != dst
    s2, d2, w2 = reservoir.rewired(src[off], dst[off], w[off], 4 * int(off.sum()), seed)
    family = {"R0": a, "R1": matrix(src, dst, rng.permutation(w)), "R2": matrix(s2, d2, w2)}
    for name, edges in (("R3", m), ("R4", max(1, round(0.05 * n * n))), ("R6", max(1, round(0.5 * n * n)))):
        s, d = reservoir.random_graph(n, edges, seed + len(family))
        family[name] = matrix(s, d, rng.uniform(-1, 1, len(s)))
    s, d = reservoir.small_world(n, max(1, round(m / n)), 0.1, seed)
    family["R5"] = matrix(s, d, rng.uniform(-1, 1, len(s)))
    return dict(sorted(family.items()))


def constraint_match(reference: np.ndarray, other: np.ndarray) -> dict[str, float]:
    return {"n": float(len(other) - len(reference)), "m": float((other != 0).sum() - (reference != 0).sum()), "rho": reservoir.spectral_radius(other) - reservoir.spectral_radius(reference)}


def drive_gate(a: np.ndarray, b: np.ndarray, x: np.ndarray, gain: float, band: tuple[float, float] = (0.20, 1.00)) -> dict[str, float | bool]:
    """Median ratio of recurrent to input drive, memory lost without recurrence, and the state's rank."""
    n = len(a)
    states, ratio = reservoir.Reservoir(a, b, np.zeros(n), gain=gain).trace(x)
    still = reservoir.Reservoir(np.zeros_like(a), b, np.zeros(n), gain=gain).trace(x)[0]
    m, m0 = reservoir.memory(states, x, 20), reservoir.memory(still, x, 20)
    r = float(np.median(ratio[1:])) if len(ratio) > 1 else 0.0
    drop = (m - m0) / m if m > 0 else 0.0
    return {"ratio": r, "in_band": band[0] <= r <= band[1], "memory_drop": drop, "rank": reservoir.participation_rank(states), "gain": gain}


def search_gain(a: np.ndarray, b: np.ndarray, x: np.ndarray, gains: Sequence[float], band: tuple[float, float] = (0.20, 1.00)) -> dict[str, float | bool]:
    """The gain whose drive ratio is nearest to the band's centre."""
    centre = sum(band) / 2
    return min((drive_gate(a, b, x, g, band) for g in gains), key=lambda r: (abs(r["ratio"] - centre), r["gain"]))


def radius_ladder(a: np.ndarray, b: np.ndarray, x: np.ndarray, radii: Sequence[float]) -> list[tuple[float, float]]:
    """(spectral radius, memory) with the graph rescaled to each radius."""
    return [(r, reservoir.memory(reservoir.Reservoir(reservoir.scaled(a, r), b, np.zeros(len(a))).trace(x)[0], x, 20)) for r in radii]


#: Tries of the search for coprime lengths; sums that have any are found in far fewer.
COPRIME_TRIES = 50_000


def coprime_lengths(n: int, blocks: int) -> list[int]:
    """Lengths of at least 2, pairwise coprime, that add up to n: the blocks' sizes are as even as the search finds them.

    At most one of them is even, and the parity of n says whether one is; it is chosen first, and odd ones near the mean
    of what is left follow.  Sums too small for that are searched again from the smallest lengths.  Where no lengths are
    found within COPRIME_TRIES, it is an error."""
    tries, rising = 0, False

    def search(left: int, count: int, chosen: list[int], even: bool) -> list[int] | None:
        nonlocal tries
        tries += 1
        if tries > COPRIME_TRIES:
            return None
        if count == 1:
            return [*chosen, left] if left >= 2 and left % 2 != even and all(math.gcd(left, c) == 1 for c in chosen) else None
        mean, most = left / count, left - 2 * (count - 1)
        start = round(mean)
        for size in range(2, most + 1) if rising else (start + d for step in range(most) for d in {-step, step}):
            if 2 <= size <= most and size % 2 != even and all(math.gcd(size, c) == 1 for c in chosen):
                found = search(left - size, count - 1, [*chosen, size], False)
                if found or tries > COPRIME_TRIES:
                    return found
        return None

    for rising in (False, True) if blocks >= 1 else ():
        tries = 0
        if found := search(n, blocks, [], (n - blocks) % 2 == 1):
            return found
    raise ValueError(f"{n} is no sum of {blocks} pairwise coprime lengths, or none was found")


#: Accepted swaps for each edge of the statistics-matched family.
SWAPS_PER_EDGE = 10


def audit_families(a: np.ndarray, b: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """F1 the graph; F2 its weight-preserving rewire; F3 as many random cells with its weights; F5 directed cycles of
    coprime lengths with chords inside them, at its number of edges.  All have F1's spectral radius."""
    n, rng = len(a), np.random.default_rng(seed)
    dst, src = np.nonzero(a)
    w, target = a[dst, src], reservoir.spectral_radius(a)

    def matrix(s: np.ndarray, d: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((n, n))
        out[d, s] = values
        return reservoir.scaled(out, target)

    off = src != dst
    s2, d2, w2 = reservoir.rewired(src[off], dst[off], w[off], SWAPS_PER_EDGE * int(off.sum()), seed)
    s3, d3 = reservoir.random_graph(n, int(off.sum()), seed)
    cells, start = set(), 0
    for size in coprime_lengths(n, max(2, min(8, n // 125))):
        cells |= {(start + i, start + (i + 1) % size) for i in range(size)}
        free = [(start + i, start + j) for i in range(size) for j in range(size) if i != j and (i + 1) % size != j]
        quota = min(len(free), round(max(0, len(src) - n) * size / n))
        cells |= {free[k] for k in rng.choice(len(free), quota, replace=False)} if quota else set()
        start += size
    s5, d5 = (np.array(x) for x in zip(*sorted(cells), strict=True))
    return {"F1": a, "F2": matrix(s2, d2, w2), "F3": matrix(s3, d3, rng.permutation(w[off])[: len(s3)]), "F5": matrix(s5, d5, np.ones(len(s5)))}


def closed_walk_nodes(a: np.ndarray, longest: int = 12) -> list[int]:
    """Nodes on a closed walk of each length from 1."""
    step, walk, out = a != 0, np.eye(len(a), dtype=bool), []
    for _ in range(longest):
        walk = (walk.astype(np.float32) @ step.astype(np.float32)) > 0
        out.append(int(np.diag(walk).sum()))
    return out


def organisation_feasible(one: np.ndarray, two: np.ndarray, labels: Sequence[str], b1: np.ndarray, b2: np.ndarray, strong: tuple[float, float], chosen_by_result: bool, min_change: float = 0.05, tolerance: float = 0.02) -> dict[str, bool]:
    """Six conditions for a rewired graph to differ in organisation only; `feasible` is all of them.  Recurrence is kept if
    the largest component's share is, and closed walks exist at the same lengths."""
    types = sorted(set(labels))
    hot = np.array([[lab == t for t in types] for lab in labels], float)
    before, after = hot.T @ np.abs(one) @ hot, hot.T @ np.abs(two) @ hot
    degrees = all(((one != 0).sum(k) == (two != 0).sum(k)).all() for k in (0, 1))
    cycles = [[k for k, n in enumerate(closed_walk_nodes(a), 1) if n] for a in (one, two)]
    w1, w2 = np.sort(one[one != 0]), np.sort(two[two != 0])
    found = {
        "type_pairs_changed": bool(np.abs(after - before).sum() / max(before.sum(), 1e-12) >= min_change),
        "degrees_kept": bool(degrees),
        "weights_kept": bool(len(w1) == len(w2) and np.allclose(w1, w2, rtol=1e-9)),
        "inputs_kept": bool(b1.shape == b2.shape and ((b1 != 0) == (b2 != 0)).all()),
        "recurrence_kept": bool(abs(strong[0] - strong[1]) <= tolerance and cycles[0] == cycles[1]),
        "chosen_blindly": not chosen_by_result,
    }
    return {**found, "feasible": all(found.values())}


def contrast_matrix_problems(families: DataFrame) -> DataFrame:
    """problem, id, other: a row for each fault of a matrix of families (id, parent, varied, fixed: an array, blocked).

    Each check is a query of its own: aggregates, anti-joins and self-joins over the families."""
    f = families.select("id", "parent", F.lower(F.trim(F.coalesce("varied", F.lit("")))).alias("varied"), F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    none = F.lit(None).cast("string").alias("other")
    say = lambda df, text, other=none: df.select(F.lit(text).alias("problem"), "id", other)
    open_ = f.where("NOT blocked")
    factor = open_.select("varied", F.col("id").alias("other"))
    inside = f.where("id = 'F3'").select(F.col("fixed").alias("less")).crossJoin(f.where("id = 'F2'"))
    strictly = (F.size(F.array_except("less", "fixed")) == 0) & (F.size(F.array_except("fixed", "less")) > 0)
    checks = [
        say(f.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated"),
        say(f.where("parent IS NULL AND id <> 'F1'"), "no parent"),
        say(f.join(f.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti").where("parent IS NOT NULL"), "unknown parent", F.col("parent").alias("other")),
        say(open_.join(factor, "varied").where("id < other"), "same factor", F.col("other")),
        say(inside.where(~strictly), "holds no more fixed than F3", F.lit("F3").alias("other")),
        say(f.where("id = 'F1' AND NOT startswith(varied, 'none')"), "reference varies"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
