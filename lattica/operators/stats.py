"""Paired statistics over clusters: sign test, bootstrap, effect sizes, equivalence and multiplicity.

All are native expressions and aggregates.  What is gathered in an array belongs to one contrast: its
clusters or its paired runs, of which an experiment has hundreds, not rows of data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw
from ..storage import materialise
from .ordering import with_position

BOOTSTRAP_DRAWS, BOOTSTRAP_SEED = 10_000, 20260920
ALPHA = 0.05


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, drop_missing: bool = True) -> DataFrame:
    """keys, a, b and delta of rows that both sides have."""
    joined = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), list(keys))
    if drop_missing:
        joined = joined.where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")
    return joined.withColumn("delta", F.round(F.col("a") - F.col("b"), 9))


def contrast_deltas(observations: DataFrame, contrasts: DataFrame, keys: Sequence[str], value: str, model: str = "model") -> DataFrame:
    """All contrasts (contrast, first, second) at once: one plan, no driver loop."""
    side = lambda role, name: contrasts.select("contrast", F.col(role).alias(model)).join(observations, model).select("contrast", *keys, F.col(value).alias(name))
    both = side("first", "a").join(side("second", "b"), ["contrast", *keys]).where("a IS NOT NULL AND b IS NOT NULL")
    return both.withColumn("delta", F.round(F.col("a") - F.col("b"), 9))


def asymmetry(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("only", F.lit("first")).unionByName(b.join(a, list(keys), "left_anti").withColumn("only", F.lit("second")))


def cluster_means(deltas: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    return deltas.groupBy(*by, cluster).agg(F.round(F.avg("delta"), 9).alias("mean_delta"), F.count("*").alias("n_pairs"))


def two_sided_sign_p(pos: Column, neg: Column) -> Column:
    """min(1, 2 P(X >= max)) for X binomial at one half; 1 without signs.

    P(X >= max) = P(max) (1 + q1 + q1 q2 + ...) with q_i the ratio of neighbouring terms, and P(max) comes from a sum of
    logarithms, so nothing overflows however many signs there are."""
    n, top = pos + neg, F.greatest(pos, neg)
    steps = F.sequence(F.lit(1), (n - top).cast("int"))
    log_p = F.aggregate(F.when(n > top, steps), -n * math.log(2), lambda s, i: s + F.log((top + i) / i))
    tail = F.aggregate(
        F.when(n > top, steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (n - top - i + 1) / (top + i)).alias("term"), (s["sum"] + s["term"] * (n - top - i + 1) / (top + i)).alias("sum")),
    )
    p = F.when(n > top, F.exp(log_p) * tail["sum"]).otherwise(F.pow(F.lit(2.0), -n))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * p))


def minimum_p(n: Column) -> Column:
    return F.when(n <= 0, float("nan")).otherwise(F.least(F.lit(1.0), 2 / F.pow(F.lit(2.0), n)))


def clusters_needed(alpha: float = ALPHA) -> int:
    n = 1
    while min(1.0, 2 / 2**n) > alpha:
        n += 1
    return n


def sign_test(means: DataFrame, by: Sequence[str]) -> DataFrame:
    pos, neg = F.count_if(F.col("mean_delta") > 0), F.count_if(F.col("mean_delta") < 0)
    c = means.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.count("*").alias("n_clusters"))
    n = F.col("n_pos") + F.col("n_neg")
    return c.withColumns({"p_value": two_sided_sign_p(F.col("n_pos"), F.col("n_neg")), "minimum_p": minimum_p(n), "n_nonzero": n})


def average_rank(by: Sequence[str], value: Column) -> Column:
    """Rank with ties averaged, inside each group."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def signed_ranks(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """rank_biserial (0 without non-zero deltas) and the Wilcoxon statistic min(R+, R-)."""
    nonzero = deltas.where("delta <> 0").withColumn("size", F.abs("delta"))
    ranked = nonzero.withColumn("rank", average_rank(by, F.col("size")))
    plus, minus = F.sum(F.when(F.col("delta") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("delta") < 0, F.col("rank")).otherwise(0.0))
    sums = ranked.groupBy(*by).agg(plus.alias("r_plus"), minus.alias("r_minus"), F.count("*").alias("n_nonzero"))
    every = deltas.select(*by).distinct().join(sums, list(by), "left").fillna(0, ["r_plus", "r_minus", "n_nonzero"])
    total = F.col("r_plus") + F.col("r_minus")
    return every.select(*by, "n_nonzero", F.when(total == 0, 0.0).otherwise((F.col("r_plus") - F.col("r_minus")) / total).alias("rank_biserial"), F.least("r_plus", "r_minus").alias("statistic"))


#: Deltas of one contrast whose Walsh averages are listed, at most: 4 million averages.  The median of more is found by counting.
MAX_WALSH = 2000


def walsh_median(d: np.ndarray) -> float:
    """Median of (x + y) / 2 over all ordered pairs, without listing them: the two middle sums are searched by bisection over
    the floating-point numbers, counting the pairs up to a number in each step."""
    x = np.sort(np.asarray(d, float)) + 0.0  # no -0.0
    n = len(x)
    if not n:
        return float("nan")

    def up_to(t: float) -> int:
        at = np.searchsorted(x, t - x, "right")
        while True:  # t - x is rounded, the sums decide
            more = (at < n) & (x[np.minimum(at, n - 1)] + x <= t)
            less = (at > 0) & (x[np.maximum(at - 1, 0)] + x > t) & ~more
            if not (more.any() or less.any()):
                return int(at.sum())
            at = at + more - less

    order = lambda v: int(np.float64(v).view(np.int64)) if v >= 0 else -int(np.float64(-v).view(np.int64))
    number = lambda i: float(np.int64(i).view(np.float64)) if i >= 0 else -float(np.int64(-i).view(np.float64))

    def smallest(k: int) -> float:
        low, high = order(2 * x[0]), order(2 * x[-1])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if up_to(number(middle)) >= k else (middle + 1, high)
        return number(low)

    return (smallest((n * n + 1) // 2) + smallest(n * n // 2 + 1)) / 4


def hodges_lehmann(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median of all ordered Walsh averages inside each contrast: listed for at most MAX_WALSH deltas, counted for more.
    A contrast's deltas are one task's."""
    sized = deltas.where(F.col("delta").isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    d = sized.where(F.col("_n") <= MAX_WALSH).groupBy(*by).agg(F.collect_list("delta").alias("d"))
    walsh = F.flatten(F.transform("d", lambda x: F.transform("d", lambda y: (x + y) / 2)))
    each = d.select(*by, F.explode(walsh).alias("w"))
    few = each.groupBy(*by).agg(F.percentile("w", F.lit(0.5)).alias("hodges_lehmann"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[list(by)].iloc[:1].assign(hodges_lehmann=walsh_median(rows["delta"].to_numpy(float)))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in deltas.select(*by).schema), "hodges_lehmann double"])
    many = sized.where(F.col("_n") > MAX_WALSH).select(*by, F.col("delta").cast("double").alias("delta")).groupBy(*by).applyInPandas(count, schema)
    return few.unionByName(many)


def bootstrap_ci(means: DataFrame, by: Sequence[str], cluster: str, draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED, level: float = 0.95, value: str = "mean_delta") -> DataFrame:
    """Percentile interval of the mean over resampled clusters.  The draws come from a portable hash, so any engine
    repeats them; fewer than two clusters give no interval."""
    sorted_means = F.transform(F.array_sort(F.collect_list(F.struct(F.col(cluster), F.col(value).alias("m")))), lambda s: s["m"])
    g = means.groupBy(*by).agg(sorted_means.alias("m"), F.avg(value).alias("estimate")).where(F.size("m") >= 2)
    each = g.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda j: F.element_at("m", (draw(str(seed), F.col("b"), j) % F.size("m")).cast("int") + 1))
    mean = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.size("m")
    tail = (1 - level) / 2
    out = each.withColumn("mean", mean).groupBy(*by).agg(F.first("estimate").alias("estimate"), F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return out.select(*by, "estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def equivalence(low: Column, high: Column, margin: float, alpha: float = ALPHA) -> tuple[Column, Column]:
    """(proxy p, equivalent): the interval lies strictly inside the margin, or the proxy grows with the overhang."""
    if margin <= 0:
        return F.lit(1.0), F.lit(False)
    inside = (low > -margin) & (high < margin)
    over = F.greatest(F.abs(low + margin), F.abs(high - margin), F.lit(1e-12))
    return F.when(inside, 0.0).otherwise(F.least(F.lit(1.0), alpha * (1 + over))), inside


def favours_first(low: Column, high: Column, higher_is_better: bool = True) -> Column:
    return low > 0 if higher_is_better else high < 0


def holm(tests: DataFrame, family: Sequence[str], p: str = "p_value", tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values inside each family; `tie` orders equal ones."""
    w = Window.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(p, *tie))
    stepped = tests.withColumn("_step", (F.count("*").over(w) - rank + 1) * F.col(p))
    run = w.orderBy(p, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(run))).drop("_step")


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks (NaN where one is constant)."""
    ranked = rows.withColumns({"_rx": average_rank(by, F.col(x)), "_ry": average_rank(by, F.col(y))})
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))  # corr fails on constants under ANSI
    return ranked.groupBy(*by).agg(F.coalesce(rho, F.lit(float("nan"))).alias("rho"), F.count("*").alias("n"))


def spearman_interval(rows: DataFrame, by: Sequence[str], key: Sequence[str], x: str, y: str, draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED, level: float = 0.95) -> DataFrame:
    """by, rho, ci_low, ci_high, n, n_draws: the percentile interval of Spearman's rho over resampled rows.

    `key` orders a group's rows; draw j of resample b is the row at place hash(seed, b, j) mod n, so any engine repeats it.
    A resample is a multiplicity of each distinct pair (x, y); ranks with ties averaged come from running totals of
    these, so no resample's rows are made or sorted.  Resamples in which x or y is constant are left out (n_draws
    counts the others); rho is NaN where one is constant in all rows, and the interval then null."""
    by, given = list(by), rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    given = given.select(*by, *[c for c in key if c not in by], F.col(x).alias("_x"), F.col(y).alias("_y"))
    placed = materialise(with_position(materialise(given, "rho-rows"), [*by, *key], "_p"), "rho-placed")
    size = placed.groupBy(*by).agg(F.min("_p").alias("_first"), F.count("*").alias("_n"))
    at = placed.join(size, by).select(*by, "_x", "_y", "_n", (F.col("_p") - F.col("_first")).alias("_at"))
    each = at.select(*by, "_n", "_at", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_b"))
    times = each.groupBy(*by, "_b", (draw(str(seed), F.col("_b"), F.col("_at")) % F.col("_n")).alias("_at")).agg(F.count("*").alias("_m"))
    cells = times.join(at.drop("_n"), [*by, "_at"]).groupBy(*by, "_b", "_x", "_y").agg(F.sum("_m").alias("_m"))
    plain = Window.partitionBy(*by, "_b")
    rank = lambda c: F.sum("_m").over(plain.orderBy(c)) - (F.sum("_m").over(Window.partitionBy(*by, "_b", c)) - 1) / 2
    ranked = cells.withColumns({"_rx": rank("_x"), "_ry": rank("_y")}).withColumn("_mid", (F.sum("_m").over(plain) + 1) / 2)
    dx, dy, m = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid"), F.col("_m")
    rho = F.try_divide(F.sum(m * dx * dy), F.sqrt(F.sum(m * dx * dx)) * F.sqrt(F.sum(m * dy * dy)))
    tail = (1 - level) / 2
    drawn = ranked.groupBy(*by, "_b").agg(rho.alias("_rho"))
    out = drawn.groupBy(*by).agg(F.percentile("_rho", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"), F.count("_rho").alias("n_draws"))
    return spearman(given, by, "_x", "_y").join(out, by).select(*by, "rho", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "n", "n_draws")


def distribution(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*by, "n", "mean", "sd", *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "min", "max")


def cohens_d(rows: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Mean difference of the greater and the smaller group label over the pooled sample deviation."""
    s = rows.groupBy(*by, group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    two = s.groupBy(*by).agg(F.max_by("m", group).alias("m1"), F.min_by("m", group).alias("m0"), F.sum((F.col("n") - 1) * F.col("v")).alias("ss"), F.sum(F.col("n") - 1).alias("df"))
    return two.select(*by, F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(F.col("ss") / F.col("df"))).alias("d"))


def histogram_overlap(rows: DataFrame, by: Sequence[str], group: str, value: str, bins: int = 20) -> DataFrame:
    """Sum of the smaller share of two groups over equal bins of the pooled range; the last bin is closed."""
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(bounds, list(by)) if by else rows.crossJoin(F.broadcast(bounds))
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))))
    counts = joined.groupBy(*by, F.coalesce(at, F.lit(0)).alias("bin"), group).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*by, group))
    shares = counts.withColumn("share", share).groupBy(*by, "bin").agg(F.min("share").alias("low"), F.count("*").alias("sides"))
    return shares.groupBy(*by).agg(F.sum(F.when(F.col("sides") == 2, F.col("low")).otherwise(0.0)).alias("overlap"))
