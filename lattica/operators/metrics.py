"""Classification and regression metrics as aggregates over (truth, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .ordering import with_running_total


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall and F1 of each declared class (0 where undefined), from one pass over the rows."""
    both = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e")
    counts = materialise(confusion(rows, by), "confusion") if by else confusion(rows, by)  # read twice below
    parts = counts.select(*by, "n", both, (F.col("truth") == F.col("predicted")).cast("int").alias("hit"))
    sums = parts.groupBy(*by, "e.label").agg(F.sum(F.col("n") * F.col("e.t")).alias("support"), F.sum(F.col("n") * F.col("e.p")).alias("n_predicted"), F.sum(F.col("n") * F.col("e.t") * F.col("hit")).alias("tp"))
    spark = rows.sparkSession
    declared = spark.range(n_classes).select(F.col("id").cast("int").alias("label"))
    every = (counts.select(*by).distinct().crossJoin(declared)) if by else declared
    full = every.join(sums, [*by, "label"], "left").fillna(0, ["support", "n_predicted", "tp"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return full.withColumns({"precision": ratio(F.col("tp"), F.col("n_predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("n_predicted"))})


def classification(rows: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """macro_f1 over declared classes, macro_f1_present over those in truth or prediction, balanced_accuracy over classes
    in truth, accuracy, n."""
    c = per_class(rows, n_classes, by)
    present = F.col("support") + F.col("n_predicted") > 0
    return c.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1_present"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
    )


def auroc_ovr(scores: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Macro one-vs-rest AUROC, null unless every class has finite scores on both sides.

    scores: truth, label, score, a row for each row and class.  Equal scores are counted together, and the rows before
    each score come from ranges of all scores, so no task orders a class's scores."""
    keys = [*by, "label"]
    good = scores.where(~F.isnan("score") & F.col("score").isNotNull() & (F.abs("score") != float("inf")))
    pos = F.count_if(F.col("truth") == F.col("label"))
    ties = good.groupBy(*keys, "score").agg(pos.alias("pos"), F.count("*").alias("n"))
    ties = materialise(ties, "auroc-ties")  # what deals rows by range reads them twice
    placed = with_running_total(ties, [*keys, "score"], "n", "_before")
    start = placed.groupBy(*keys).agg(F.min("_before").alias("_start"))
    ranked = placed.join(start, keys).withColumn("rank", F.col("_before") - F.col("_start") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))))
    done = sums.withColumn("auc", auc)
    defined = F.count("auc")
    return done.groupBy(*by).agg(F.when(defined == n_classes, F.avg("auc")).alias("auroc"), defined.alias("n_classes_scored"))


def regression(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, r2 of target and estimate.  r2 is NaN for fewer than two rows; for a constant target it is 1 if all
    estimates are exact, else 0."""
    e = F.col("target") - F.col("estimate")
    sst, sse = F.var_pop("target") * F.count("target"), F.sum(e * e)
    constant = F.when(sse == 0, 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.count("*") <= 1, float("nan")).when(F.min("target") == F.max("target"), constant).otherwise(1 - F.try_divide(sse, sst)).alias("r2"),
        F.count("*").alias("n"),
    )


def observed_classes(rows: DataFrame) -> DataFrame:
    return rows.agg((F.greatest(F.max("truth"), F.max("predicted")) + 1).alias("n_classes"))
