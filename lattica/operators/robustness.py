"""Robustness: degraded inputs as column expressions, the same for every model of a comparison and in any engine.

Perturbations apply to standardised inputs of the rows that are scored, never to those that a model is fitted on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw
from .metrics import classification

#: Acklam's rational approximation of the inverse normal distribution (relative error 1.2e-9): coefficients
#: of the centre's and the tails' numerators and denominators, and where the lower tail ends.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal's quantile of 0 < p < 1."""
    q = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(TAIL_TOP, q) / _polynomial(TAIL_BELOW, q)
    m = p - 0.5
    centre = m * _polynomial(CENTRE_TOP, m * m) / _polynomial(CENTRE_BELOW, m * m)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)


def gaussian(*parts: Column | str | int) -> Column:
    """A standard normal number that the parts' text determines."""
    return inverse_normal((draw(*parts) + 0.5) / F.lit(float(1 << 32)))


def noisy(rows: DataFrame, features: Sequence[str], level: float, seed: int, row_id: str) -> DataFrame:
    """Additive noise of `level` standard deviations of standardised inputs."""
    return rows.withColumns({c: F.col(c) + level * gaussian("noise", seed, c, F.col(row_id)) for c in features})


def noisy_windows(windows: DataFrame, level: float, seed: int, key: Column) -> DataFrame:
    """The same for windows x (steps of channels), which `key` tells apart."""
    step = lambda row, i: F.transform(row, lambda v, j: v + level * gaussian("noise", seed, key, i, j))
    return windows.withColumn("x", F.transform("x", step))


def dropped_windows(windows: DataFrame, share: float, seed: int, key: Column) -> DataFrame:
    """Channels of a window set to their training mean, 0 after standardisation, in a seeded share of (window, channel)."""
    off = lambda j: draw("drop", seed, key, j) < F.lit(int(share * 2**32))
    return windows.withColumn("x", F.transform("x", lambda row: F.transform(row, lambda v, j: F.when(off(j), 0.0).otherwise(v))))


def drifting_windows(windows: DataFrame, gain: float = 0.0, offset: float = 0.0) -> DataFrame:
    """x' = a x + b with a rising from 1 to 1 + gain and b from 0 to offset along a window."""
    along = lambda i: i / F.greatest(F.size("x") - 1, F.lit(1))
    return windows.withColumn("x", F.transform("x", lambda row, i: F.transform(row, lambda v: v * (1 + gain * along(i)) + offset * along(i))))


def ablations(rows: DataFrame, features: Sequence[str], name: str = "ablated") -> DataFrame:
    """The rows once as they are (`none`) and once with each feature at its training mean, 0, in turn."""
    copies = rows.withColumn(name, F.explode(F.array(*[F.lit(c) for c in ("none", *features)])))
    return copies.withColumns({c: F.when(F.col(name) == c, 0.0).otherwise(F.col(c)) for c in features})


def ablated_windows(windows: DataFrame, features: Sequence[str], name: str = "ablated") -> DataFrame:
    """The same for windows x, whose channels are the features in order."""
    copies = windows.withColumn(name, F.explode(F.array(*[F.lit(c) for c in ("none", *features)])))
    channel = F.array_position(F.array(*[F.lit(c) for c in features]), F.col(name)) - 1
    return copies.withColumn("x", F.transform("x", lambda row: F.transform(row, lambda v, j: F.when(j == channel, 0.0).otherwise(v))))


def ablation_effects(predicted: DataFrame, n_classes: int, by: Sequence[str] = (), name: str = "ablated") -> DataFrame:
    """by, ablated, macro_f1 and what it loses against `none`, of predictions (label, predicted) for ablated rows."""
    rows = predicted.select(*by, name, F.col("label").alias("truth"), F.col("predicted").cast("int").alias("predicted"))
    scored = classification(rows, n_classes, [*by, name]).select(*by, name, "macro_f1")
    whole = scored.where(F.col(name) == "none").select(*by, F.col("macro_f1").alias("_whole"))
    joined = scored.join(F.broadcast(whole), list(by)) if by else scored.crossJoin(F.broadcast(whole))
    return joined.select(*by, name, "macro_f1", (F.col("_whole") - F.col("macro_f1")).alias("loss"))
