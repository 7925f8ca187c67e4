"""A deterministic generator of sensor series: a logistic spoilage curve seen through saturating, offset sensors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SeriesSpec:
    specimens: int = 12
    steps: int = 120
    channels: int = 6
    seed: int = 20260920
    offset_sd: float = 25.0
    noise_sd: float = 1.0
    thresholds: tuple[float, ...] = (3.0, 4.0, 5.0)


def one_series(spec: SeriesSpec, index: int) -> pd.DataFrame:
    """A specimen's rows; each specimen has its own stream of random numbers, so they can be made anywhere."""
    rng = np.random.default_rng([spec.seed, index])
    t = np.arange(spec.steps)
    low, high = rng.uniform(2.2, 2.9), rng.uniform(6.0, 8.5)
    curve = 1 / (1 + np.exp(-rng.uniform(0.06, 0.16) * (t - rng.uniform(0.35, 0.75) * spec.steps)))
    tvc = low + (high - low) * curve
    level = rng.uniform(40, 220, spec.channels) + rng.normal(0, spec.offset_sd, spec.channels)
    sensors = level + np.outer(np.log1p(np.maximum(tvc - 2, 0)), rng.uniform(3, 9, spec.channels)) + rng.normal(0, spec.noise_sd, (spec.steps, spec.channels))
    out = pd.DataFrame({"specimen_id": f"sp{index:03d}", "time_index": t.astype(float)})
    for c in range(spec.channels):
        out[f"s{c + 1}"] = sensors[:, c]
    out["temperature"] = rng.uniform(3, 5) + rng.normal(0, 0.15, spec.steps)
    out["humidity"] = rng.uniform(70, 90) + rng.normal(0, 0.6, spec.steps)
    out["freshness_class"] = np.digitize(tvc, spec.thresholds).astype(np.int32)
    out["tvc"] = tvc
    return out


def generate(spark: SparkSession, spec: SeriesSpec | None = None) -> DataFrame:
    """All series, made on the executors."""
    spec = spec or SeriesSpec()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                yield one_series(spec, int(i))

    channels = ", ".join(f"s{c + 1} double" for c in range(spec.channels))
    return spark.range(spec.specimens).mapInPandas(rows, f"specimen_id string, time_index double, {channels}, temperature double, humidity double, freshness_class int, tvc double")
