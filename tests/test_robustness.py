from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import models, records, robustness


def test_inverse_normal_equals_the_closed_form(spark):
    p = [1e-9, 1e-4, 0.02424, 0.02426, 0.3, 0.5, 0.7, 0.97574, 0.97576, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = [r[0] for r in df.select(robustness.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=2e-8, abs=1e-8)


def test_noise_is_normal_and_repeats(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    one, two = (robustness.noisy(d, ["a", "b"], 0.5, 3, "id") for d in (df, df.repartition(7)))
    x = np.array([r[1:] for r in one.orderBy("id").collect()])
    assert np.array_equal(x, np.array([r[1:] for r in two.orderBy("id").collect()]))
    assert abs(x.mean()) < 0.02 and abs(x.std() - 0.5) < 0.02 and abs(np.corrcoef(x.T)[0, 1]) < 0.05
    assert abs((np.abs(x) < 0.5).mean() - (2 * NormalDist().cdf(1) - 1)) < 0.02


def windows(spark, n=60):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 5, 3))
    return spark.createDataFrame([(i, v.tolist(), int(v[:, 0].sum() > 0)) for i, v in enumerate(x)], "id int, x array<array<double>>, label int"), x


def back(df):
    return np.array([r["x"] for r in df.orderBy("id").collect()])


def test_windows_drift_lose_channels_and_get_noise(spark):
    df, x = windows(spark)
    ramp = np.linspace(0, 1, 5)[:, None]
    assert np.allclose(back(robustness.drifting_windows(df, 0.2, 0.1)), x * (1 + 0.2 * ramp) + 0.1 * ramp)
    one = df.select("id", F.slice("x", 1, 1).alias("x"))
    assert np.allclose(back(robustness.drifting_windows(one, 0.2, 0.1)), x[:, :1])
    off = back(robustness.dropped_windows(df, 0.4, 1, F.col("id")))
    gone = (off == 0).all(1)
    assert 0.25 < gone.mean() < 0.55 and np.array_equal(np.where(gone[:, None], 0, x), off)
    noise = back(robustness.noisy_windows(df, 0.1, 1, F.col("id"))) - x
    assert abs(noise.std() - 0.1) < 0.02 and len(np.unique(noise.round(12))) == noise.size


def test_the_channel_that_tells_classes_apart_loses_most(spark):
    df, x = windows(spark, 200)
    model = models.build_model("random_forest", models.CLASSIFICATION, n_estimators=10, max_depth=4).fit(df)
    copies = robustness.ablated_windows(df, ["a", "b", "c"])
    assert copies.count() == 800 and np.allclose(back(copies.where("ablated = 'b'"))[:, :, 1], 0)
    effects = {r["ablated"]: r for r in robustness.ablation_effects(model.predict(copies), 2).collect()}
    assert set(effects) == {"none", "a", "b", "c"} and effects["none"]["loss"] == 0
    assert effects["a"]["loss"] > 0.3 and effects["a"]["loss"] > 3 * max(abs(effects[c]["loss"]) for c in "bc")


def test_ledger_units_tell_collisions_from_repeats(spark):
    rows = [  # fingerprint, status, substrate, config, windows
        ("one", "ok", "s", "c1", 5),
        ("again", "ok", "s", "c1", 5), ("again", "ok", "s", "c1", 5),
        ("repeat", "ok", "s", "c1", 5), ("repeat", "ok", "s", "c2", 5), ("repeat", "ok", None, "c1", 0),
        ("unscored", "ok", "s", "c1", 0), ("unscored", "ok", "s", "c2", 3),
        ("nulls", "ok", None, None, 1), ("nulls", "ok", None, "c", 1),
        ("failed", "failed", "s", "c1", 5), ("", "ok", "s", "c1", 5), (None, "ok", "s", "c1", 5),
    ]
    units = records.ledger_units(spark.createDataFrame(rows, "fingerprint string, status string, sub string, config_hash string, w int"), ["sub"], F.col("w") > 0)
    got = {(r["fingerprint"], r["sub"]): (r["classification"].split("_")[0], r["n_substrates"]) for r in units.collect()}
    assert got == {("one", "s"): ("single", 1), ("again", "s"): ("recomputation", 1), ("repeat", "s"): ("true", 2), ("repeat", None): ("single", 2), ("unscored", "s"): ("single", 1), ("nulls", None): ("true", 1)}
    assert tuple(records.ledger_summary(units).first()) == (5, 1, 2, 6, 3, 1, 2)
    assert tuple(records.ledger_summary(units.where("false")).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_fingerprint_rows_are_cut_and_ordered(spark):
    df = spark.createDataFrame([("r", "2026-01-02T03:04:05.678Z", {"b": 1, "a": 2}), ("q", "short", None)], "run_id string, timestamp_utc string, cover map<string,int>")
    got = {r["run_id"]: tuple(r)[1:] for r in records.fingerprint_rows(df, ["run_id", "timestamp_utc"], ["cover"]).collect()}
    assert got == {"r": ("2026-01-02T03:04:05Z", '{"a":2,"b":1}'), "q": ("short", "{}")}
