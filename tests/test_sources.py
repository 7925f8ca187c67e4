"""Sources, sinks and streams: failure modes, round trips, micro-batches against one batch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import windows
from lattica.sources import files, synthetic
from lattica.streaming import operators as streaming


@pytest.fixture
def series(tmp_path):
    for name, order in (("TS1-a.csv", " v ,t"), ("TS2-b.csv", "t, v ")):
        rows = ["1,2", "3,4"]
        (tmp_path / name).write_text(order + "\n" + "\n".join(rows) + "\n")
    return tmp_path


def test_series_by_name(spark, series):
    df = files.read_series(spark, {f"{series}/TS1-a.csv": ("x", None), f"{series}/TS2-b.csv": ("y", "s")})
    assert sorted((r.v, r.t, r.series_specimen, r.series_session) for r in df.collect()) == [("1", "2", "x", "x"), ("2", "1", "y", "s"), ("3", "4", "x", "x"), ("4", "3", "y", "s")]
    with pytest.raises(ValueError):
        files.read_series(spark, {})


def test_glob(spark, series):
    (series / "TS2-b.csv").unlink()
    (series / "odd.csv").write_text(" v ,t\n5,6\n")
    with pytest.raises(Exception, match="doesn't match"):
        files.read_glob(spark, f"{series}/*.csv", r"^(?P<specimen>TS\d+)-").collect()
    got = files.read_glob(spark, f"{series}/*.csv", r"^(?P<specimen>TS\d+)-", {"odd.csv": "TS9-z.csv"}).collect()
    assert {(r.series_specimen, r.series_session) for r in got} == {("TS1", "TS1-a"), ("TS9", "TS9-z")}
    with pytest.raises(ValueError, match="no file uses"):
        files.read_glob(spark, f"{series}/TS*.csv", r"^(?P<specimen>TS\d+)-", {"gone.csv": "TS1-a.csv"})


def test_row_index(spark, series):
    got = files.with_row_index(spark, [f"{series}/TS1-a.csv"]).collect()
    assert [(r.row_index, r.line) for r in sorted(got, key=lambda r: r.row_index)] == [(0, "1,2"), (1, "3,4")]


def test_records(spark, tmp_path):
    doc = {"run_id": "r", "experiment": "E", "dataset": "D", "model": "m", "task": "c", "seed": 1, "fold_id": 0, "status": "ok", "metrics": {"f1": 0.5}, "surplus": 1}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps(doc))
    assert files.read_records(spark, str(tmp_path)).first().metrics == {"f1": 0.5}
    del doc["model"]
    (tmp_path / "a" / "y.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="required"):
        files.read_records(spark, str(tmp_path)).collect()


def test_npz(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0), (2, 2, 1.0)], "src bigint, dst bigint, w double")
    files.write_npz_edges(e, f"{tmp_path}/g.npz", "n1", 3)
    assert sorted(map(tuple, files.read_npz_edges(spark, f"{tmp_path}/g.npz", "n1").collect())) == sorted(map(tuple, e.collect()))
    files.write_edges(e, f"{tmp_path}/edges")
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 3


def test_manifest(spark, tmp_path):
    import hashlib
    import zlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abd")
    right = hashlib.sha256(b"abc").hexdigest()
    m = spark.createDataFrame([("a.bin", right), ("b.bin", right), ("c.bin", right)], "name string, sha256 string")
    assert {r.name: r.status for r in files.verify_manifest(spark, m, str(tmp_path)).collect()} == {"a.bin": "present", "b.bin": "corrupt", "c.bin": "missing"}
    crc = files.verify_crc(spark.read.format("binaryFile").load(f"{tmp_path}/a.bin")).first().crc32
    assert crc == zlib.crc32(b"abc")


def test_synthetic(spark):
    spec = synthetic.SeriesSpec(specimens=4, steps=50, channels=3, seed=7)
    a, b = (synthetic.generate(spark, spec).orderBy("specimen_id", "time_index").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 200 and a.groupby("specimen_id").tvc.apply(lambda s: s.is_monotonic_increasing).all()
    assert (a.freshness_class == np.digitize(a.tvc, spec.thresholds)).all()


def test_stream_in_micro_batches_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", float(i), i, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, t double, id bigint, v double")
    for i in range(4):
        df.where((F.col("t") >= 15 * i) & (F.col("t") < 15 * (i + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streaming.parquet_stream(spark, f"{tmp_path}/in", 1)
    got = spark.read.parquet(streaming.run_available(streaming.count_windows(stream, "key", ["t", "id"], ["v"], 5), "micro")).collect()
    batch = windows.sliding_windows(df.withColumns({"specimen_id": F.col("key"), "session_id": F.col("key"), "time_index": F.col("t"), "freshness_class": F.lit(0), "tvc": F.lit(0.0)}), ["v"], 5).collect()
    assert sorted((r.key, r.window_no, r.end_order, r.total) for r in got) == sorted((r.specimen_id, r.window_no, r.end_time, sum(x[0] for x in r.x)) for r in batch)


def test_scalers_are_checked_when_they_are_read(spark, tmp_path):
    path = str(tmp_path / "scalers")
    good = spark.createDataFrame([(0, 5, 1.0, 2.0), (1, 6, 0.0, 0.5)], "fold_id int, n_fit_rows bigint, a_mean double, a_std double")
    files.write_scalers(good, path)
    assert sorted(map(tuple, files.read_scalers(spark, path, ["a"], ["fold_id"]).collect())) == [(0, 5, 1.0, 2.0), (1, 6, 0.0, 0.5)]
    with pytest.raises(ValueError, match="b_mean"):
        files.read_scalers(spark, path, ["a", "b"], ["fold_id"])
    bad = {
        "type": good.withColumn("a_std", good.a_std.cast("float")),
        "deviation": good.withColumn("a_std", good.a_std - 2),
        "null": good.withColumn("a_mean", good.a_mean + None),
        "key": good.unionByName(good),
    }
    for name, df in bad.items():
        files.write_scalers(df, f"{path}-{name}")
        with pytest.raises(ValueError, match="no scaler"):
            files.read_scalers(spark, f"{path}-{name}", ["a"], ["fold_id"])
