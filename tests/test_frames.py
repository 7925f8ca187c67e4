"""Ingestion, splits, windows and audits: failure modes, invariants and positive controls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars
from lattica.operators import audits, frames, ordering, splits, windows


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"sp{s:02d}", f"sp{s:02d}-{h}", float(h * 30 + t), s * 100 + h * 30 + t, float(s + t), float(t * t), t % 4, t / 10) for s in range(6) for h in range(2) for t in range(30)]
    return spark.createDataFrame(rows, "specimen_id string, session_id string, time_index double, event_id bigint, a double, b double, freshness_class int, tvc double")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("value", "want"), [(2.9, 0), (3.0, 1), (4.5, 2), (5.0, 3), (float("nan"), 3), (None, None)])
def test_digitize(spark, value, want):
    assert one(spark, scalars.digitize(F.lit(value).cast("double"), [3, 4, 5])) == want


def test_scalars(spark):
    with pytest.raises(ValueError):
        scalars.digitize("x", [1, 1])
    assert one(spark, scalars.map_label(F.lit(" Fresh "), {"fresh": 0})) == 0
    with pytest.raises(Exception, match="unmapped"):
        one(spark, scalars.map_label(F.lit("odd"), {"fresh": 0}))
    assert one(spark, scalars.root_id(F.lit(" 720575940.0 "))) == "720575940"
    assert [one(spark, scalars.condition_label(F.lit(f).cast("double"))) for f in (None, 1.0, 0.25, 0.125, 0.01234567)] == ["full", "full", "train25pct", "train0p125", "train0p01235"]
    assert [one(spark, scalars.p_text(F.lit(p))) for p in (float("nan"), 1e-13, 0.05, 1.0, 0.1234567, 0.00012345678, 1.5e-7)] == ["n/a", "<1e-12", "0.05", "1", "0.123457", "0.000123457", "1.5e-07"]
    assert [one(spark, scalars.metric_value(F.lit(t))) for t in ("1.5", "x", "NaN", "inf", None)] == [1.5, None, None, None, None]
    assert one(spark, scalars.unit_id(F.lit("chop12-3"), r"^(GTSteam|chop\d+)-\d+$")) == "chop12" and one(spark, scalars.unit_id(F.lit("zzz"), r"^(a)-\d+$")) == "zzz"
    p = one(spark, scalars.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]


def test_normalise(spark):
    raw = spark.createDataFrame([("s1", "0", "fresh", "1.5", "3"), ("s1", "1", "FRESH ", "2", "4")], "sp string, t string, lab string, `MQ 1` string, tv string")
    config = frames.FrameConfig({"specimen_id": "sp", "session_id": "sp", "time_index": "t", "tvc": "tv", "freshness_class": "lab"}, {"m1": "MQ 1"}, label_map={"fresh": 0})
    got = frames.normalise(raw, config).collect()
    assert [r.m1 for r in got] == [1.5, 2.0] and all(r.freshness_class == 0 for r in got)
    with pytest.raises(ValueError, match="available"):
        frames.normalise(raw.drop("tv"), config)
    with pytest.raises(Exception, match="CAST|cast"):
        frames.normalise(raw.withColumn("MQ 1", F.lit("x")), config).collect()
    with pytest.raises(ValueError):
        frames.FrameConfig({}, {})


def test_label_range_and_compliance(spark, frame):
    assert {r.freshness_class for r in frames.label_range_violations(frame, 3).collect()} == {3}
    assert frames.label_range_violations(frame, 4).isEmpty()
    assert one(spark, frames.compliant(F.lit("published"))) and not one(spark, frames.compliant(F.lit("assumed_time_block")))


@pytest.mark.parametrize(("n", "k"), [(5, 5), (7, 3), (23, 5), (300, 4)])
def test_group_kfold(spark, n, k):
    ids = spark.range(n).select(F.format_string("s%03d", "id").alias("specimen_id"))
    folds = splits.group_kfold(ids, k, 3)
    assert audits.fold_audit(folds, ids).isEmpty()
    sizes = {(r.fold_id, r.split): r.n for r in folds.groupBy("fold_id", "split").agg(F.count("*").alias("n")).collect()}
    tests = [sizes[f, "test"] for f in range(k)]
    assert sum(tests) == n and max(tests) - min(tests) <= 1
    assert [sizes[f, "val"] for f in range(k)] == [tests[(f + 1) % k] for f in range(k)]
    pos = sorted(r.pos for r in splits.permuted(ids, 3).collect())
    assert pos == list(range(n))


def test_other_splits(spark):
    ids = spark.range(9).select(F.format_string("s%03d", "id").alias("specimen_id"))
    loso = splits.loso(ids, 1)
    assert audits.fold_audit(loso, ids).isEmpty() and loso.where("split = 'test'").count() == 9
    hold = splits.make_folds("time_block_holdout", ids, k=9)
    assert hold.agg(F.max("fold_id")).first()[0] == 6
    nested = [{r.specimen_id for r in splits.train_fraction(ids, f, 2).collect()} for f in (0.2, 0.5, 1.0)]
    assert [len(x) for x in nested] == [2, 5, 9] and nested[0] < nested[1] < nested[2]
    for bad in (lambda: splits.group_kfold(ids, 2), lambda: splits.train_fraction(ids, 0.0), lambda: splits.make_folds("x", ids), lambda: splits.loso(ids.limit(2))):
        with pytest.raises(ValueError):
            bad()
    a, b = (splits.fingerprints(splits.group_kfold(ids, 3, s), "group_kfold", s).collect() for s in (1, 2))
    assert all(len(r.fingerprint) == 12 for r in a) and {r.fingerprint for r in a}.isdisjoint({r.fingerprint for r in b})


def test_scaler(frame):
    s = windows.fit_scaler(frame, ["a", "b"]).first()
    values = np.array([[r.a, r.b] for r in frame.collect()])
    assert np.allclose([s.a_mean, s.b_mean], values.mean(0)) and np.allclose([s.a_std, s.b_std], values.std(0) + 1e-8)
    scaler = windows.fit_scaler(frame, ["a", "b"])
    back = windows.unstandardise(windows.standardise(frame, scaler, ["a", "b"]), scaler, ["a", "b"])
    assert np.allclose(sorted(r.a for r in back.collect()), sorted(values[:, 0]))


@pytest.mark.parametrize(("length", "stride"), [(4, 1), (7, 3), (30, 1), (31, 1)])
def test_windows(frame, length, stride):
    w = windows.sliding_windows(frame, ["a", "b"], length, stride, row_id="event_id").collect()
    per = len(range(0, 30 - length + 1, stride)) if length <= 30 else 0
    assert len(w) == 12 * per
    for r in w:
        assert len(r.x) == length and r.row_ids == sorted(r.row_ids) and r.row_ids[-1] - r.row_ids[0] == length - 1
        assert r.label == (r.row_ids[-1] % 100 % 30) % 4
    majority = windows.sliding_windows(frame, ["a"], length, stride, "majority").collect()
    for r in majority:
        t = [int(x[0]) - int(r.specimen_id[2:]) for x in r.x]
        counts = {c: sum(v % 4 == c for v in t) for c in range(4)}
        assert r.label == max(counts, key=lambda c: (counts[c], c)) and abs(r.target - np.mean(t) / 10) < 1e-9


def test_short_series(spark, frame):
    assert windows.skipped_sessions(frame, 31).count() == 12
    windows.check_specimens(frame, 60)
    with pytest.raises(ValueError):
        windows.check_specimens(frame, 61)
    with pytest.raises(ValueError):
        windows.sliding_windows(frame, ["a"], 4, rule="first")


def test_audits_fire(spark, frame):
    folds = splits.group_kfold(frame, 3, 1)
    w = windows.sliding_windows(frame.join(folds, "specimen_id"), ["a"], 5, by=("fold_id", "split"), row_id="event_id")
    assert audits.row_reuse(w).isEmpty() and audits.split_membership_audit(w, folds).isEmpty()
    assert audits.window_owner_audit(w, frame, "event_id").isEmpty()
    mixed = windows.sliding_windows(frame.withColumn("session_id", F.lit("all")), ["a"], 5, row_id="event_id")
    assert not audits.window_owner_audit(mixed, frame, "event_id").isEmpty()
    leaked = w.withColumn("split", F.when(F.col("window_no") % 2 == 0, "train").otherwise("test"))
    assert not audits.row_reuse(leaked).isEmpty() and not audits.split_membership_audit(leaked, folds).isEmpty()
    assert not frames.straddling_sessions(frame.withColumn("session_id", F.lit("x"))).isEmpty()
    report = audits.scaler_audit(frame.where("specimen_id < 'sp03'"), frame, ["a", "b"]).collect()
    assert {r.channel: r.distinguishable for r in report} == {"a": True, "b": False}
    cover = {(r.fold_id, r.split): r.absent for r in audits.class_coverage(frame.where("freshness_class <> 2"), folds, 4).collect()}
    assert set(cover.values()) == {"2"}


@pytest.mark.parametrize(("length", "stride", "block"), [(4, 1, 7), (5, 3, 5), (8, 2, 100)])
def test_long_sessions(frame, length, stride, block):
    for rule in ("last", "majority"):
        want = windows.sliding_windows(frame, ["a", "b"], length, stride, rule, row_id="event_id").collect()
        got = windows.long_session_windows(frame, ["a", "b"], length, stride, rule, row_id="event_id", block_rows=block).collect()
        pick = lambda rows: sorted((r.specimen_id, r.session_id, r.window_no, r.label, round(r.target, 9), tuple(r.row_ids)) for r in rows)
        assert pick(got) == pick(want)


def test_positions(spark, frame):
    placed = ordering.with_position(frame.select("event_id"), ["event_id"]).collect()
    assert [r.pos for r in sorted(placed, key=lambda r: r.event_id)] == list(range(360))
    assert ordering.with_position(frame.where("event_id < 0").select("event_id"), ["event_id"]).isEmpty()


def test_fold_scalers_and_scaled_windows(frame):
    folds = splits.group_kfold(frame, 3, 1)
    rows = frame.join(folds, "specimen_id")
    want = {r.fold_id: r for r in windows.fit_scaler(rows.where("split = 'train'"), ["a", "b"], ["fold_id"]).collect()}
    scaler = windows.fold_scalers(frame, folds, ["a", "b"])
    for r in scaler.collect():
        assert r.n_fit_rows == want[r.fold_id].n_fit_rows
        assert all(abs(r[c] - want[r.fold_id][c]) < 1e-9 * (1 + abs(r[c])) for c in ("a_mean", "a_std", "b_mean", "b_std"))
    before = windows.sliding_windows(windows.standardise(rows, scaler, ["a", "b"], ["fold_id"]), ["a", "b"], 4, by=("fold_id", "split"))
    after = windows.scaled_windows(windows.sliding_windows(frame, ["a", "b"], 4).join(folds, "specimen_id"), scaler, ["a", "b"], ["fold_id"])
    key = lambda r: (r.fold_id, r.split, r.specimen_id, r.session_id, r.window_no)
    x, y = ({key(r): np.array(r.x) for r in df.collect()} for df in (before, after))
    assert set(x) == set(y) and all(np.allclose(x[k], y[k]) for k in x)
