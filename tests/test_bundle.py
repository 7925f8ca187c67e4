import pytest

from lattica.sources import bundle


@pytest.fixture
def tables(spark):
    runs = [("D1", m, "t", s, 0, f"{m}{s}") for m in ("a", "b") for s in range(3)]
    return {
        "per_run": spark.createDataFrame(runs, "dataset string, model string, task string, seed int, fold_id int, run_id string"),
        "summary": spark.createDataFrame([("D1", "a", 3), ("D1", "b", 3)], "dataset string, model string, n_runs int"),
        "fingerprints": spark.createDataFrame([(r[5],) for r in runs], "run_id string"),
        "touched": spark.createDataFrame([(0,)], "n_violations int"),
    }


def scan(spark, tables, base, **more):
    bundle.write_bundle(tables, base)
    return sorted(tuple(r) for r in bundle.scan_bundle(spark, base, **more).collect())


def test_a_whole_bundle_has_no_faults(spark, tables, tmp_path):
    base = str(tmp_path / "whole")
    assert scan(spark, tables, base, required_models=["a", "b"]) == []
    assert bundle.load_bundle(spark, base)["per_run"].count() == 6


def test_every_fault_is_a_row(spark, tables, tmp_path):
    one = tables["per_run"].where("seed = 0 AND model = 'a'")
    tables["per_run"] = tables["per_run"].where("NOT (seed = 2 AND model = 'b')").unionByName(one)
    tables["fingerprints"] = tables["fingerprints"].where("run_id <> 'a1'")
    tables["touched"] = spark.createDataFrame([(2,), (None,), (-1,)], "n_violations int")
    tables["summary"] = tables["summary"].unionByName(spark.createDataFrame([("D9", None, 1)], "dataset string, model string, n_runs int"))
    base = str(tmp_path / "broken")
    assert scan(spark, tables, base, required_models=["a", "z"]) == sorted([
        ("run keys are unique", "D1|a|t|0|0", 2, 1),
        ("summary counts the runs", "D1|a", 4, 3),
        ("summary counts the runs", "D1|b", 2, 3),
        ("summary counts the runs", "D9|null", 0, 1),
        ("runs have fingerprints", "a1", 0, 1),
        ("fingerprints belong to runs", "b2", 0, 1),
        ("test sets are touched once", "", 3, 0),
        ("required models are there", "z", 0, 1),
    ])
    with pytest.raises(bundle.BrokenBundle, match="run keys are unique: D1"):
        bundle.load_bundle(spark, base)


def test_missing_files_and_an_empty_report(spark, tables, tmp_path):
    base = str(tmp_path / "part")
    tables["touched"] = tables["touched"].where("false")
    del tables["summary"]
    found = scan(spark, tables, base)
    assert found == [("columns are there", "touched.n_violations", 0, 1), ("files are there", "_summary.csv", 0, 1)]  # an empty table has no JSON line
    assert scan(spark, {"per_run": tables["per_run"]}, str(tmp_path / "alone"))[0][0] == "files are there"


def test_constraints_without_tables_are_an_error(spark, tables):
    with pytest.raises(ValueError, match="no constraint"):
        bundle.faults({}, bundle.BUNDLE)
