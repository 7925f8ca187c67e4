"""Plans and tasks of queries whose work must spread over tasks as their tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from lattica import catalog
from lattica.operators import graph, ordering, selection, studies
from lattica.plans import benchmark, learning
from lattica.plans.sensor import frame


@pytest.fixture
def large(spark):
    """Tables count as too large to broadcast unless the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joined_by_fold(df) -> list[str]:
    """Joins that bring all rows of a fold into one task."""
    return [line for line in plan(df).splitlines() if "Join [fold_id" in line and "Broadcast" not in line]


@pytest.mark.parametrize("name", ["standardise", "scaler_fit"])
def test_no_task_standardises_a_whole_fold(large, data, name):
    assert not joined_by_fold(catalog.QUERIES[name](large, data))


def test_no_task_brings_a_whole_fold_back(large, data):
    assert not joined_by_fold(catalog.QUERIES["inverse_standardise"](large, data))


def test_no_task_scales_all_windows_of_a_fold(large, data):
    assert not joined_by_fold(catalog.QUERIES["reservoir_states"](large, data))


def test_a_fold_is_fitted_from_windows_of_several_tasks(large, data):
    """One fold's windows are in as many partitions as their sessions are dealt to."""
    large.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = learning.fold_windows(large, data)
        assert w.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        large.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_filter_parses_a_value_once(spark, data):
    """Once in the filter and once for the column."""
    assert plan(frame(spark, data)).count("get_json_object") == 2


def test_a_selection_reads_its_rows_once_a_split(spark):
    n, seen = 120, spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(n).select((F.col("id") % 2).cast("int").alias("fold_id"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"), F.array(F.sin("id")).alias("f"), (F.col("id") % 2).cast("int").alias("y"))
    grid = selection.DeclaredGrid({"ridge_lambda": (0.1, 1.0)})
    found = selection.select_penalty(rows.mapInPandas(noted, rows.schema), ["fold_id"], "f", "y", grid, n_classes=2)
    assert len(found.collect()) == 2 and seen.value == 2 * n


def test_stubs_of_few_edges_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_STUBS", 500)
    monkeypatch.setattr(graph, "STUB_RUN", 7)
    place, tasks = graph.with_position, []

    def noted(df, order, name):
        tasks.append(df.select(F.spark_partition_id()).distinct().count())
        return place(df, order, name)

    monkeypatch.setattr(graph, "with_position", noted)
    pairs = [(1, 2, 1000), (1, 3, 999), (2, 3, 1), (3, 3, 7), (4, 4, 0)]
    got = graph.configuration_model(spark.createDataFrame(pairs, "src bigint, dst bigint, w bigint").coalesce(1), 5).collect()
    assert min(tasks) > 2
    for end in ("src", "dst"):
        at = 0 if end == "src" else 1
        assert {k: sum(r.w for r in got if r[end] == k) for k in (1, 2, 3)} == {k: sum(p[2] for p in pairs if p[at] == k) for k in (1, 2, 3)}


def test_positions_shuffle_rows_once(spark):
    df = spark.range(5000).select(F.col("id"), F.hash("id").alias("h"))
    placed = ordering.with_position(df.repartition(7), ["h", "id"])
    assert not re.search(r"windowspecdefinition\(_range#\d+L?, ", plan(placed))
    rows = sorted(placed.collect(), key=lambda r: (r.h, r.id))
    assert [r.pos for r in rows] == list(range(5000)) and placed.columns == ["id", "h", "pos"]


def test_few_kept_nodes_are_sent_to_the_edges(spark, monkeypatch):
    """Trimming and the search for edges inside components don't shuffle the edges by their ends."""
    plans, keep = {}, graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: plans.setdefault(name, []).append(plan(df)) or keep(df, name))
    e = spark.range(3000).select((F.col("id") % 30).alias("src"), (F.col("id") * 7 % 1000).alias("dst"))
    assert graph.strong_components(e, 0).count() == 1000
    assert plans["scc-trim"] and all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in plans["scc-trim"])


def test_no_task_holds_the_pairs_of_all_its_rows(spark, tmp_path, monkeypatch):
    """Rows are trimmed before they are made distinct: no aggregate by both ends runs over the rows of `lineitem`."""
    plans, sizes, keep = [], [], graph.materialise

    def noted(df, name):
        done = keep(df, name)
        if re.search(r"HashAggregate\(keys=\[(src|l_suppkey)#\d+L?, (dst|l_partkey)#", plan(df)):
            plans.append(name)
            sizes.append(done.count())
        return done

    monkeypatch.setattr(graph, "materialise", noted)
    monkeypatch.setattr(graph.strong_components, "__defaults__", (0, False))
    rows = [(i, i + 1) for i in range(20)] + [(20, 0), (5, 5)] + [(i % 20, 100 + i) for i in range(400)]
    spark.createDataFrame(rows * 3, "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["strong_components"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((x, 0 if x <= 20 else x) for x in {x for r in rows for x in r})
    assert plans == ["scc"] and sizes == [21]


def test_the_structure_reads_its_edges_once(spark):
    """However many steps use them, an expensive source of edges is run once."""
    seen, pairs = spark.sparkContext.accumulator(0), [(1, 2), (2, 1), (2, 3), (3, 3), (4, 5)]

    def noted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    row = studies.structure(e.mapInPandas(noted, e.schema)).collect()
    assert [tuple(r) for r in row] == [(5, 3 / 5, 2 / 5, 2 / 5)] and seen.value == len(pairs)


def test_the_grid_cuts_windows_once_and_joins_no_fold(large, data, monkeypatch):
    """A fold's rows are a filter of written windows: nothing is shuffled, cached or cut again for it."""
    cuts, plans, keep = [], [], benchmark.windows.sliding_windows
    monkeypatch.setattr(benchmark.windows, "sliding_windows", lambda *a, **k: cuts.append(1) or keep(*a, **k))
    monkeypatch.setattr(benchmark, "evaluate", lambda model, w, n: plans.append(plan(w)) or {})
    catalog.QUERIES["benchmark_grid"](large, data).collect()
    assert len(cuts) == 1 and len(plans) == 10
    assert not any("hashpartitioning" in p or "InMemoryTableScan" in p for p in plans)
