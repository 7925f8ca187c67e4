"""Queries on small tables that have what larger ones have: several files and tasks, deeper trees, constant groups."""

import math
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np

from lattica import catalog
from lattica.operators import graph, models
from lattica.plans import benchmark, io
from lattica.sources import archives


def lineitem(tmp_path, rows: str, groups: int = 122_880) -> str:
    """A folder with `lineitem`, and in DuckDB's order."""
    duckdb.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE {groups})")
    return str(tmp_path)


def by_sql(folder: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return con.execute(catalog.ORACLE_SQL[name]).fetchall()


def test_first_best_of_averages_at_halves_of_a_thousandth(spark, tmp_path):
    """The scores are those of sums in the rows' order, however many tasks read them."""
    rng, rows = random.Random(3), []
    for s in range(300):
        d = [rng.randrange(11) for _ in range(79)]
        d.append((12 - sum(d)) % 8)  # c / 8000 lies between two thousandths
        rows += [(s, x / 100) for x in d]
    rng.shuffle(rows)
    folder = lineitem(tmp_path, "SELECT s::BIGINT AS l_suppkey, 1 AS l_linenumber, d::DOUBLE AS l_discount FROM (SELECT unnest($rows) AS r), LATERAL (SELECT r[1] AS s, r[2] AS d)".replace("$rows", str([[float(s), d] for s, d in rows])), 2048)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = catalog.QUERIES["first_best"](spark, folder).select("l_suppkey", "score").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((s, score) for s, _, score in by_sql(folder, "first_best"))


def test_first_best_rounds_as_its_sql(spark, tmp_path):
    """Averages at halves of a thousandth and a unit in the last place from them, either side of zero."""
    halves = [(2 * k + 1) / 2000 for k in range(-150, 150)]
    values = [x for h in halves for x in (math.nextafter(h, -1), h, math.nextafter(h, 1))]
    folder = lineitem(tmp_path, f"SELECT i AS l_suppkey, 1 AS l_linenumber, d AS l_discount FROM (SELECT unnest(range({len(values)})) AS i, unnest({values}::DOUBLE[]) AS d)")
    got = catalog.QUERIES["first_best"](spark, folder).select("l_suppkey", "l_linenumber", "score").collect()
    assert sorted(map(tuple, got)) == sorted(by_sql(folder, "first_best"))


def test_first_best_keeps_suppliers_without_a_score(spark, tmp_path):
    """Only NaN, only nulls, both, or no key: the SQL has a row for each supplier."""
    nan = "'NaN'::DOUBLE"
    rows = [(1, 2, 0.05), (2, 2, 0.01), (2, 1, "NULL"), (3, 3, "NULL"), (3, 1, "NULL"), (4, 2, "NULL"), (5, 1, nan), (5, 3, 0.02), (6, 1, nan), (7, "NULL", 0.07), (7, 1, 0.07), ("NULL", "NULL", 0.03), ("NULL", 1, 0.03), (8, 1, 0.04), (8, 1, "NULL")]
    values = ", ".join(f"({s}::BIGINT, {n}::INT, {d}::DOUBLE)" for s, n, d in rows)
    folder = lineitem(tmp_path, f"SELECT * FROM (VALUES {values}) t(l_suppkey, l_linenumber, l_discount)")
    got = catalog.QUERIES["first_best"](spark, folder).select("l_suppkey", "l_linenumber", "score").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, by_sql(folder, "first_best")))


def test_a_block_with_more_than_two_levels(spark, data, monkeypatch):
    """The query shows the two levels that its SQL has; the tree that is verified goes up to its root."""
    write, verify, levels = io.blocks.write_block, io.blocks.verify_block, set()
    monkeypatch.setattr(io.blocks, "write_block", lambda e, path: write(e, path, 10))

    def seen(spark, path):
        found = verify(spark, path)
        levels.update(r.level for r in found.select("level").distinct().collect())
        return found

    monkeypatch.setattr(io.blocks, "verify_block", seen)
    shown = {r.level for r in catalog.QUERIES["graph_block"](spark, data).select("level").distinct().collect()}
    assert shown == {1, 2} and levels == {1, 2, 3, 4}


def test_spearman_interval_of_constant_groups(spark, tmp_path):
    """A group without a resample that has a rho has no row."""
    folder = lineitem(tmp_path, "SELECT i AS l_orderkey, i * 7 % 20 AS l_suppkey, 'A' AS l_returnflag, CASE WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, 5.0::DOUBLE AS l_quantity, CASE WHEN i % 2 = 0 THEN i % 9 / 100 ELSE 0.05 END AS l_discount, i % 8 / 100 AS l_tax FROM range(1, 900) t(i)")
    got = catalog.QUERIES["spearman_interval"](spark, folder).select("dataset", "model", "n", "n_draws").collect()
    want = by_sql(folder, "spearman_interval")
    assert want and sorted(map(tuple, got)) == sorted((*r[:2], *r[-2:]) for r in want)


def undirected_levels(pairs, root):
    dist, todo = {root: 0}, [root]
    for at in todo:
        for a, b in [*pairs, *((b, a) for a, b in pairs)]:
            if a == at and b not in dist:
                dist[b] = dist[at] + 1
                todo.append(b)
    return dist


def test_distances_from_more_roots_than_a_row_has_bits(spark):
    """Levels and their counts against brute force; roots without edges, self-loops and a second batch of roots among them."""
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(3, 3)]
    e, roots = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.range(280)
    want = Counter((r, n, d) for r in range(280) for n, d in undirected_levels(pairs, r).items())
    assert Counter(map(tuple, graph.bfs_levels(e, roots).collect())) == want
    assert dict(map(tuple, graph.distance_counts(e, roots).collect())) == dict(Counter(d for _, _, d in want))
    assert dict(map(tuple, graph.distance_counts(e, roots, 1).collect())) == dict(Counter(d for _, _, d in want if d < 2))


def test_short_closed_walks_make_no_pairs_of_starts_and_places(spark, monkeypatch):
    rng, written = random.Random(8), []
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(70)} | {(30, 30), (30, 31), (31, 32)}
    e = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    a = np.zeros((33, 33), int)
    for s, d in pairs:
        a[s, d] = 1
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or keep(df, name))
    for k in (1, 2, 3, 4):
        assert sorted(r.id for r in graph.closed_walks(e, k).collect()) == np.flatnonzero(np.diag(np.linalg.matrix_power(a, k))).tolist()
        assert ("walk" in written) == (k > 3)


def test_many_members_share_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(450):
            z.writestr(f"{i}.csv", f"{i}\n")
    archives.register(spark)
    found = spark.read.format("zip_members").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 150
    assert sorted(int(r.text) for r in archives.member_lines(found).collect()) == list(range(450))


def test_a_kernel_machine_is_fitted_on_all_rows(spark):
    """Against the kernel of all pairs: with a penalty of 100, an estimate shows how many rows lie near it."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 0.1, (4200, 4)), np.zeros(4200)
    x[4000:] += 3
    y[4000:] = 1
    rows = spark.createDataFrame([(i, a.reshape(2, 2).tolist(), b) for i, (a, b) in enumerate(zip(x, y.tolist(), strict=True))], "id int, x array<array<double>>, target double").repartition(4)
    fitted = models.build_model("svm_rbf", models.REGRESSION, penalty=100.0, gamma=0.5).fit(rows)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    near = fitted._map()(x[::100])
    assert np.abs(near @ near.T - kernel[::100, ::100]).max() < 0.2
    want = (kernel + 1) @ np.linalg.solve(kernel + 1 + 100 * np.eye(len(x)), y)
    got = [r.predicted for r in fitted.predict(rows).orderBy("id").collect()]
    assert np.abs(got - want).max() < 0.03 and want.max() > 0.6


def test_the_grid_fits_all_training_windows(spark, data, monkeypatch):
    fitted, given, keep, run = [], [], models.ridge, benchmark.evaluate
    monkeypatch.setattr(models, "ridge", lambda rows, *a, **k: fitted.append(rows.count()) or keep(rows, *a, **k))
    monkeypatch.setattr(benchmark, "evaluate", lambda model, w, n: given.append(w.where("split = 'train'").count()) or run(model, w, n))
    assert catalog.QUERIES["benchmark_grid"](spark, data).where("status = 'ok'").count() == 10
    assert len(given) == 10 and fitted == given


def test_the_reservoir_benchmark_writes_no_states(spark, data, monkeypatch):
    written, keep = [], benchmark.materialise

    def note(df, name):
        written.extend(df.columns)
        return keep(df, name)

    monkeypatch.setattr(benchmark, "materialise", note)
    assert catalog.QUERIES["reservoir_benchmark"](spark, data).count() == 35 and "x" in written and "state" not in written
