"""Every registered query against its SQL on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lattica import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def text(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 5))
    return str(v)


def comparable(df):
    df = df[sorted(df.columns)].map(text)
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, db, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) and len(got)
        return
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.count() > 0 and "fold_id" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["lattica.llm", "lattica.llm.queries", "corpus_pipeline"])
def test_entry_without_the_optional_subpackage(monkeypatch, missing):
    """The engine's queries stay where a part of the subpackage, or what it needs, can't be imported."""
    import lattica

    monkeypatch.setitem(sys.modules, missing, None)
    for name in [m for m in sys.modules if m.startswith("lattica.llm") and m != missing]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(lattica, "llm", raising=False)
    if missing != "corpus_pipeline":
        monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE_SQL)
