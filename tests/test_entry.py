import importlib
import sys

import duckdb
import pytest

import __spark_entry__
from coppice.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = plain([[r[c] for c in columns] for r in got.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == plain([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]


def test_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("coppice.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "coppice.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert set(bare.queries()) == set(catalogue.queries()) and set(bare.oracle_sql()) == set(catalogue.oracle_sql())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
