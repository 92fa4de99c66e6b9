"""Every registered query against its DuckDB oracle SQL (the driver's correctness gate), at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from brickyard.config import TEST
from brickyard.plans import catalog
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}
DERIVED = catalog.queries(TEST, load_once=False)        # every job derives its inputs itself
QUERIES = {k: v for k, v in E.queries().items() if k in DERIVED}    # load once per session (the driver contract)
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(DERIVED) and set(DERIVED) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = DERIVED[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(SQL[name])
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "median_price" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_load_once_flow_matches_oracle(spark, con, name):
    """The driver contract (load once per session, as bench.py and the CLI do) gives the oracle's rows too."""
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert digest(df.columns, rows)[0] == digest(ocols, cur.fetchall())[0]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "brickyard.llm", "xxhash"])
def test_entry_without_the_training_data_operators(monkeypatch, missing):
    """The folders or a package that they need are not there: the other queries are."""
    import importlib
    import sys

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("brickyard.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises ImportError
    try:
        plain = importlib.reload(E)
        assert set(plain.queries()) == set(DERIVED) == set(plain.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(E)
