"""Every catalogued query with an SQL twin gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()
NAMES = [n for n in __spark_entry__.queries() if not n.startswith("op") or n.startswith("overlay")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n in NAMES if n != "pipeline"])
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert len(got.columns) == len({c.lower() for c in got.columns})
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["type", "n"]
