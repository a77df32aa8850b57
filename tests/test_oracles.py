"""Every query with SQL gives the rows that DuckDB gives for its SQL."""


import duckdb
import pytest

import __spark_entry__
from meshframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf)
    wanted = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
