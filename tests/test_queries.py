"""Every query with SQL, against DuckDB over the smallest tables."""

import os

import pytest

from segflow import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, str | bool):
        return str(x)
    return f"{float(x):.6g}" if hasattr(x, "__float__") else str(x)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, FOLDER)
    rows = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(found.columns) == sorted(names)
    wanted = sorted(tuple(map(plain, r)) for r in rows.fetchall())
    assert sorted(tuple(map(plain, r)) for r in found.select(names).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql(spark, duck, name):
    assert queries.queries()[name](spark, FOLDER).collect()
