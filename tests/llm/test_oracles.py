"""The corpus queries with SQL, against DuckDB over the smallest tables."""

import os

import pytest

from segflow.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_oracles_are_sql():
    assert set(queries.oracle_sql()) == {"op2_line_dedup", "op6_secrets", "op9_decontamination", "op12_clustering"}
    assert all(isinstance(s, str) for s in queries.oracle_sql().values())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_secrets", "op9_decontamination", "op12_clustering"])
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    found = queries.queries()[name](spark, FOLDER)
    assert set(names) <= set(found.columns)
    wanted = sorted(tuple(map(str, r)) for r in rows.fetchall())
    assert sorted(tuple(map(str, r)) for r in found.select(names).collect()) == wanted
