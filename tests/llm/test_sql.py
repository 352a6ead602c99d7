"""Queries with SQL, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from inkframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(want, key=repr)
