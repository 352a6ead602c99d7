"""Every registered query with SQL, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from inkframe.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = duck.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})")
    assert plain(df.select(names).collect()) == plain(want.fetchall())


def test_codec_safe_int_nan_of_large_keys(spark, tmp_path):
    """Keys whose product doesn't fit 64 bits, as larger tables have them."""
    keys = [0, 1, 1000, 1001, 1_024_000, 1_024_001, 9_000_000, (1 << 63) - 1, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.v for r in QUERIES["codec_safe_int_nan"](spark, str(tmp_path)).collect()}
    want = {k: k if k is None else k * 9007199254740.0 if k <= 1000 else math.nan for k in keys}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
