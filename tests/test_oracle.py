"""Every query that has SQL, against DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from nearwin import queries as engine
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    got = engine.QUERIES[name](spark, DATA).toPandas()
    if name not in engine.ORACLES:
        assert len(got)
        return
    want = duck.sql(engine.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert (got[c].isna() == want[c].isna()).all(), f"{c}: missing values"
        seen = got[c].notna()
        assert (got[c][seen] == want[c][seen]).astype(bool).all(), c
