"""Every query over the driver's smallest tables: with the same rows as its SQL in DuckDB, where there is one."""

import os

import duckdb
import pandas as pd
import pytest

from geostride.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame, names):
    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 7) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v

    return sorted((tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, DATA).toPandas()
    names = sorted(mine.columns)
    if name not in ORACLE_SQL:
        assert len(mine) > 0
        return
    plain = duck.sql(ORACLE_SQL[name]).df()
    assert names == sorted(plain.columns)
    a, b = rows_of(mine, names), rows_of(plain, names)
    assert len(a) == len(b) and len(a) > 0
    assert a == b
