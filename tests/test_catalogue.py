"""Queries against their SQL on the smallest tables."""

import os

import pytest

from chronolens import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"pit_hedge", "pit_hedge_by_factor"}  # the flagship goes through both


def cell(v):
    return "N" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if n not in SLOW])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == cols
    rows = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{x}`" for x in cols]).collect())
    assert rows == sorted(tuple(map(cell, r)) for r in want.select(*[f'"{x}"' for x in cols]).fetchall())


def test_entry_points_load():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and catalogue.FLAGSHIP in e.queries()
