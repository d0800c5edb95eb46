"""Every registered query of flat records against its SQL, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from ledgerline.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("" if r[k] is None else repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _norm(df.collect(), df.columns) == _norm(found.fetchall(), columns)


def test_driver_entry_points(spark):
    assert driver.entry(spark).columns == ["NAME", "SEG", "BAL"]
    assert set(catalog.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
