"""Every catalogued query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from maskwright.plans import catalog, evaluated, oracle, wider


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


QUERIES, SQL = catalog.QUERIES | wider.QUERIES | evaluated.QUERIES, oracle.SQL | wider.SQL | evaluated.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want and (got or name.startswith("pii"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lang", "entity_type", "spans", "documents"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
