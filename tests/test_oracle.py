"""Every query with SQL gives the rows of its SQL on the smallest tables, and not none."""

import math
import os

import duckdb
import pytest

from lamina.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = tables.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    rows = catalog.queries()[name](spark, FOLDER)
    assert sorted(rows.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    assert want and got == want
