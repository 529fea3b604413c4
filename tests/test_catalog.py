"""The queries against their SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from evalgrid.plans import catalog, catalog_files  # noqa: F401  (adds its queries)

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table, columns):
    def plain(v):
        return "null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in table), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    assert found
    if name in catalog.ORACLE:
        sql = duck.sql(catalog.ORACLE[name])
        assert sorted(df.columns) == sorted(sql.columns)
        assert rows(found, df.columns) == rows(sql.fetchall(), sql.columns)
