"""Catalogue queries against their SQL on the small fixture; the driver contract."""

import math

import pytest

import __spark_entry__ as entry
from quillgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _canon(got.columns, got.collect()) == _canon(want.columns, want.fetchall())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 5
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80
