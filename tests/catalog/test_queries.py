"""Every catalog query against its SQL."""

import math

import duckdb
import pytest

from mediacat.plans import catalog_queries as q
from mediacat.plans import change_queries, more_queries, tree_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    if name not in q.SQL:
        assert got
        return
    want = duck.sql(q.SQL[name])
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    rows = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
    assert got == rows
