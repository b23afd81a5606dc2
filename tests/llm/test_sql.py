import duckdb
import pytest

from mediacat.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted(([r[c] for c in order] for r in got.collect()), key=repr) == sorted(([r[i] for i in at] for r in want.fetchall()), key=repr)
