"""Caches written back: folders that show nothing any more, rows that differ, rows that are gone."""

import duckdb
from pyspark.sql import functions as F

from mediacat.operators import changes
from mediacat.plans import catalog_queries as q
from mediacat.sources.store import stored


def test_a_folder_of_binned_media_keeps_its_cached_row(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    binned = events.where("event_id = 29").withColumn("user_id", F.lit(6_000_004).cast("long"))
    events.unionByName(binned.withColumn("event_id", F.lit(29_000_000).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, q.QUERIES["Z6_write_back"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(q.SQL["Z6_write_back"]).fetchall())
    assert [n for path, n in got if "/stickers/6000004/" in path] == [0, 0]


def test_a_listing_is_read_once_and_only_changes_are_written(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, v string")
    store = stored(spark, f"file://{tmp_path}/store", {"t": (old, ("id",))})
    fresh = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e")], "id long, v string").mapInArrow(count, old.schema)
    with store.change() as change:
        changes.write_back(change, "t", fresh)
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "x"), (3, None), (5, "e")]
    last = [s["seq"] for s in store.snapshot()["tables"]["t"]["segments"][1:]]
    assert sorted(r.id for s in last for r in spark.read.parquet(f"{tmp_path}/store/data/t/seq={s}").collect()) == [2, 4, 5]
    assert looked.value == 4
