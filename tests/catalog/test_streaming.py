from pyspark.sql import functions as F

from mediacat.operators import folders, mutate
from mediacat.sources.catalog import Catalog
from mediacat.sources.store import Store
from mediacat.streaming import ingest


def test_stream_equals_batch(spark, sf, tmp_path):
    media = Catalog(spark, sf).media.withColumn("ord", F.lit(0))
    parts = [media.where(f"id % 3 = {i}") for i in range(2)]
    changed = media.where("id % 3 = 0").withColumn("size", F.col("size") + 1)
    gone = media.where("parent_path like '%/Download/%'").withColumn("deleted_ts", F.lit(5).cast("long"))
    parts.append(changed.withColumn("ord", F.lit(1)).unionByName(changed.withColumn("size", F.lit(-1).cast("long"))).unionByName(gone.withColumn("ord", F.lit(2))))
    store = ingest.media_store(Store(spark, f"file://{tmp_path}/store"), Catalog(spark, sf).media, buckets=8)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(media.schema).parquet(str(tmp_path / "in"))
        ingest.upsert_stream(source, store, str(tmp_path / "check"), order=F.col("ord")).awaitTermination()
    want = media.drop("ord").limit(0)
    for part in parts:
        want = mutate.upsert(want, part, "full_path")
    names = sorted(want.columns)
    got = store.read("media")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    order = ["path", "media_count", "size", "thumbnail"]
    assert sorted(map(tuple, store.read("directories").select(order).collect())) == sorted(map(tuple, folders.rollup(want.where("deleted_ts = 0")).select(order).collect()))
    assert not [r for r in store.read("directories").collect() if "/Download/" in r.path]


def test_a_batch_that_runs_again_is_dropped(spark, sf, tmp_path):
    media = Catalog(spark, sf).media
    store = ingest.media_store(Store(spark, f"file://{tmp_path}/store"), media, buckets=2)
    for label, size in ((0, 1), (1, 2), (1, 3), (0, 4)):
        with store.change("w", label) as change:
            change.upsert("media", media.limit(1).withColumn("size", F.lit(size).cast("long")))
    assert [r.size for r in store.read("media").collect()] == [2] and store.snapshot()["done"] == {"w": 1}


def test_indexer_sees_each_row_once(spark, tmp_path):
    for batch in (range(5), range(5, 9)):
        spark.createDataFrame([(i,) for i in batch], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        ingest.index_stream(source, lambda df: df.selectExpr("id", "id * 2 as twice"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))
    assert ingest.new_since(spark.range(5), 2).count() == 2
