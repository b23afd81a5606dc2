from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediacat.sources.store import Store
from mediacat.streaming import indexing


def test_a_run_reads_its_source_once_whatever_its_chunks(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    rows = spark.range(40).withColumnRenamed("id", "k")
    source = rows.mapInArrow(count, rows.schema)
    bad = F.col("k") % 10 == 0
    extract = lambda part: part.select("k", F.when(~bad, F.col("k") * 2).alias("v"), F.when(bad, "no").alias("error"))
    indexer = indexing.Indexer(Store(spark, f"file://{tmp_path}/s"), "t", "k", StructType().add("k", "long").add("v", "long"), extract, attempts=2, chunk_rows=10)
    assert indexer.run(source) == 4 and looked.value == 40
    indexer.run(source)
    assert {r.k: r.v for r in indexer.store.read("t").collect()} == {k: 2 * k for k in range(40) if k % 10}
    assert sorted((r.k, r.attempts) for r in indexer.store.read("t_failed").collect()) == [(k, 2) for k in (0, 10, 20, 30)]
