from mediacat.sources.catalog import Catalog
from mediacat.work import BATCH_ROWS


def test_python_gets_texts_in_batches_of_bounded_bytes(spark, sf):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    Catalog(spark, sf).read("documents")
    wide = spark.range(6000).selectExpr("repeat('x', 20000) as text").coalesce(1)
    got = wide.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.rows for r in got) <= BATCH_ROWS
    assert max(r.bytes for r in got) < 20 << 20
