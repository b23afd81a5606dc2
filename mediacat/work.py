"""The work folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where a session names none, one machine (tests) gets a temporary folder; a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mediacat-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mediacat-{name}-{uuid.uuid4().hex}"


#: Rows and bytes that a Python worker gets at a time; Spark's 10,000 rows of whole texts or postings would be GBs.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


def short_batches(spark: SparkSession) -> None:
    """Batches for Python of a bounded size, unless the session asks for others; they are read when a query runs, so the setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting while the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives a lost executor."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if "/mediacat-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
