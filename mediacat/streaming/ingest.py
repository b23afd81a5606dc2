"""Incremental upkeep: new files become changes of the media table and refresh the folders that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import folders
from ..sources.store import Change, Store

#: What the media table is bucketed on, so that a folder's rows lie together.
FOLDER_OF_PATH = "regexp_replace(full_path, '/[^/]*$', '')"


#: Rows of a file, about.
FILE_ROWS = 250_000


def files_for(rows: DataFrame) -> int:
    """The number of files that rows are to come in, so that no task sees all of a large batch."""
    return rows.count() // FILE_ROWS + 1


def media_store(store: Store, media: DataFrame, directories: bool = True, buckets: int = 64) -> Store:
    """Creates the media table, and that of the folders, in an empty store."""
    store.create("media", media.schema, "full_path", buckets=buckets, bucket_on=FOLDER_OF_PATH)
    if directories:
        store.create("directories", folders.rollup(media.limit(0)).schema, "path", buckets=buckets)
    return store


def refresh_folders(change: Change, touched: DataFrame) -> None:
    """Rolls the ``touched`` folders (parent_path) up anew from their buckets of the media table; those without live media go."""
    touched = touched.where("parent_path is not null").distinct()
    rows = change.read("media", change.buckets_of("media", touched)).where("deleted_ts = 0").join(touched, "parent_path", "left_semi")
    change.upsert("directories", folders.rollup(rows))
    left = rows.select("parent_path").distinct()
    change.delete("directories", touched.join(left, "parent_path", "left_anti").withColumnRenamed("parent_path", "path"))


def upsert_stream(source: DataFrame, store: Store, checkpoint: str, order: Column | None = None, once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch into the store's media and refreshes the folders it touches, in one commit.

    Writes bytes in proportion to the batch and to its folders' rows in the overview, and reads those folders' buckets. ``order`` says which of a batch's
    rows of one path is the last. A batch that is run again after a failure has been committed under its number, and is dropped.
    """

    def each(batch: DataFrame, number: int) -> None:
        with store.change(checkpoint, number) as change:
            if change.repeated:
                return
            batch = batch.persist()
            try:
                change.upsert("media", batch, order)
                refresh_folders(change, batch.select("parent_path"))
            finally:
                batch.unpersist()

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def index_stream(source: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs an indexer over new rows only; what is done is kept by the checkpoint. See ``indexing`` for one that keeps failing rows."""
    return extract(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_since(media: DataFrame, last_id: int) -> DataFrame:
    """The rows that a poll finds: ids above the last one seen."""
    return media.where(F.col("id") > last_id)
