"""Bursts of a stream of images: groups are closed as the watermark passes, whatever files the images come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sequences import burst_rows
from ..sources.store import Change, Store
from ..work import written

_IMAGE = StructType().add("id", "long").add("parent_path", "string").add("date_taken", "long")
_BURST = StructType().add("first_id", "long").add("n", "long").add("folder", "string").add("first_taken", "long").add("last_taken", "long")
_OPEN = StructType().add("k", "integer").add("seen", "long").add("closed", "long").add("last_id", "long").add("first_id", "long").add("n", "long").add("folder", "string").add("first_taken", "long").add("last_taken", "long")


def burst_store(store: Store, buckets: int = 16) -> Store:
    """The tables: ``pending`` images above the watermark, ``late`` ones that came below it, ``bursts``, and the one open group."""
    store.create("pending", _IMAGE, "id", buckets=buckets)
    store.create("late", _IMAGE, "id", buckets=buckets)
    store.create("bursts", _BURST, "first_id", buckets=buckets)
    store.create("open", _OPEN, "k", buckets=1)
    return store


def advance(change: Change, images: DataFrame | None, delay_ms: int, gap_ms: int = 3000, to_end: bool = False) -> None:
    """Takes in some images (id, parent_path, date_taken) and closes what lies ``delay_ms`` or more before the latest one seen.

    State is what is above the watermark, and one row: the last closed image with its group. The images that the watermark passes are
    grouped as in :func:`burst_rows` with that row before them, as an image of another folder in between ends a group; the last group
    stays open. Images at or below a watermark that has passed are late: they are kept apart by name and change no group. Images of unknown
    time are in no burst. ``to_end`` closes all.
    """
    before = change.read("open").first()
    seen, closed = (before.seen, before.closed) if before else (None, None)
    waiting = change.read("pending")
    if images is not None:
        fresh = written(images.select(*[F.col(f.name).cast(f.dataType) for f in _IMAGE]).where("id is not null and date_taken > 0"), "fresh")
        newest = fresh.agg(F.max("date_taken")).first()[0]
        seen = max(x for x in (seen, newest) if x is not None) if newest is not None or seen is not None else None
        if closed is not None:
            change.upsert("late", fresh.where(F.col("date_taken") <= closed))
            fresh = fresh.where(F.col("date_taken") > closed)
        waiting = waiting.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
    if seen is None:
        return
    mark = seen if to_end else seen - delay_ms
    mark = mark if closed is None else max(mark, closed)
    rows = waiting.where(F.col("date_taken") <= mark)
    state = (0, seen, mark, *((before.last_id, before.first_id, before.n, before.folder, before.first_taken, before.last_taken) if before else [None] * 6))
    if before and before.last_id is not None:
        rows = rows.unionByName(change.store.spark.createDataFrame([(before.last_id, before.folder, before.last_taken)], _IMAGE))
    last = F.max(F.struct("date_taken", "id"))
    groups = burst_rows(rows, gap_ms).groupBy("group").agg(F.count("*").alias("n"), F.min("parent_path").alias("folder"), F.min("date_taken").alias("first_taken"), last.alias("last"))
    groups = written(groups.select(F.col("group.id").alias("first_id"), "n", "folder", "first_taken", F.col("last.date_taken").alias("last_taken"), F.col("last.id").alias("last_id")), "groups")
    if before and before.last_id is not None:  # the group that begins with the carried image goes on
        goes_on = F.col("first_id") == before.last_id
        groups = groups.withColumns({"first_id": F.when(goes_on, before.first_id).otherwise(F.col("first_id")), "n": F.col("n") + F.when(goes_on, before.n - 1).otherwise(0), "first_taken": F.when(goes_on, before.first_taken).otherwise(F.col("first_taken"))})
    end = groups.agg(F.max_by(F.struct(*groups.columns), F.struct("last_taken", "last_id")).alias("g")).first().g
    if end is not None:
        state = (0, seen, mark, end.last_id, end.first_id, end.n, end.folder, end.first_taken, end.last_taken)
    final = F.lit(to_end) | (F.col("last_taken") < mark - gap_ms) | (F.col("last_id") != (end.last_id if end else None))
    change.upsert("bursts", groups.where((F.col("n") >= 2) & F.coalesce(final, F.lit(False))))
    change.replace("pending", waiting.where(F.col("date_taken") > mark))
    change.replace("open", change.store.spark.createDataFrame([state], _OPEN))


def burst_stream(source: DataFrame, store: Store, checkpoint: str, delay_ms: int, gap_ms: int = 3000, once: bool = True) -> StreamingQuery:
    """:func:`advance` for each micro-batch, in one commit; a batch that is run again is dropped."""

    def each(batch: DataFrame, number: int) -> None:
        with store.change(checkpoint, number) as change:
            if not change.repeated:
                advance(change, batch, delay_ms, gap_ms)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()
