"""Indexers that can be stopped and go on: what is done and what failed is kept, and two runs do not overlap."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.store import Store
from ..work import CLEANUP, discard, setting, work_dir, written

#: Files that a chunk's rows are dealt to at most.
TASKS_A_CHUNK = 8


class Busy(Exception):
    """Another run holds the lease."""


@contextmanager
def lease(store: Store, name: str, seconds: int = 3600) -> Iterator[Callable[[], None]]:
    """Holds ``name`` while the block runs, which calls the given function now and then to stay the owner.

    The lease is a file that is made only where there is none. One that was not renewed for so long belongs to a dead run and is taken.
    """
    files, owner = store._files, uuid.uuid4().hex
    at = store._path(f"{store.path}/leases/{name}")

    def write(path, replace: bool) -> None:
        stream = files.create(path, replace)
        stream.write(bytearray(json.dumps({"owner": owner, "until": time.time() + seconds}).encode()))
        stream.close()

    def holder() -> dict:
        stream = files.open(at)
        try:
            return json.loads(store._text.toString(stream, "UTF-8") or "{}")
        finally:
            stream.close()

    if files.exists(at):
        found = holder()
        if found.get("until", files.getFileStatus(at).getModificationTime() / 1000 + seconds) > time.time():
            raise Busy(f"{name} is held until {found.get('until')}")
        # of several that find it dead, one moves it away
        if not files.rename(at, store._path(f"{store.path}/leases/.{owner}")):
            raise Busy(name)
        files.delete(store._path(f"{store.path}/leases/.{owner}"), False)
    try:
        write(at, False)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        raise Busy(name) from None

    def renew() -> None:
        if holder().get("owner") != owner:
            raise Busy(f"{name} was taken")
        write(at, True)

    try:
        yield renew
    finally:
        if files.exists(at) and holder().get("owner") == owner:
            files.delete(at, False)


def guarded(rows: DataFrame, one: Callable[[pd.Series], dict], schema: StructType, key: str) -> DataFrame:
    """``one`` of each row, as (key, columns of ``schema``, error): a row that raises has an error, and stops nothing."""
    names = schema.names
    out = StructType([rows.schema[key], *schema.fields, StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for _, row in batch.iterrows():
                try:
                    made.append({key: row[key], "error": None} | one(row))
                except Exception as e:  # noqa: BLE001  whatever a row does
                    made.append({key: row[key], "error": f"{type(e).__name__}: {e}"[:200]} | dict.fromkeys(names))
            yield pd.DataFrame(made, columns=out.names).astype(object)

    return rows.mapInPandas(run, out)


class Indexer:
    """Runs an extraction over the rows of a source that it has not been run on.

    The store's table ``<name>`` has a row a key done, ``<name>_failed`` the attempts and last error of those that failed, which are tried
    again up to ``attempts`` times. The work is done in chunks of the keys' hashes, a commit each; a run that is cancelled (:meth:`cancel`,
    by job tag, from any thread) or dies keeps its chunks, and the next goes on with what is left, so no row is done twice.
    """

    def __init__(self, store: Store, name: str, key: str, schema: StructType, extract: Callable[[DataFrame], DataFrame], attempts: int = 3, chunk_rows: int = 1_000_000):
        self.store, self.name, self.key, self.extract, self.attempts, self.chunk_rows = store, name, key, extract, attempts, chunk_rows
        self.tag = f"index-{name}"
        tables = store.snapshot()["tables"]
        if name not in tables:
            store.create(name, schema, key)
        if f"{name}_failed" not in tables:
            store.create(f"{name}_failed", StructType([schema[key], *StructType.fromDDL("attempts int, error string").fields]), key)

    def todo(self, source: DataFrame) -> DataFrame:
        done = self.store.read(self.name).select(self.key)
        failed = self.store.read(f"{self.name}_failed").where(F.col("attempts") >= self.attempts).select(self.key)
        return source.where(F.col(self.key).isNotNull()).join(done.unionByName(failed), self.key, "left_anti")

    def _dealt(self, source: DataFrame) -> tuple[DataFrame, int]:
        """What is to do, with the attempts before (``_tried``), written by chunk, and the number of chunks.

        Source and tables are read once a run, whatever the number of chunks, and a chunk reads its own files only. Nobody else changes the
        tables meanwhile: the run has the lease.
        """
        before = self.store.read(f"{self.name}_failed").select(self.key, F.col("attempts").alias("_tried"))
        todo = self.todo(source).join(before, self.key, "left").withColumn("_tried", F.coalesce("_tried", F.lit(0)))
        todo = written(todo, "todo")
        n = todo.count()
        chunks = max(1, -(-n // self.chunk_rows))
        key = F.xxhash64(self.key)
        dealt = todo.withColumn("_chunk", F.pmod(key, F.lit(chunks)).cast("int")).withColumn("_part", F.pmod(F.shiftright(key, 40), F.lit(TASKS_A_CHUNK)))
        at = work_dir(self.store.spark, "chunks")
        with setting(self.store.spark, CLEANUP, "true"):
            dealt.repartition(min(n // 1000 + 1, chunks * TASKS_A_CHUNK), "_chunk", "_part").write.partitionBy("_chunk").parquet(at)
        discard(todo)
        return self.store.spark.read.schema(dealt.schema).parquet(at), chunks

    def run(self, source: DataFrame, on_chunk: Callable[[int, int], None] | None = None) -> int:
        """Returns the number of chunks committed; :class:`Busy` if another run is on."""
        spark = self.store.spark
        with lease(self.store, self.name) as renew:
            spark.sparkContext.addJobTag(self.tag)
            try:
                held, chunks = self._dealt(source)
                for i in range(chunks):
                    renew()
                    part = held.where(F.col("_chunk") == i).drop("_chunk", "_part")
                    with self.store.change() as change:
                        made = self.extract(part.drop("_tried")).persist()
                        try:
                            change.upsert(self.name, made.where("error is null").drop("error"))
                            before = part.where("_tried > 0").select(self.key, F.col("_tried").alias("n")).distinct()
                            failed = made.where("error is not null").select(self.key, "error").join(before, self.key, "left")
                            change.upsert(f"{self.name}_failed", failed.select(self.key, (F.coalesce("n", F.lit(0)) + 1).alias("attempts"), "error"))
                            change.delete(f"{self.name}_failed", made.where("error is null").join(before, self.key, "left_semi"))
                        finally:
                            made.unpersist()
                    if on_chunk:
                        on_chunk(i + 1, chunks)
            finally:
                spark.sparkContext.removeJobTag(self.tag)
        return chunks

    def cancel(self) -> None:
        """Ends the jobs of a run, here or in another thread of the session."""
        self.store.spark.sparkContext.cancelJobsWithTag(self.tag)


def chain(store: Store, tasks: list[tuple[Indexer, DataFrame]], name: str = "chain") -> bool:
    """Runs indexers one after another; false, and nothing done, if such a run is on. An indexer that is busy is left to its own run."""
    try:
        with lease(store, name) as renew:
            for indexer, source in tasks:
                renew()
                try:
                    indexer.run(source)
                except Busy:
                    continue
    except Busy:
        return False
    return True
