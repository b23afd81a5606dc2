"""ZIP archives: written from rows, and read by range, entry by entry, in as many tasks as there are entries to deal."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutate import inserted
from ..operators.scan import MANIFEST
from .store import Change

ENTRIES = "archive string, name string, offset long, packed long, size long, crc long, method int"
CONTENTS = "archive string, name string, content binary, error string"
#: Packed bytes that a task reads, about, and tasks at most.
TASK_BYTES, MOST_TASKS = 32 << 20, 10_000
#: The local header of an entry: its fixed part, which ends with the lengths of the name and of the extra field.
_HEADER = struct.Struct("<4s5H3I2H")


def _file_system(address: str) -> tuple[fs.FileSystem, str]:
    """Local disks and the stores that pyarrow knows; an address of another kind is an error at once."""
    return fs.FileSystem.from_uri(address if "://" in address else "file://" + address.removeprefix("file:"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (archive, name, content) as ``<folder>/<archive>.zip`` and returns the addresses (archive).

    Each archive is streamed by one task, entry by entry in the order of their names, and moved to its name when it is whole; names of one
    archive are distinct.
    """
    _file_system(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name, attempt, packed, out = None, "", None, None
        made = []

        def close() -> None:
            if packed is not None:
                packed.close()
                out.close()
                system.move(f"{root}/.{attempt}", f"{root}/{name}.zip")
                made.append(f"{folder}/{name}.zip")

        for batch in batches:
            for archive, entry, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    close()
                    name, attempt = archive, uuid.uuid4().hex
                    out = system.open_output_stream(f"{root}/.{attempt}", compression=None)
                    packed = zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_DEFLATED)
                packed.writestr(entry, content or b"")
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    dealt = rows.select("archive", "name", F.col("content").cast("binary")).repartition("archive").sortWithinPartitions("archive", "name")
    return dealt.mapInArrow(run, "archive string")


class _Forward(io.RawIOBase):
    """A stream that is only written forwards, as object stores have it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False


def entries(archives: DataFrame) -> DataFrame:
    """The entries of (archive) addresses, from the directory at each one's end, of which alone bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                system, path = _file_system(address)
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    found = [e for e in z.infolist() if not e.is_dir()]
                columns = [[address] * len(found), [e.filename for e in found], [e.header_offset for e in found], [e.compress_size for e in found], [e.file_size for e in found], [e.CRC for e in found], [e.compress_type for e in found]]
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    # rows are small and their work is not: a stated number of partitions is not coalesced
    rows = archives.select("archive").distinct()
    return rows.repartition(min(max(rows.count(), 1), MOST_TASKS), "archive").mapInArrow(run, ENTRIES)


def contents(found: DataFrame) -> DataFrame:
    """(archive, name, content, error) of entries, each read by its range, unpacked and held against its checksum.

    Entries are dealt to tasks by archive and place, so a large archive is read by many. A damaged or unknown one has an error and
    no content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address, f = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != address:
                    address = row["archive"]
                    system, path = _file_system(address)
                    f = system.open_input_file(path)
                content, error = None, None
                try:
                    content = _entry(f, row)
                except (ValueError, zlib.error, struct.error, OSError) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([row["name"]]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["archive", "name", "content", "error"])

    n, size = found.agg(F.count("*"), F.coalesce(F.sum("packed"), F.lit(0))).first()
    parts = max(-(-size // TASK_BYTES), min(n, found.sparkSession.sparkContext.defaultParallelism), 1)
    return found.repartition(min(parts, MOST_TASKS), "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, CONTENTS)


def _entry(f, row: dict) -> bytes:
    head = _HEADER.unpack(f.read_at(_HEADER.size, row["offset"]))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no entry at its place")
    data = f.read_at(row["packed"], row["offset"] + _HEADER.size + head[9] + head[10])
    if row["method"] == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif row["method"] != zipfile.ZIP_STORED:
        raise ValueError(f"method {row['method']}")
    if len(data) != row["size"] or zlib.crc32(data) != row["crc"]:
        raise ValueError("checksum")
    return data


def import_people(change: Change, archives: DataFrame, now: int) -> None:
    """Takes the people and face crops of archives with a ``manifest.json`` into persons, crops and import_manifests, in one commit.

    A manifest whose bytes were imported before, or that an earlier archive of this call has, adds nothing. Names are trimmed, people
    without name or folder skipped, and a person of the name is found rather than made again. A crop has the digest of its bytes, or none if
    the archive has no such entry or a damaged one. New ids follow the largest, in the order of names.
    """
    found = entries(archives)
    manifests = contents(found.where("name = 'manifest.json'")).where("error is null")
    manifests = manifests.withColumn("manifest_hash", F.sha2("content", 256)).groupBy("manifest_hash").agg(F.min(F.struct("archive", "content")).alias("m"))
    manifests = manifests.join(change.read("import_manifests").select("manifest_hash"), "manifest_hash", "left_anti").select("manifest_hash", "m.archive", F.decode("m.content", "UTF-8").alias("text"))
    people = manifests.select("manifest_hash", "archive", F.explode(F.from_json("text", MANIFEST)["people"]).alias("p"))
    people = people.select("manifest_hash", "archive", F.trim("p.name").alias("name"), "p.folder", "p.crops").where("name <> '' and folder <> '' and crops is not null")
    persons = change.read("persons")
    fresh = people.select("name").distinct().join(persons.select("name"), "name", "left_anti")
    change.upsert("persons", inserted(persons, fresh, "name").join(persons.select("id"), "id", "left_anti"))
    known = change.read("persons").groupBy("name").agg(F.min("id").alias("person_id"))
    crops = people.join(known, "name").select("archive", "person_id", F.explode("crops").alias("crop"))
    wanted = found.withColumnRenamed("name", "crop").join(crops.select("archive", "crop").distinct(), ["archive", "crop"], "left_semi").withColumnRenamed("crop", "name")
    digests = contents(wanted.select(found.columns)).select("archive", F.col("name").alias("crop"), F.sha2("content", 256).alias("digest"))
    change.upsert("crops", crops.join(digests, ["archive", "crop"], "left"))
    counts = people.groupBy("manifest_hash").agg(F.count_distinct("name").alias("n"))
    taken = manifests.select("manifest_hash").join(counts, "manifest_hash", "left").select("manifest_hash", F.lit(now).cast("long").alias("imported_at"), F.coalesce("n", F.lit(0)).alias("person_count"))
    change.upsert("import_manifests", taken)
