"""WARC archives of pages, and a two-level capture index over them."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import work_dir, written
from .storage import Reader, Writer

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:mediacat:none"
#: Lines of a compressed index block.
BLOCK = 1000

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_URL = re.compile(r"(?i)^(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)")


def safe_url(url: str | None) -> str:
    """A URL fit for a header line: spaces and control characters are percent-encoded; null is a fixed urn."""
    return NO_URL if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.Example.com:80/a?b#c`` -> ``com,example)/a?b``; others stay as they are."""
    url = safe_url(url)
    if not (m := _URL.match(url)):
        return url
    host = m[2].lower().removeprefix("www.")
    port = f":{m[3]}" if m[3] and m[3] not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + f"{port}){m[4] or '/'}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:mediacat:page:{'' if page_id is None else page_id}>"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_record_id(refers_to)}\r\n" if refers_to is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {_record_id(page_id)}\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    out = {"headers": headers, "payload": block, "http": {}}
    if headers.get("content-type", "").startswith("application/http"):
        http, _, out["payload"] = block.partition(b"\r\n\r\n")
        out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("latin-1").split("\r\n")[1:])}
    return out


def _page(record_id: str) -> int | None:
    number = record_id.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def _result(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of a record; a payload is held to its digest."""
    record = parse_record(data)
    headers, kind = record["headers"], record["headers"]["warc-type"]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(record["http"]["content-length"])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
        if found != digest or len(record["payload"]) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} is not what its digest says")
    refers_to = _page(headers["warc-refers-to"]) if kind == "revisit" else None
    return _page(headers["warc-record-id"]), size, digest, kind, refers_to, headers["warc-target-uri"]


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _batch(rows: list[tuple], schema: str, types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


#: Bytes of archive that a task of a lookup should read at most.
FETCHED = 64 << 20


@dataclass
class Archives:
    """folder: of the .warc.gz files; captures: one row a record (key, file, offset, length)."""

    folder: str
    captures: DataFrame


@dataclass
class Index:
    """folder: of the block files; directory: one row a block (first_key, last_key, file, offset, length, lines)."""

    folder: str
    directory: DataFrame


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, level: int = 1) -> Archives:
    """Writes one record for each row of ``pages`` (page_id, url, html), gzip by record, one archive a task.

    Of equal payloads (null html: empty) of at least ``min_revisit_bytes`` the smallest page_id is the response and others
    revisit it. Payloads are compared by their SHA-1 in narrow rows: counts are combined before the shuffle and the one
    skewed join has a row per page, so the html itself is dealt by page_id only. A null page_id is always a response, and
    so is each of several rows that share the smallest page_id and the payload. Other columns are not read.
    """
    folder = work_dir(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    narrow = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(firsts, "digest").where("page_id <> refers_to").distinct()
    joined = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out = None
        for batch in batches:
            made = []
            for first in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    if out is None:
                        out = Writer(folder, name)
                        info = b"software: mediacat\r\nformat: WARC File Format 1.1\r\n"
                        out.write(_gzip(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:mediacat:info:%d>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (task.partitionId(), DATE.encode(), len(info), info), level))
                    data = _record(page_id, safe_url(url), html.encode("utf-8", "surrogatepass"), refers_to)
                    made.append((url_key(url), name, *out.write(_gzip(data, level))))
            yield _batch(made, "key, file, offset, length", [pa.string(), pa.string(), pa.int64(), pa.int64()])
        if out is not None:
            out.close()

    return Archives(folder, written(joined.mapInArrow(run, "key string, file string, offset long, length long"), "captures"))


def read_archive(folder: str, name: str) -> Iterator[dict]:
    """All records of one archive, in order, without the index."""
    z, data, pending = zlib.decompressobj(31), b"", []
    for chunk in Reader(folder).stream(name):
        while chunk:
            pending.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                data, pending, z = b"".join(pending), [], zlib.decompressobj(31)
                yield parse_record(data)


def write_index(archives: Archives, block: int = BLOCK) -> Index:
    """Sorts the captures by key into compressed blocks of ``block`` lines, with a sparse directory of the blocks.

    The range partitions follow key, file and offset, so a URL of many captures spreads over tasks. Each index file ends
    with its own directory (a JSON list of first key, offset, length) and eight bytes that hold the list's length.
    """
    spark = archives.captures.sparkSession
    folder = work_dir(spark, "index")
    order = ["key", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
        out, lines, blocks = None, [], []

        def close_block(some: list) -> None:
            first, last = some[0][0], some[-1][0]
            place = out.write(zlib.compress("\n".join("\t".join(map(str, x)) for x in some).encode("utf-8", "surrogatepass"), 6))
            blocks.append((first, last, name, *place, len(some)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or Writer(folder, name)
                lines.append(row)
                if len(lines) == block:
                    close_block(lines)
                    lines = []
        if lines:
            close_block(lines)
        if out is not None:
            tail = json.dumps([[b[0], b[1], b[3], b[4]] for b in blocks]).encode()
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
        yield _batch(blocks, "first_key, last_key, file, offset, length, lines", [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 3])

    rows = archives.captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return Index(folder, written(rows.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, lines long"), "directory"))


def _directory(reader: Reader, name: str) -> list:
    f = reader.file(name)
    size = f.size()
    n = int.from_bytes(f.read_at(8, size - 8), "big")
    return json.loads(f.read_at(n, size - 8 - n))


def lookup(index: Index, archives: Archives, keys: DataFrame) -> DataFrame:
    """All captures of ``keys`` (column key), read from the archives: the columns of RESULT.

    A binary search over the index files (one entry a task of write_index, the only thing gathered on the driver) and one
    over a file's own block directory name the blocks of each key. Rows (block, key) are then dealt by block, where each
    block is range-read and decompressed once, its lines are searched, and the records are range-read. The captures of one
    key lie in as many blocks as they fill, so they are read by many tasks. Repeated and null keys count once or not at all.
    """
    files = [
        (r["file"].encode(), r["a"].encode("utf-8", "surrogatepass"), r["b"].encode("utf-8", "surrogatepass"))
        for r in index.directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("a", "b", "file").collect()
    ]
    lows, highs = [f[1] for f in files], [f[2] for f in files]
    index_folder, archive_folder = index.folder, archives.folder

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(index_folder), {}
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                raw = key.encode("utf-8", "surrogatepass")
                for name, _, _ in files[bisect_left(highs, raw) : bisect_right(lows, raw)]:
                    name = name.decode()
                    if name not in known:
                        if len(known) > 8:
                            known.clear()
                        blocks = _directory(reader, name)
                        known[name] = blocks, [b[0].encode("utf-8", "surrogatepass") for b in blocks], [b[1].encode("utf-8", "surrogatepass") for b in blocks]
                    blocks, first, last = known[name]
                    found += [(name, b[2], b[3], key) for b in blocks[bisect_left(last, raw) : bisect_right(first, raw)]]
            yield _batch(found, "file, offset, length, key", [pa.string(), pa.int64(), pa.int64(), pa.string()])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, store, at, lines, starts = Reader(index_folder), Reader(archive_folder), None, [], []
        for batch in batches:
            made = []
            for name, offset, length, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (name, offset):
                    at = name, offset
                    lines = [x.split("\t") for x in zlib.decompress(reader.read(name, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
                    starts = [x[0].encode("utf-8", "surrogatepass") for x in lines]
                raw = key.encode("utf-8", "surrogatepass")
                for _, file, start, size in lines[bisect_left(starts, raw) : bisect_right(starts, raw)]:
                    made.append(_result(zlib.decompress(store.read(file, int(start), int(size)), 31)))
                if len(made) >= 1000:
                    yield _batch(made, RESULT, _types)
                    made = []
            yield _batch(made, RESULT, _types)

    wanted = keys.select("key").where("key is not null").distinct()
    located = wanted.mapInArrow(locate, "file string, offset long, length long, key string")
    # as many tasks as the archives' bytes ask for: the rows that are dealt are narrow, what they read is not
    size = archives.captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FETCHED)
    return located.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(fetch, RESULT)


def keys_of(urls: DataFrame) -> DataFrame:
    """The index keys of ``urls`` (column url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "key string")
