"""Pieces that several corpus operators use: the shared work folder, written tables, hashing of words, link graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from ..work import discard, work_dir  # noqa: F401

# --------------------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that a Python worker gets at a time; 10,000 (the default) would be tens of MB on either side.
BATCH_ROWS = 2000


def _short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`work.written` in short batches."""
    _short_batches(df.sparkSession)
    return work.written(df, name)


# --------------------------------------------------------------------------- Arrow batches


def string_slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into runs of about ``most_bytes``: (first row, end row, bytes, offsets).

    A null row is empty. A longer text makes a run of its own.
    """
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()


# --------------------------------------------------------------------------- words and shingles

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_MULT, _INV)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z as a-z, and the texts' word offsets."""
    hashes, places, _ = hashed_words(data, offsets, _SPACE)
    return hashes, places


def hashed_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes outside the mask ``between``), the texts' word offsets, the words' bytes."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64)
    word = ~between[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    power, inverse = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_LOWER[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), ends - starts


_ROLES = _random.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles (repeats included) with offsets by text; a shorter text is one shingle."""
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], n)
    short = np.repeat(counts < k, n)
    last = np.repeat(offsets[1:], n)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        value = padded[at + j] * _ROLES[j]
        total += np.where(short & (at + j >= last), np.uint64(0), value) if short.any() else value
    return mix64(total + np.where(short, np.repeat(counts, n).astype(np.uint64) * _ROLES[63], np.uint64(0))), out


# --------------------------------------------------------------------------- link graphs


def once(of: Callable[[DataFrame], DataFrame], name: str) -> Callable[[DataFrame], DataFrame]:
    """From pairs (a, b) to the written table ``of`` their distinct ids (id); it is made anew for other pairs than the last only."""
    last: list = [None, None]

    def get(pairs: DataFrame) -> DataFrame:
        if last[0] is not pairs:
            ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
            last[:] = pairs, written(of(ids), name)
        return last[1]

    return get


#: Edges that a task contracts at a time, and at least so many that it is given, if there are as many.
CONTRACTED = 1 << 16


def _stars(edges: np.ndarray) -> np.ndarray:
    """Rows (id, smallest id of its component) of the other ids of ``edges`` (two columns)."""
    ids, at = np.unique(edges, return_inverse=True)
    at, low = at.reshape(-1, 2), np.arange(len(ids))
    while True:
        ends = low[at]
        ends = ends[ends[:, 0] != ends[:, 1]]
        if not len(ends):
            break
        np.minimum.at(low, ends.max(1), ends.min(1))
        while (low[low] != low).any():
            low = low[low]
    other = low != np.arange(len(ids))
    return np.stack([ids[other], ids[low[other]]], 1)


def _contracted(edges: DataFrame, many: int) -> DataFrame:
    """Edges (u, v) with the components of ``edges``: tasks make stars of CONTRACTED edges at a time, all of them if there are no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[np.ndarray]) -> pa.RecordBatch:
            stars = _stars(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(stars[:, i].copy()) for i in (0, 1)], names=["u", "v"])

        held, room = [], CONTRACTED
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            while len(rows) > room:
                yield made([*held, rows[:room]])
                held, rows, room = [], rows[room:], CONTRACTED
            held.append(rows)
            room -= len(rows)
        if held:
            yield made(held)

    return edges.coalesce(max(1, many // CONTRACTED)).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b), the component being its smallest id.

    Tasks first make stars of the edges that they read, in bounded lots; a list of one lot is done then. Otherwise alternating
    large and small stars: each round is two hash aggregations and two joins on narrow rows, so a hub of
    millions of links is combined before it is shuffled, and the number of rounds is logarithmic. The edge list of each
    round is written to the shared folder. Rounds end when the edges are stars, of which the driver learns yes or no.
    """

    def shortened(df: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
        """``df`` written and contracted, and whether it was one lot."""
        df = written(df, f"{name}-{rounds}")
        many = df.count()
        short = _contracted(df, many)
        return written(short if many <= CONTRACTED else short.distinct(), f"{name}-stars-{rounds}"), many <= CONTRACTED

    cur, done = shortened(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), 0)

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(df.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()

    rounds = 0
    while not done and not stars(cur):
        rounds += 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        cur, done = shortened(small.where("u <> v"), rounds)
    found = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
