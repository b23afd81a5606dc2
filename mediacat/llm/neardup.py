"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import bits_apart, linked_classes, thinned
from .shared import discard, mix64, once, shingles, string_slices, word_hashes, written

#: Bytes of text that a task takes apart at a time, which bounds the arrays made of them.
SLICE_BYTES = 1 << 18

#: Documents of an open bucket whose sets a task holds at a time.
GROUP = 1 << 10

#: 40 bands of 6 values; 120 permutations give 240 values. A pair at a similarity of 0.8 is missed once in 190,000.
BANDS, ROWS = 40, 6

#: Permutations of a fine sketch, which has one bit of the minimum and one of the maximum under each.
FINE = 512

_random = np.random.default_rng(7)
_PERMUTED = _random.integers(0, 1 << 31, (2, BANDS * ROWS // 2 + FINE), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sorted distinct shingle hashes of each text, some MB at a time."""
    for first, _, data, offsets in string_slices(column, SLICE_BYTES):
        words, places = word_hashes(data, offsets)
        hashes, at = shingles(words, places, k)
        yield first, [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _extremes(sets: list[np.ndarray], first: int, many: int) -> np.ndarray:
    """The minima, then the maxima, of each non-empty set under ``many`` permutations; each is evaluated once."""
    joined = np.concatenate(sets)
    low = (joined >> np.uint64(32)).astype(np.uint32) ^ joined.astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.empty((len(sets), 2 * many), np.uint64)
    step = np.empty_like(low)
    for i in range(many):
        np.bitwise_xor(low, _PERMUTED[0, first + i], out=step)
        np.multiply(step, _PERMUTED[1, first + i], out=step)
        values[:, i] = np.minimum.reduceat(step, starts)
        values[:, many + i] = np.maximum.reduceat(step, starts)
    return values


def _bits(values: np.ndarray) -> np.ndarray:
    """One bit of each value, 64 to a word."""
    bits = (mix64(values) & np.uint64(1)).reshape(len(values), -1, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (one row a set, BANDS columns) and sketches (two columns) of non-empty sets.

    Each permutation of the hashes is evaluated once and gives two values, its minimum and its maximum. These go to bands
    that lie half the bands apart, so a band has at most one value of a permutation. A sketch has one bit of each of 128
    values.
    """
    values = _extremes(sets, 0, BANDS * ROWS // 2)
    sketch = _bits(values[:, :128])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix64(keys ^ values[:, j::ROWS]) + np.uint64(j)
    return mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), sketch


def least_bits(bits: int, percent: int) -> int:
    """In so many of a sketch's bits at least two linked sets agree, but for a chance of some 3 in 10 million.

    Their agreement is binomial with a mean of (1 + similarity) / 2, and this is five standard deviations less.
    """
    p = (1 + percent / 100) / 2
    return int(bits * p - 5 * (bits * p * (1 - p)) ** 0.5)


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, bands array<long>"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, a 128-bit digest of the shingle set, sketch, band keys); only the first two of an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), k):
                full = [s for s in sets if len(s)]
                keys, sketch = signatures(full) if full else (np.zeros((0, BANDS), np.uint64), np.zeros((0, 2), np.uint64))
                spread = np.zeros((len(sets), 2), np.int64)
                spread[[len(s) > 0 for s in sets]] = sketch.view(np.int64)
                keys = iter(keys.view(np.int64))
                digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else [None, None] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digest], pa.int64()),
                        pa.array([d[1] for d in digest], pa.int64()),
                        pa.array(spread[:, 0].copy()),
                        pa.array(spread[:, 1].copy()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def fine_sketches(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, fine: the words of its fine sketch as columns f0, f1, ...) of the documents named, and of few others."""
    words = 2 * FINE // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), k):
                at = [i for i, s in enumerate(sets) if len(s)]
                if at:
                    fine = _bits(_extremes([sets[i] for i in at], BANDS * ROWS // 2, FINE)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + i for i in at])), *(pa.array(fine[:, j].copy()) for j in range(words))], names=["id", *(f"f{j}" for j in range(words))])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return thinned(rows, ids, "doc_id", run, "id long, " + ", ".join(f"f{j} long" for j in range(words))).dropDuplicates(["id"])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``texts`` (id, line) whose full shingle sets have 100 * intersection >= percent * union.

    Texts are joined to the pairs (they shuffle smaller than sets of hashes), ordered by b; the sets of the last few
    hundred texts are kept in a task.
    """
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("line").alias("tb")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("line").alias("ta")), "a").select("a", "ta", "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def sets_of(ids: list[int], column: pa.Array) -> None:
            new = list({d: i for i, d in enumerate(ids) if d not in known}.values())
            for first, sets in shingle_sets(column.take(pa.array(new, pa.int64())), k):
                for i, s in enumerate(sets):
                    known[ids[new[first + i]]] = s

        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                a, b = part.column(0).to_pylist(), part.column(2).to_pylist()
                if sum(map(len, known.values())) > 1_000_000:
                    known.clear()
                sets_of(a, part.column(1))
                sets_of(b, part.column(3))
                linked = []
                for x, y in zip(a, b, strict=True):
                    if similar(known[x], known[y], percent):
                        linked.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if not 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) > 0:
        return False
    common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
    return 100 * common >= percent * (len(p) + len(q) - common)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents are linked if their sets of distinct ``k``-word shingles (a shorter text is one shingle; words are runs of
    other than ASCII white space, A-Z as a-z) share at least ``percent`` of their union. ``component_id`` is the smallest
    doc_id that links reach. Copies of one set are represented by the smallest doc_id from the start. A text without words,
    or null, is linked with nothing. A null doc_id is linked with nothing, has no component and is kept. Rows that share a
    doc_id are one document and all have its component (doc_ids are meant to be unique). Other columns are not read.
    """
    base = written(signed(docs, k), "signed")
    full = base.where("n_shingles > 0 and doc_id is not null")
    groups = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("low")), "groups")
    low = groups.select(F.col("low").alias("doc_id")).distinct()
    items = full.dropDuplicates(["doc_id"]).join(low, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "s1", "s2", F.col("bands").alias("keys"))
    items = written(items, "items")

    most, finest = 128 - least_bits(128, percent), 2 * FINE - least_bits(2 * FINE, percent)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes, sketches and, where there are any, fine sketches of two sides."""
        apart = bits_apart(a[1:3], b[1:3])
        no = (100 * np.minimum(a[0], b[0]) < percent * np.maximum(a[0], b[0])) | (apart > most)
        if len(a) > 3:
            apart = bits_apart(a[3:], b[3:])
            no |= apart > finest
        return np.where(no, np.inf, apart)

    keys = [(items.select("keys", "id"), items.count() * BANDS)]

    def texts_of(ids: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("line"))
        return thinned(rows, ids, "id").join(ids, "id").dropDuplicates(["id"])

    def sets_of(texts: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
        chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
        return [s for chunk in chunks for _, sets in shingle_sets(chunk, k) for s in sets]

    texts, whole, tables = (texts_of, lambda p, q: similar(p, q, percent)), once(texts_of, "texts"), []
    classes, _ = linked_classes(keys, items.drop("keys"), near, lambda pairs: confirmed(pairs, whole(tables[-1]), k, percent), "neardup", lambda ids: fine_sketches(docs, ids, k), texts, sets_of, GROUP, tables.append)
    discard(items)
    placed = groups.join(classes.withColumnRenamed("id", "low"), "low", "left").select("d1", "d2", F.coalesce("component", "low").alias("component_id"))
    out = base.join(placed, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
