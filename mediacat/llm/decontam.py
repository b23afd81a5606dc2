"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shingles, string_slices, word_hashes

#: Words of benchmark text that one pass over the documents carries; a larger benchmark is taken in blocks of about so many.
BLOCK_WORDS = 2_000_000


def running_matches(p: np.ndarray, d: np.ndarray, kp: np.ndarray, kd: np.ndarray, free_p: np.ndarray, free_d: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in p, start in d) of at least ``least`` unmarked words.

    ``kp`` and ``kd`` are the Karp-Rabin fingerprints of the windows of ``least`` words; equal fingerprints are extended
    word by word. A window that continues the window before it is not a start.
    """
    where: dict[int, list[int]] = defaultdict(list)
    run = np.concatenate([[0], np.cumsum(~free_p)])
    for i in np.flatnonzero(run[least:] == run[:-least])[: len(kp)] if len(kp) else ():
        where[int(kp[i])].append(int(i))
    run = np.concatenate([[0], np.cumsum(~free_d)])
    found = []
    for j in np.flatnonzero(run[least:] == run[:-least]) if len(kd) else ():
        for i in where.get(int(kd[j]), ()):
            if i and j and free_p[i - 1] and free_d[j - 1] and p[i - 1] == d[j - 1]:
                continue
            n, most = 0, min(len(p) - i, len(d) - j)
            while n < most and p[i + n] == d[j + n] and free_p[i + n] and free_d[j + n]:
                n += 1
            if n >= least:
                found.append((n, i, int(j)))
    return found


def tiles(p: np.ndarray, d: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes: (start in d, start in p, length) of non-overlapping tiles, longest first.

    In each round the longest maximal matches are marked, unless an earlier tile of the round covers part of them; what
    remains of those is found again in a later round. Order within a round: by start in p, then in d.
    """
    kp, kd = (shingles(x, np.array([0, len(x)]), least)[0] if len(x) >= least else np.zeros(0, np.uint64) for x in (p, d))
    free_p, free_d = np.ones(len(p), bool), np.ones(len(d), bool)
    out = []
    while found := running_matches(p, d, kp, kd, free_p, free_d, least):
        longest = max(found)[0]
        for n, i, j in sorted(found):
            if n == longest and free_p[i : i + n].all() and free_d[j : j + n].all():
                free_p[i : i + n] = free_d[j : j + n] = False
                out.append((j, i, n))
    return out


class Probe:
    """Benchmark items as word hashes, with a sorted table of the seeds (windows of ``least`` words)."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.ids, self.words = [], []
        seeds, owner, place = [], [], []
        for item, text in items:
            raw = (text or "").encode("utf-8", "surrogatepass")
            words, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(words) >= least:
                k = shingles(words, np.array([0, len(words)]), least)[0]
                seeds.append(k)
                owner.append(np.full(len(k), len(self.ids)))
                place.append(np.arange(len(k)))
                self.ids.append(item)
                self.words.append(words)
        self.seeds = np.concatenate([*seeds, np.zeros(0, np.uint64)]).astype(np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)[order]

    def run(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item index, tiles) of texts whose tiles cover the item's words up to the threshold."""
        if not len(self.seeds):
            return
        for first, _, data, offsets in string_slices(column):
            words, at = word_hashes(data, offsets)
            k, where = shingles(words, at, self.least)
            lo = np.searchsorted(self.seeds, k)
            hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == k)
            rows = np.searchsorted(where, hit, "right") - 1
            for row in np.unique(rows):
                if at[row + 1] - at[row] < self.least:
                    continue
                mine = hit[rows == row]
                own = words[at[row] : at[row + 1]]
                spots: dict[int, set] = defaultdict(set)
                near = np.zeros(len(own), bool)
                for h in mine:
                    start = h - where[row]
                    near[start : start + self.least] = True
                    for s in range(lo[h], np.searchsorted(self.seeds, k[h], "right")):
                        spots[int(self.owner[s])].add(int(self.place[s]))
                # words outside all seeds are in no tile: runs of them shrink to one word that matches nothing
                keep = near | np.concatenate([[True], near[:-1]])
                index = np.flatnonzero(keep)
                short = np.where(near[index], own[index], np.uint64(0))
                for item, starts in sorted(spots.items()):
                    words_of = self.words[item]
                    reach = np.zeros(len(words_of), bool)
                    for s in starts:
                        reach[s : s + self.least] = True
                    if reach.sum() >= self.coverage * len(words_of):
                        made = [(int(index[j]), i, n) for j, i, n in tiles(words_of, short, self.least)]
                        if sum(t[2] for t in made) >= self.coverage * len(words_of):
                            yield first + int(row), item, made


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items, some of about ``block_words`` words at a time: a bound on what the driver and each task hold.

    One count sets the number of blocks; a hash of the id deals the items to them.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    n = -(-total // block_words)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


PAIRS = "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, longest long, tiles array<struct<doc_word:long,item_word:long,words:long>>"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(document, item) pairs where tiles of at least ``least`` words cover ``coverage`` of the item's words.

    Words are runs of other than ASCII white space, A-Z as a-z. Tiles may stand in the document in any order, so reordered
    passages count. The documents are scanned once for each block of the benchmark, without a shuffle: a seed table of the
    block goes to every task. Items with fewer than ``least`` words, or null, match nothing; null and empty documents have
    no leaks; repeated rows give repeated pairs. Other columns than doc_id, text and item_id, text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for n, items in enumerate(blocks(benchmark, block_words)):
        found = rows.mapInArrow(_finder(items, least, coverage), PAIRS)
        out = found if n == 0 else out.unionByName(found)
    return out


def _finder(items: list[tuple[int, str]], least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(items, least, coverage)
        names = [x.split()[0] for x in PAIRS.split(", ")]
        kinds = [*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))]
        for batch in batches:
            made = []
            for row, item, found in probe.run(batch.column(1)):
                covered, size = sum(t[2] for t in found), len(probe.words[item])
                spans = [{"doc_word": j, "item_word": i, "words": n} for j, i, n in found]
                made.append((batch.column(0)[row].as_py(), probe.ids[item], size, covered, covered / size, len(found), max(t[2] for t in found), spans))
            columns = zip(*made, strict=True) if made else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, that leak no item; one scan a block, no shuffle. See :func:`leaks`."""
    names = docs.columns
    out = docs
    for items in blocks(benchmark, block_words):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            probe = Probe(items, least, coverage)
            at = names.index("text")
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in probe.run(batch.column(at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
