"""Ranked lexical search: dual-sorted posting lists in a wavelet tree per shard, best-first intersection, exact top-k."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import CLEANUP, setting, work_dir
from .shared import hashed_words, string_slices

#: Postings (before repeats are counted) of a shard: it ends with the document that reaches them.
SHARD_WORDS = 1 << 20
#: Words of the queries that are answered in one pass over the index: a bound on what driver and tasks hold of them.
BLOCK_WORDS = 1 << 20
#: Nodes of a query's frontier that are expanded at a time, the best first.
AT_ONCE = 256

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Bytes between terms: all of ASCII but digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = False


def terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, term hashes, the rows' offsets in them) of runs of texts; A-Z as a-z, null has no terms.

    Terms are known by 64-bit hashes: two of 10 million different terms share one with a chance of 3 in a million.
    """
    for first, _, data, offsets in string_slices(texts):
        hashes, places, _ = hashed_words(data, offsets, _BETWEEN)
        yield first, hashes, places


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term of weight 1 adds to a document's score."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Statistics(NamedTuple):
    """Documents with at least one term, and all their terms with repeats."""

    n_docs: int
    n_terms: int


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Statistics:
    """One pass that counts terms; two numbers a batch are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = total = 0
            for _, hashes, places in terms(batch.column(0)):
                n, total = n + int((np.diff(places) > 0).sum()), total + len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found = _rows(docs, key, text).select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return Statistics(found[0] or 0, found[1] or 0)


# --------------------------------------------------------------------------- the index

SHARD = "n_docs long, doc_ids binary, terms binary, ends binary, impacts binary, bits binary"


def _depth(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def shard(ids: list[int | None], hashes: np.ndarray, sizes: np.ndarray, known: Statistics) -> dict:
    """The index of some documents: their terms, one after another, and each one's number of terms.

    Documents are numbered by doc_id (null last). Each term's posting list is in the order of falling impact, and all lists, one after
    another, are one sequence of document numbers, which a wavelet tree holds: level by level a bit of each number, from the highest,
    the numbers being dealt stably to 0 and 1 (the layout that puts all zeros of a level first). A list is a span of the sequence; its
    part below any node of the tree, which is a range of doc_ids, is a span as well, still in the order of falling impact. So one
    structure is sorted both ways.
    """
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    doc = np.repeat(number, sizes)
    order = np.argsort(hashes, kind="stable")
    term, doc = hashes[order], doc[order]
    new_term = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
    key = (np.cumsum(new_term) - 1) * len(ids) + doc
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    of_term, doc = np.divmod(key[first], max(1, len(ids)))
    length = np.empty(len(ids), np.int64)
    length[number] = sizes
    m = 75 + (25 * length * known.n_docs) // max(1, known.n_terms)
    value = impact(tf, m[doc])
    order = np.lexsort((-value, of_term))
    doc, value = doc[order], value[order]
    depth, bits, at = _depth(len(ids)), [], doc
    for level in range(depth):
        bit = ((at >> (depth - 1 - level)) & 1).astype(bool)
        bits.append(np.packbits(bit).tobytes())
        at = np.concatenate([at[~bit], at[bit]])
    own = [ids[i] for i in by_id]
    return {
        "n_docs": len(ids),
        "doc_ids": np.array([x for x in own if x is not None], "<i8").tobytes(),
        "terms": term[new_term].astype("<u8").tobytes(),
        "ends": np.cumsum(np.bincount(of_term, minlength=int(new_term.sum()))).astype("<u4").tobytes(),
        "impacts": value.astype("<u4").tobytes(),
        "bits": b"".join(bits),
    }


def build(docs: DataFrame, known: Statistics | None = None, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index as a table in the shared folder, a row a shard.

    Shards are formed where the documents lie, so nothing is shuffled; a task holds one shard, which a single very long document may
    exceed. Row groups hold few shards, so neither the writer nor a reader gathers many. Documents without terms, null texts among them,
    are left out, as they match nothing; null and repeated doc_ids are documents of their own.
    """
    known = known or statistics(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def done() -> pa.RecordBatch:
            made = shard(ids, np.concatenate(parts), np.concatenate(sizes), known)
            ids.clear(), parts.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array([made["n_docs"]], pa.int64()), *[pa.array([made[c]], pa.binary()) for c in ("doc_ids", "terms", "ends", "impacts", "bits")]], names=[x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, hashes, places in terms(batch.column(1)):
                counts = np.diff(places)
                some = np.flatnonzero(counts)
                ids += [keys[first + i] for i in some.tolist()]
                parts.append(hashes)
                sizes.append(counts[some])
                n += len(hashes)
                if n >= shard_words:
                    yield done()
                    n = 0
        if n:
            yield done()

    spark = docs.sparkSession
    path = work_dir(spark, "search-index")
    made = _rows(docs, key, text).mapInArrow(run, SHARD)
    with setting(spark, CLEANUP, "true"):
        made.write.option("parquet.block.row.count.limit", "2").option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD).parquet(path)


class Tree:
    """A shard's wavelet tree in memory, with ranks and the impacts in the order of each level."""

    def __init__(self, ends: np.ndarray, impacts: np.ndarray, bits: bytes, n_docs: int):
        n = len(impacts)
        self.depth, self.step = _depth(n_docs), n + 1
        self.starts = np.concatenate([[0], ends]).astype(np.int64)
        self.rank = np.zeros(self.depth * self.step, np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        self.impact = np.zeros((self.depth + 1) * self.step, np.int32)
        self.impact[:n] = impacts
        width = -(-n // 8)
        for level in range(self.depth):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, width, level * width), count=n)
            base = level * self.step
            np.cumsum(bit, out=self.rank[base + 1 : base + self.step], dtype=np.int32)
            self.zeros[level] = n - int(self.rank[base + n])
            bit = bit.view(bool)
            at = self.impact[base : base + n]
            self.impact[base + self.step : base + self.step + n] = np.concatenate([at[~bit], at[bit]])


class Frontier(NamedTuple):
    """Nodes (level, prefix of the document numbers below, bound) and their spans of lists, kept together by node."""

    level: np.ndarray
    prefix: np.ndarray
    bound: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    coef: np.ndarray

    def pick(self, nodes: np.ndarray) -> Frontier:
        """Of the nodes those that the mask holds."""
        spans = np.repeat(nodes, self.size)
        return Frontier(self.level[nodes], self.prefix[nodes], self.bound[nodes], self.size[nodes], self.lo[spans], self.hi[spans], self.coef[spans])

    def joined(self, other: Frontier) -> Frontier:
        return Frontier(*[np.concatenate(x) for x in zip(self, other, strict=True)])


def _children(tree: Tree, f: Frontier) -> Frontier:
    """The two children of each node, without those that no list reaches.

    A child's bound is the sum of the impacts at the beginnings of its spans, times the terms' weights: no document below has more, and
    of a single document it is the score.
    """
    level = np.repeat(f.level, f.size)
    base = level * tree.step
    ones_lo, ones_hi = tree.rank[base + f.lo].astype(np.int64), tree.rank[base + f.hi].astype(np.int64)
    zeros = tree.zeros[level]
    node = np.repeat(np.arange(len(f.level)) * 2, f.size)
    lo = np.concatenate([f.lo - ones_lo, zeros + ones_lo])
    hi = np.concatenate([f.hi - ones_hi, zeros + ones_hi])
    node, coef, base = np.concatenate([node, node + 1]), np.concatenate([f.coef, f.coef]), np.concatenate([base, base])
    some = np.flatnonzero(hi > lo)
    some = some[np.argsort(node[some], kind="stable")]
    node, lo, hi, coef, base = node[some], lo[some], hi[some], coef[some], base[some]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    bound = np.add.reduceat(coef * tree.impact[base + tree.step + lo], first)
    own = node[first]
    return Frontier(f.level[own >> 1] + 1, f.prefix[own >> 1] * 2 + (own & 1), bound, np.diff(np.append(first, len(node))), lo, hi, coef)


class Best:
    """The k best (score, document) pairs so far; equal scores by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.missing, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this is not among them."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        score, missing, ids = np.concatenate([self.score, score]), np.concatenate([self.missing, missing]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.missing, self.id = score[order], missing[order], ids[order]


def search(tree: Tree, spans: list[tuple[int, int, int]], doc_ids: np.ndarray, best: Best, at_once: int = AT_ONCE) -> int:
    """Adds a shard's best documents to ``best``; returns the number of nodes looked at.

    ``spans`` has begin and end of each term's list and its coefficient. The frontier's best nodes are expanded first. A node goes as
    soon as its bound is below the k-th score found, in this shard or in one before; one with that very bound stays, as an equal score
    may have a smaller doc_id. So the result is exact.
    """
    lo, hi, coef = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    one = np.zeros(1, np.int64)
    frontier = Frontier(one, one, np.array([int((coef * tree.impact[lo]).sum())]), np.array([len(lo)]), lo, hi, coef)
    looked = 0
    while len(frontier.bound):
        keep = frontier.bound >= best.least
        if not keep.all():
            frontier = frontier.pick(keep)
            if not len(frontier.bound):
                break
        looked += min(at_once, len(frontier.bound))
        if len(frontier.bound) > at_once:
            chosen = np.zeros(len(frontier.bound), bool)
            chosen[np.argpartition(frontier.bound, -at_once)[-at_once:]] = True
            made, rest = _children(tree, frontier.pick(chosen)), frontier.pick(~chosen)
        else:
            made, rest = _children(tree, frontier), None
        leaf = made.level == tree.depth
        if leaf.any():
            good = leaf & (made.bound >= best.least)
            number = made.prefix[good]
            missing = number >= len(doc_ids)
            best.add(made.bound[good], missing, np.where(missing, 0, doc_ids[np.minimum(number, len(doc_ids) - 1)]) if len(doc_ids) else np.zeros(len(number), np.int64))
            made = made.pick(~leaf)
        frontier = made if rest is None else rest.joined(made)
    return looked


# --------------------------------------------------------------------------- queries


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """(number, item_id, terms) of the items, some of about ``block_words`` words at a time."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n, number = -(-total // (6 * block_words)), 0
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        found = part.toArrow()
        made = []
        for column in found.column("text").chunks or []:
            for _, hashes, places in terms(column):
                for a, b in zip(places, places[1:], strict=False):
                    made.append(Counter(hashes[a:b].tolist()))
        ids = found.column("item_id").to_pylist()
        yield [(number + j, item, words) for j, (item, words) in enumerate(zip(ids, made, strict=True)) if words]
        number += len(ids)


def _frequencies(index: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the ``asked`` terms, summed over the shards' directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms_of, ends in zip(batch.column(0), batch.column(1), strict=True):
                at, there = _find(np.frombuffer(terms_of.as_py(), "<u8"), asked)
                total[there] += np.diff(np.frombuffer(ends.as_py(), "<u4").astype(np.int64), prepend=0)[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    with setting(index.sparkSession, _BATCH, "2"):
        found = index.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return {int(asked[t]): n for t, n in zip(found.column("term").to_pylist(), found.column("df").to_pylist(), strict=True)}


def _find(own: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked term in a sorted directory, and whether it is there."""
    at = np.searchsorted(own, asked)
    there = at < len(own)
    there[there] = own[at[there]] == asked[there]
    return at, there


HITS = "item int, doc_id long, score long"


def _searcher(queries: list[tuple[int, list[tuple[int, int]]]], asked: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in queries}
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
                at, there = _find(np.frombuffer(row["terms"], "<u8"), asked)
                if not there.any():
                    continue
                tree = Tree(ends, np.frombuffer(row["impacts"], "<u4"), row["bits"], row["n_docs"])
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                for item, words in queries:
                    spans = [(int(tree.starts[at[t]]), int(ends[at[t]]), coef) for t, coef in words if there[t]]
                    if spans:
                        search(tree, spans, doc_ids, best[item])
        items = np.concatenate([np.full(len(b.score), i, np.int32) for i, b in best.items()] or [np.zeros(0, np.int32)])
        joined = [np.concatenate([getattr(b, c) for b in best.values()] or [np.zeros(0, np.int64)]) for c in ("id", "score", "missing")]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(joined[0], pa.int64(), mask=joined[2].astype(bool)), pa.array(joined[1], pa.int64())], names=["item", "doc_id", "score"])

    return run


def top(index: DataFrame, items: DataFrame, known: Statistics, k: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, exactly; equal scores by ascending doc_id.

    The items go to all tasks in blocks of a bounded number of words, and a block's terms get their weights from one look at the shards'
    directories. A task searches its shards one after another and carries each item's k-th score along, so later shards are pruned more;
    it hands on k rows an item. Items that share an id, or a text, are ranked each on its own; null texts, and texts without terms or
    without matches, give no rows; other columns are not read.
    """
    spark = index.sparkSession
    names = spark.createDataFrame([], "item int, item_id long")
    hits = spark.createDataFrame([], HITS)
    for block in _blocks(items, block_words):
        asked = np.array(sorted({t for _, _, words in block for t in words}), np.uint64)
        if not len(asked):
            continue
        df = _frequencies(index, asked)
        place = {int(t): i for i, t in enumerate(asked)}
        queries = []
        for number, _, words in block:
            made = [(place[t], repeats * weight(known.n_docs, df[t])) for t, repeats in words.items() if t in df]
            made = [x for x in made if x[1] > 0]
            if made:
                queries.append((number, made))
        path = work_dir(spark, "search-hits")
        with setting(spark, _BATCH, "2"), setting(spark, CLEANUP, "true"):
            index.mapInArrow(_searcher(queries, asked, k), HITS).write.parquet(path)
        hits = hits.unionByName(spark.read.schema(HITS).parquet(path))
        names = names.unionByName(spark.createDataFrame(pa.table({"item": pa.array([n for n, _, _ in block], pa.int32()), "item_id": pa.array([i for _, i, _ in block], pa.int64())})))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """:func:`top` over an index of all ``docs``; an empty table of documents or items gives no rows."""
    known = statistics(docs, key, text)
    return top(build(docs, known, key, text, shard_words), items, known, k, block_words)

