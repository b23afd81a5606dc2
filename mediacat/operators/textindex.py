"""Recognised text by a positional index of trigrams: searches with wildcards read postings, and few texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import LOWER, UPPER, like_pattern
from ..sources.store import Store
from ..work import CLEANUP, setting

#: Bytes of text of a posting block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: A byte that no text has: two of them end each text, so that every byte of it begins a trigram.
END = 0xFF

POSTINGS = "block string, gram int, spots binary"
BLOCKS = "block string, paths array<string>, starts array<int>"
TEXTS = "block string, doc int, path string, text string"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Literal(NamedTuple):
    """A run of a pattern without wildcards, as folded bytes, and the trigrams that it needs: (lowest, highest, place) each."""

    data: bytes
    grams: list[tuple[int, int, int]]


def literals(query: str) -> list[Literal]:
    """The runs between % and _ of a query, A-Z as a-z. A run shorter than a trigram asks for all trigrams that begin so."""
    out = []
    for part in re.split("[%_]", query):
        data = part.encode().translate(_FOLD)
        if not data:
            continue
        whole = [data[i : i + 3] for i in range(len(data) - 2)] or [data]
        out.append(Literal(data, [(int.from_bytes(g.ljust(3, b"\0")), int.from_bytes(g.ljust(3, b"\xff")), i) for i, g in enumerate(whole)]))
    return out


class TextIndex:
    """An index in one folder. Texts are added in batches, each of which only adds files, and is seen when it is committed.

    A block is a run of texts as they lie, about BLOCK_BYTES long. Of each block there are the texts' paths and beginnings, and a row a
    trigram with the places of the block's bytes at which it begins. Rows are sorted by trigram in each file, so a search for some
    trigrams reads few row groups. Texts that must be looked at are read from a copy that is sorted by block.
    """

    def __init__(self, store: Store):
        self.store = store
        if "text_batches" not in store.snapshot()["tables"]:
            store.create("text_batches", StructType().add("batch", "string").add("texts", "long"), "batch", buckets=1)

    def _batches(self) -> list[str]:
        return sorted(r.batch for r in self.store.read("text_batches").collect())

    def _read(self, kind: str, schema: str) -> DataFrame:
        spark, batches = self.store.spark, self._batches()
        if not batches:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.store.path}/text-{kind}/{b}" for b in batches])

    def texts(self) -> DataFrame:
        return self._read("copies", TEXTS)

    def add(self, texts: DataFrame) -> int:
        """Indexes the texts (path, text) whose path is not indexed yet; returns their number. Null paths and texts are passed over.

        Of several texts of a path the least one is taken. A batch that dies on the way leaves files that nothing refers to.
        """
        spark = self.store.spark
        new = texts.where("path is not null and text is not null").join(self.texts().select("path"), "path", "left_anti")
        new = new.groupBy("path").agg(F.min("text").alias("text"))
        batch = uuid.uuid4().hex
        at = {kind: f"{self.store.path}/text-{kind}/{batch}" for kind in ("copies", "blocks", "postings")}
        with setting(spark, CLEANUP, "true"):
            new.select("path", "text").mapInArrow(_blocked, TEXTS).write.option("parquet.block.size", 8 << 20).parquet(at["copies"])
            copies = spark.read.schema(TEXTS).parquet(at["copies"])
            # a block's texts lie in one file, in order; a file is not split, so a task sees whole blocks
            with setting(spark, "spark.sql.files.maxPartitionBytes", "1t"):
                copies.select("block", "path", "text").mapInArrow(_described, BLOCKS).write.parquet(at["blocks"])
                copies.select("block", "text").mapInArrow(_posted, POSTINGS).sortWithinPartitions("gram").write.option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(at["postings"])
        n = copies.count()
        if n:
            with self.store.change() as change:
                change.upsert("text_batches", spark.createDataFrame([(batch, n)], "batch string, texts long"))
        return n

    def candidates(self, query: str) -> DataFrame:
        """(block, doc, path) of the texts that hold all literal runs of a query: those that match it, if it is one run."""
        asked = literals(query)
        blocks = self._read("blocks", BLOCKS)
        if not asked:
            return blocks.select("block", F.posexplode("paths").alias("doc", "path"))
        spans = sorted({(low, high) for run in asked for low, high, _ in run.grams})
        wanted = F.lit(False)
        for low, high in spans:
            wanted = wanted | (F.col("gram") == low if low == high else F.col("gram").between(low, high))
        found = self._read("postings", POSTINGS).where(wanted).groupBy("block").agg(F.collect_list(F.struct("gram", "spots")).alias("lists"))
        return found.join(blocks, "block").mapInArrow(_meeting(asked), "block string, doc int, path string")

    def search(self, tokens: list[str], every: bool) -> DataFrame:
        """(path) of the texts that have each token, or any; % and _ are wildcards. Without tokens none."""
        out = None
        for token in tokens:
            found = self.candidates(token)
            if len(literals(token)) != 1 or re.search("[%_]", token):
                found = self._checked(found, token)
            found = found.select("path")
            out = found if out is None else out.join(found, "path", "left_semi") if every else out.unionByName(found)
        return self.store.spark.createDataFrame([], "path string") if out is None else out.distinct()

    def _checked(self, found: DataFrame, token: str) -> DataFrame:
        """The candidates whose text matches; of the copies only row groups with their blocks are read."""
        rows = self.texts()
        blocks = [r.block for r in found.select("block").distinct().limit(1001).collect()]
        if len(blocks) <= 1000:  # the list is pushed to the scan; a longer one would find no row groups to leave out
            rows = rows.where(F.col("block").isin(blocks)) if blocks else rows.limit(0)
        return rows.join(found.select("block", "doc"), ["block", "doc"], "left_semi").where(like_pattern("text", token))


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they come, with the block and the number that they get."""
    block, doc, size = uuid.uuid4().hex, 0, 0
    for batch in batches:
        blocks, docs = [], []
        for n in pc.binary_length(batch.column(1)).to_pylist():
            if size and size + n > BLOCK_BYTES:
                block, doc, size = uuid.uuid4().hex, 0, 0
            blocks.append(block)
            docs.append(doc)
            doc, size = doc + 1, size + n + 2
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(docs, pa.int32()), batch.column(0), batch.column(1)], names=["block", "doc", "path", "text"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list]]]:
    """(block, columns but the first) of each block, whose rows follow one another."""
    block, held = None, []
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != block and held:
                yield block, [list(x) for x in zip(*held, strict=True)]
                held = []
            block = b
            held.append([c[i].as_py() for c in batch.columns[1:]])
    if held:
        yield block, [list(x) for x in zip(*held, strict=True)]


def _starts(texts: list[str]) -> list[int]:
    return np.cumsum([0, *[len(t.encode()) + 2 for t in texts]])[:-1].tolist()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, (paths, texts) in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([paths], pa.list_(pa.string())), pa.array([_starts(texts)], pa.list_(pa.int32()))], names=["block", "paths", "starts"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a trigram of each block; places are kept as steps, which compress well."""
    for block, (texts,) in _runs(batches):
        data = np.frombuffer(b"".join(t.encode().translate(_FOLD) + bytes([END, END]) for t in texts), np.uint8).astype(np.int32)
        grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at = np.flatnonzero(data[:-2] != END)
        order = at[np.argsort(grams[at], kind="stable")]
        own = grams[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        spots = [np.diff(x, prepend=0).astype("<u4").tobytes() for x in np.split(order, first[1:])] if len(own) else []
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(first), pa.string()), pa.array(own[first], pa.int32()), pa.array(spots, pa.binary())], names=["block", "gram", "spots"])


def _meeting(asked: list[Literal]):
    """The texts of each block (block, lists, paths, starts) in which each run stands: its trigrams' places, moved back, have one in common."""

    def places(run: Literal, lists: dict[int, np.ndarray]) -> np.ndarray:
        found: np.ndarray | None = None
        parts = []
        for low, high, at in run.grams:
            own = [lists[low]] if low == high and low in lists else [v for g, v in lists.items() if low <= g <= high] if low != high else []
            if not own:
                return np.zeros(0, np.int64)
            parts.append((np.concatenate(own) if len(own) > 1 else own[0]) - at)
        for x in sorted(parts, key=len):  # the rarest first
            found = x if found is None else found[np.isin(found, x)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one row as Python objects at a time
                row = batch.slice(i, 1).to_pylist()[0]
                lists = {x["gram"]: np.cumsum(np.frombuffer(x["spots"], "<u4").astype(np.int64)) for x in row["lists"]}
                starts, docs = np.array(row["starts"], np.int64), None
                for literal in asked:
                    own = np.unique(np.searchsorted(starts, places(literal, lists), "right") - 1)
                    docs = own if docs is None else np.intersect1d(docs, own)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(docs), pa.string()), pa.array(docs, pa.int32()), pa.array([row["paths"][d] for d in docs], pa.string())], names=["block", "doc", "path"])

    return run
