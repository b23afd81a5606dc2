"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import string_slices

#: Buckets of the hashed n-gram histogram.
BUCKETS = 4096
#: At most about so many labelled documents of each language are fitted on; a bound on the driver's memory.
SAMPLE = 600
#: Loss by which the second codeword must be further than the first.
AMBIGUOUS = 0.1

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32
_FOLD[65:91] += 32
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def features(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vectors of square-rooted counts of the byte 1- to 3-grams of each whole text; other than letters is a space.

    A-Z count as a-z; bytes of other letters stay as they are. An empty or null text is the zero vector.
    """
    out = np.zeros((len(column), buckets), np.float32)
    for first, end, data, offsets in string_slices(column):
        folded = _FOLD[data].astype(np.uint32)
        solid = np.ones(len(folded), bool)  # runs of spaces count once
        solid[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        places = np.concatenate([[0], np.cumsum(solid)])[offsets]
        folded = folded[solid]
        grams = [folded * _MIX[0]]
        grams.append((folded[:-1] * np.uint32(257) + folded[1:] + np.uint32(7)) * _MIX[1])
        grams.append(((folded[:-2] * np.uint32(257) + folded[1:-1]) * np.uint32(263) + folded[2:] + np.uint32(11)) * _MIX[2])
        shift = np.uint32(32 - int(buckets).bit_length() + 1)
        grams = [(g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for g in grams]
        for row in range(first, end):
            a, b = places[row - first], places[row - first + 1]
            if b > a:
                for n, g in enumerate(grams):
                    if b - n > a:
                        out[row] += np.bincount(g[a : b - n], minlength=buckets)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def codebook(classes: int) -> np.ndarray:
    """One codeword of -1/1 for each class: rows of a Hadamard matrix, whose distances are all half their length.

    Columns that are constant over the classes, or repeat or negate another, are left out; one class has one bit.
    """
    n = 8
    while n < 2 * classes:
        n *= 2
    rows = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(n)] for i in range(1, classes + 1)])
    kept: list = []
    for col in rows.T:
        if abs(col.sum()) < classes and not any((col == k).all() or (col == -k).all() for k in kept):
            kept.append(col)
    return np.array(kept, np.int64).T if kept else np.ones((classes, 1), np.int64)


def fit_bits(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 160, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all columns of ``target`` (-1/1) at once, by accelerated gradient steps."""
    w, bias = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    w0, bias0, step = w, bias, np.float32(8.0)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for i in range(rounds):
        m = np.float32(i / (i + 3))
        v, vb = w + m * (w - w0), bias + m * (bias - bias0)
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ v + vb), -30, 30)))
        w0, bias0 = w, bias
        w, bias = v - step * (x.T @ g + decay * v), vb - step * g.sum(0)
    return w.astype(np.float32), bias.astype(np.float32)


class OutputCodes:
    """Binary n-gram classifiers of the bits of language codewords, and their decoder."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        y = np.array([self.names.index(a) for a in labels])
        self.codes = codebook(len(self.names))
        share = np.bincount(y, minlength=len(self.names))
        weight = 1 / share[y]
        self.w, self.bias = fit_bits(x, self.codes[y].astype(np.float32), weight)
        # bits that are learnt better count for more in the decoding
        margin = (x @ self.w + self.bias) * self.codes[y]
        self.trust = ((margin > 0) * weight[:, None]).sum(0) / weight.sum()
        self.trust = (np.maximum(self.trust - 0.5, 0.01) / np.maximum(self.trust - 0.5, 0.01).sum()).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, its softmax weight, and the loss by which the next is further."""
        margin = x @ self.w + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c) @ self.trust for c in self.codes], 1)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        p = np.exp(-len(self.trust) * (loss - ordered[:, :1]))
        return best, 1 / p.sum(1), gap


def fit(docs: DataFrame, train, sample: int = SAMPLE, buckets: int = BUCKETS) -> OutputCodes | None:
    """Learns from text and lang of the rows where ``train`` holds and lang is not null.

    Of each language about ``sample`` rows with the lowest hash of the text are used (all, if there are fewer): a documented
    bound, the same at every size of the table. Executors turn them into histograms; only these reach the driver.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, 1.0 * sample / n) * (1 << 30)))])
    chosen = rows.where(spread < share[F.col("lang")]).select("lang", "text")

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                x = features(part.column(1), buckets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    # copies of one text share a hash: the bound holds for them too
    got = chosen.mapInArrow(histograms, "lang string, x binary").orderBy(F.xxhash64("x"), "lang").limit(2 * sample * len(counts)).toArrow()
    if not got.num_rows:
        return None
    x = np.empty((got.num_rows, buckets), np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    labels = got.column("lang").to_pylist()
    del got
    pa.default_memory_pool().release_unused()
    return OutputCodes(x, labels)


def predict(docs: DataFrame, model: OutputCodes | None, ambiguous_below: float = AMBIGUOUS) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to (doc_id), from whole texts and nothing else.

    Text that is null or has no letter, or any text when nothing was learnt, is ``und`` with score 0. ``ambiguous`` marks
    texts whose second codeword is nearly as near as the first. Columns other than doc_id and text are not read; rows that repeat are predicted alike.
    """
    names = model.names if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(1)
                known = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()]) & bool(names)
                best, score, gap = model.decode(features(texts)) if model else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.where(known, score, 0.0).astype(np.float64)),
                        pa.array(known & (gap < ambiguous_below)),
                    ],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: OutputCodes | None, unclear_below: float = 0.35) -> DataFrame:
    """``docs``, all columns, whose whole text is in a learnt language; one scan, no shuffle.

    Left out: text that is null or has no letter, and ambiguous text (see :func:`predict`) whose score is under
    ``unclear_below``, that is nearly as far from every codeword. With nothing learnt no row is recognised.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(at)
                keep = np.array([bool(model and t and _LETTER.search(t)) for t in texts.to_pylist()])
                if model:
                    _, score, gap = model.decode(features(texts))
                    keep &= (gap >= AMBIGUOUS) | (score >= unclear_below)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
