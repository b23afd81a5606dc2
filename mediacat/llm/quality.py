"""Document quality by co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_words, mix64, string_slices

#: Bounds on what is fitted on and held by the driver: labelled rows, and rows of the unlabelled pool.
LABELLED, POOL = 6000, 3000
#: Buckets of the text view's word presence, and of the hashed lang and source of the metadata view.
WORDS, LANGS, SOURCES = 1 << 18, 32, 256

_CLASS = np.zeros(256, np.int64)  # 0 letters, 1 upper case, 2 digits, 3 marks, 4 white space, 5 beyond ASCII
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 5
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[[*range(33), 127]] = 4
LAYOUT = 10
_SPACE, _OUTSIDE = _CLASS == 4, (_CLASS == 3) | (_CLASS == 4)


def views(texts: pa.Array, langs: list, sources: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word buckets of all rows, their offsets, metadata rows), some MB at a time.

    The text view is the set of a text's word buckets: of runs of other than white space, and of letters and digits. The metadata view never sees words: lang, source, and layout (sizes,
    shares of upper case, digits, marks and non-ASCII, mean word length, share of distinct words).
    """
    for first, end, data, offsets in string_slices(texts):
        words, at, _ = hashed_words(data, offsets, _SPACE)
        inner, inner_at, _ = hashed_words(data, offsets, _OUTSIDE)
        n = end - first
        row = np.concatenate([np.repeat(np.arange(n), np.diff(x)) for x in (at, inner_at)])
        buckets = np.concatenate([words, mix64(inner + np.uint64(1))]) & np.uint64(WORDS - 1)
        seen = np.unique(row * WORDS + buckets.astype(np.int64))
        places = np.searchsorted(seen, np.arange(n + 1) * WORDS)
        size = np.maximum(np.diff(offsets), 1)
        kinds = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6) / size[:, None]
        lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=n)
        count = np.maximum(np.diff(at), 1)
        meta = np.zeros((n, LAYOUT + LANGS + SOURCES), np.float32)
        meta[:, :LAYOUT] = np.stack(
            [np.log1p(np.diff(offsets)), np.log1p(np.diff(at)), np.log1p(lines), *kinds[:, [1, 2, 3, 4, 5]].T, np.log1p((1 - kinds[:, 4]) * size / count), np.diff(places) / count], 1
        )
        for i in range(n):
            meta[i, LAYOUT + crc32((langs[first + i] or "").encode()) % LANGS] = 1
            meta[i, LAYOUT + LANGS + crc32((sources[first + i] or "").encode()) % SOURCES] = 1
        yield first, seen % WORDS, places, meta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes count alike."""
    n = np.maximum(np.bincount(y, minlength=2), 1)
    return (0.5 / n)[y]


@dataclass
class Sets:
    """Rows of a sparse 0/1 matrix."""

    columns: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sets:
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.columns], dtype=np.float64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(g, np.diff(self.offsets)), minlength=WORDS)

    def rows(self, chosen: np.ndarray) -> Sets:
        return Sets.of([self.columns[self.offsets[i] : self.offsets[i + 1]] for i in chosen])


class TextView:
    """Logistic regression on the presence of telling words, fitted by adaptive gradient steps.

    A word tells if its shares in the two classes differ by ``least`` standard errors; most words of a large vocabulary
    only add noise.
    """

    def __init__(self, x: Sets, y: np.ndarray, steps: int = 200, decay: float = 1e-6, least: float = 4.0):
        self.w, self.bias = np.zeros(WORDS), 0.0
        many = np.maximum(np.bincount(y, minlength=2), 1)
        good, every = x.back(y.astype(float)), x.back(np.ones(len(y)))
        share = every / len(y)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / many[0] + 1 / many[1]))
        tells = (np.abs(good / many[1] - (every - good) / many[0]) >= least * error) & (every >= 8)
        x = Sets.of([r[tells[r]] for r in (x.columns[a:b] for a, b in zip(x.offsets[:-1], x.offsets[1:], strict=True))])
        weight, seen, seen_bias = _balanced(y), np.full(WORDS, 1e-8), 1e-8
        for _ in range(steps):
            g = weight * (_sigmoid(x.dot(self.w) + self.bias) - y)
            gw, gb = x.back(g) + decay * self.w, g.sum()
            seen += gw * gw
            seen_bias += gb * gb
            self.w -= 0.25 * gw / np.sqrt(seen)
            self.bias -= 0.25 * gb / np.sqrt(seen_bias)
        self.w = self.w.astype(np.float32)

    def logit(self, x: Sets) -> np.ndarray:
        return x.dot(self.w) + self.bias


class MetaView:
    """Logistic regression on standardised metadata and squares of its layout part, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 15, decay: float = 1e-3):
        self.mean, self.scale = x[:, :LAYOUT].mean(0), x[:, :LAYOUT].std(0) + 1e-6
        z, weight = self._spread(x), _balanced(y)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = _sigmoid(z @ self.w)
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + decay * np.eye(len(self.w))
            self.w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + decay * self.w)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        layout = np.clip((x[:, :LAYOUT] - self.mean) / self.scale, -6, 6)
        return np.concatenate([layout, layout**2, x[:, LAYOUT:], np.ones((len(x), 1))], 1).astype(np.float64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._spread(x) @ self.w


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> np.ndarray:
    z, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + decay * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + decay * w)
    return w


@dataclass
class CoTrained:
    """Both views, their calibrations (Platt) and the weights by which calibrated views are combined."""

    text: TextView
    meta: MetaView
    platt: list[np.ndarray] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0]))
    exchanged: int = 0

    def logits(self, x: Sets, m: np.ndarray) -> list[np.ndarray]:
        return [np.clip(v, -8, 8) for v in (self.text.logit(x), self.meta.logit(m))]

    def views(self, x: Sets, m: np.ndarray) -> np.ndarray:
        return np.stack([a * v + b for (a, b), v in zip(self.platt, self.logits(x, m), strict=True)], 1)

    def score(self, x: Sets, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.views(x, m) @ self.mix[:2] + self.mix[2])


def cotrain(x: Sets, m: np.ndarray, y: np.ndarray, pool_x: Sets, pool_m: np.ndarray, rounds: int = 4, each: int = 100) -> CoTrained:
    """Fits the two views in ``rounds``: each labels the pool's rows of which it is surest, for the other to learn from.

    In a round a view hands on at most ``each`` rows of which it is at least 95 % sure, in the classes' proportions. Every
    fourth labelled row is kept back for the calibration and the combination of the views.
    """
    back = np.arange(len(y)) % 4 == 3
    base = np.flatnonzero(~back)
    share = y[base].mean()
    extra: list[dict[int, int]] = [{}, {}]  # what the text and the metadata view learn from the other

    def fit() -> tuple[TextView, MetaView]:
        a, b = (sorted(e) for e in extra)
        text = TextView(Sets.of([*(x.columns[x.offsets[i] : x.offsets[i + 1]] for i in base), *(pool_x.columns[pool_x.offsets[i] : pool_x.offsets[i + 1]] for i in a)]), np.concatenate([y[base], [extra[0][i] for i in a]]).astype(int))
        meta = MetaView(np.concatenate([m[base], pool_m[b]]), np.concatenate([y[base], [extra[1][i] for i in b]]).astype(int))
        return text, meta

    text, meta = fit()
    for _ in range(rounds):
        if not len(pool_m):
            break
        for source, p in ((0, _sigmoid(text.logit(pool_x))), (1, _sigmoid(meta.logit(pool_m)))):
            to = extra[1 - source]
            for label, sure, many in ((1, p, round(each * share)), (0, 1 - p, round(each * (1 - share)))):
                order = [i for i in np.argsort(-sure, kind="stable") if i not in to and sure[i] >= 0.95]
                to.update((int(i), label) for i in order[:many])
        text, meta = fit()
    out = CoTrained(text, meta, exchanged=len(extra[0]) + len(extra[1]))
    held_x, held_m, held_y = x.rows(np.flatnonzero(back)), m[back], y[back]
    if len(set(held_y)) < 2:
        out.platt = [np.array([1.0, 0.0])] * 2
        return out
    out.platt = [_logistic(v[:, None], held_y, 1e-2) for v in out.logits(held_x, held_m)]
    out.mix = _logistic(out.views(held_x, held_m), held_y, 1e-2)
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """Fits on at most ``labelled`` labelled documents and a pool of at most ``pool`` others, both with the lowest id hashes.

    A document is good if its quality is 1 and no row calls it toxic; of several rows the lowest quality holds. Without
    labelled documents of both kinds nothing is learnt (None). The chosen ids are bounded, so they are broadcast; only
    features of the chosen documents reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("y"))
    spread = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    taught = known.join(ids, "doc_id", "left_semi").orderBy(spread).limit(labelled)
    others = ids.join(known, "doc_id", "left_anti").orderBy(spread).limit(pool).withColumn("y", F.lit(-1))
    chosen = taught.unionByName(others)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, seen, at, meta in views(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                n = len(meta)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n) for i in (0, 1)), pa.array([seen[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())],
                    names=["doc_id", "y", "words", "meta"],
                )

    rows = _rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", "lang", "source")
    got = rows.mapInArrow(features, "doc_id long, y int, words binary, meta binary").collect()
    got = sorted({r["doc_id"]: r for r in got}.values(), key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    teach, rest = [r for r in got if r["y"] >= 0], [r for r in got if r["y"] < 0]
    if len({r["y"] for r in teach}) < 2:
        return None

    def matrices(rows: list) -> tuple[Sets, np.ndarray]:
        width = LAYOUT + LANGS + SOURCES
        return Sets.of([np.frombuffer(r["words"], "<i4") for r in rows]), np.array([np.frombuffer(r["meta"], np.float32) for r in rows]).reshape(len(rows), width)

    return cotrain(*matrices(teach), np.array([r["y"] for r in teach]), *matrices(rest))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")])


SCORES = "doc_id long, score double, text_score double, meta_score double, kept boolean"


def score(docs: DataFrame, model: CoTrained | None, least: float = 0.5) -> DataFrame:
    """Scores every whole document: calibrated scores (0 to 1) of both views, their combination, and kept (>= ``least``).

    Null text is empty; null lang and source are a value of their own; a table without them is taken as null. With nothing
    learnt every score is 0.5 and every row is kept. One scan, no shuffle; rows that repeat score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, seen, at, meta in views(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = len(meta)
                if model:
                    x = Sets(seen, at)
                    both, total = _sigmoid(model.views(x, meta)), model.score(x, meta)
                else:
                    both, total = np.full((n, 2), 0.5), np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(total), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(total >= least)], names=[x.split()[0] for x in SCORES.split(", ")])

    return _rows(docs).mapInArrow(run, SCORES)
