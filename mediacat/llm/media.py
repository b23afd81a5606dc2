"""Copies of images, cropped or edited ones too, by local descriptors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import linked_classes, thinned
from .shared import discard, mix64, once, written

#: Radius of a descriptor's patch, number of its tests, and the steps to which orientations are rounded.
RADIUS, TESTS, TURNS = 11, 256, 32
#: Scales between which a copy may be resized: each is 1/sqrt(2) of the one before.
SCALES = 4
#: Hamming tables, and the bits of a descriptor, drawn at random, that a table compares. Two descriptors that differ in d bits
#: meet in a table with a chance of about (1 - d / TESTS) ** TABLE_BITS; copies have many pairs of descriptors that may meet.
TABLES, TABLE_BITS = 12, 64
#: Bits in which matched descriptors of two candidate images may differ, and matches that must agree on one movement.
MOST_BITS, LEAST_MATCHES = 24, 5

_random = np.random.default_rng(256)
_DRAWN = np.stack([np.sort(np.random.default_rng(1000 + t).choice(TESTS, TABLE_BITS, replace=False)) for t in range(TABLES)])


def _pattern() -> np.ndarray:
    """Offsets (turn, test, end, y/x) of the test pairs, whose ends lie at least half a radius apart, for each turn."""
    ends = []
    while len(ends) < TESTS:
        a, b = _random.normal(0, RADIUS / 2.2, (2, 2))
        if max(np.hypot(*a), np.hypot(*b)) <= RADIUS - 1 and np.hypot(*(a - b)) >= RADIUS / 2:
            ends.append((a, b))
    base = np.array(ends)
    turned = [base @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) for t in 2 * np.pi * np.arange(TURNS) / TURNS]
    return np.rint(turned).astype(np.int64)


_PATTERN = _pattern()
_Y, _X = (g.ravel() for g in np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1])
_DISC = _Y**2 + _X**2 <= RADIUS**2


def _shift_sum(a: np.ndarray, r: int, how) -> np.ndarray:
    """Combines (2r+1) x (2r+1) neighbourhoods of a stack of images; edges are repeated."""
    for axis in (1, 2):
        width = [(0, 0)] * 3
        width[axis] = (r, r)
        p = np.pad(a, width, mode="edge")
        n = a.shape[axis]
        parts = [p.take(range(i, i + n), axis) for i in range(2 * r + 1)]
        a = parts[0]
        for x in parts[1:]:
            a = how(a, x)
    return a


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the Harris corners of a stack of smoothed images, far enough from edges for a patch."""
    gy, gx = np.gradient(images, axis=(1, 2))
    yy, xx, xy = (_shift_sum(a, 1, np.add) for a in (gy * gy, gx * gx, gy * gx))
    strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    top = strength.max((1, 2), keepdims=True)
    peak = (strength == _shift_sum(strength, 2, np.maximum)) & (strength > 0.01 * top) & (strength > 1.0)
    peak[:, :RADIUS] = peak[:, -RADIUS:] = peak[:, :, :RADIUS] = peak[:, :, -RADIUS:] = False
    return np.nonzero(peak)


def _resized(images: np.ndarray, h: int, w: int) -> np.ndarray:
    def spots(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    a, b, f = spots(images.shape[1], h)
    images = images[:, a] * (1 - f)[:, None] + images[:, b] * f[:, None]
    a, b, f = spots(images.shape[2], w)
    return images[:, :, a] * (1 - f) + images[:, :, b] * f


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descriptors of a stack of gray images of one size: image number; y, x, scale, turn; 32 bytes.

    Corners are taken at each scale. A patch's intensity centroid gives its orientation, by which the pattern of binary
    tests is turned. Tests compare smoothed gray values, so brightness and contrast do not matter.
    """
    n, h, w = images.shape
    base = images.astype(np.float32)
    parts = []
    for s in range(SCALES):
        scale = 2 ** (s / 2)
        hs, ws = round(h / scale), round(w / scale)
        if min(hs, ws) <= 2 * RADIUS:
            break
        level = base if s == 0 else _resized(_shift_sum(base, int(scale // 2), np.add) / (2 * int(scale // 2) + 1) ** 2, hs, ws)
        level = _shift_sum(level, 1, np.add) / 9
        i, y, x = corners(level)
        if not len(i):
            continue
        patch = level[i[:, None], y[:, None] + _Y[_DISC], x[:, None] + _X[_DISC]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ _Y[_DISC], patch @ _X[_DISC])
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        spots = _PATTERN[turn]
        value = level[i[:, None, None], np.clip(y[:, None, None] + spots[..., 0], 0, hs - 1), np.clip(x[:, None, None] + spots[..., 1], 0, ws - 1)]
        bits = np.packbits(value[..., 0] < value[..., 1] - 0.5, axis=1)
        where = np.stack([(y + 0.5) * h / hs, (x + 0.5) * w / ws, np.full(len(i), scale), turn], 1).astype(np.float32)
        parts.append((i, where, bits))
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8)
    i, where, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], where[order], bits[order]


def block_keys(bits: np.ndarray) -> np.ndarray:
    """Distinct keys of the descriptors' drawn bits in each table."""
    drawn = np.unpackbits(bits, axis=1)[:, _DRAWN]
    words = np.packbits(drawn, axis=2).view(np.uint64)[:, :, 0]
    return np.unique(mix64(mix64(words) + np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def consistent(wa: np.ndarray, ba: np.ndarray, wb: np.ndarray, bb: np.ndarray) -> int:
    """Largest number of one-to-one matches that agree on one movement, turn and scaling of image a to image b.

    Descriptors are matched to their nearest, both ways. Each match proposes the movement that its scales, turns and places
    give; the others that it carries to within a few pixels, and that agree in scale and turn, vote for it.
    """
    if not len(ba) or not len(bb):
        return 0
    apart = np.bitwise_count(ba.view(np.uint64)[:, None] ^ bb.view(np.uint64)[None]).sum(2, dtype=np.int64)
    near = apart.argmin(1)
    back = apart.argmin(0)
    mine = np.flatnonzero((apart[np.arange(len(near)), near] <= MOST_BITS) & (back[near] == np.arange(len(near))))
    if len(mine) < LEAST_MATCHES:
        return len(mine)
    a, b = wa[mine].astype(np.float64), wb[near[mine]].astype(np.float64)
    scale = b[:, 2] / a[:, 2]
    turn = (b[:, 3] - a[:, 3]) * 2 * np.pi / TURNS
    best = 0
    for s, t, ya, xa, yb, xb in zip(scale, turn, a[:, 0], a[:, 1], b[:, 0], b[:, 1], strict=True):
        dy, dx = s * (a[:, 0] - ya), s * (a[:, 1] - xa)
        off = np.hypot(yb + dx * np.sin(t) + dy * np.cos(t) - b[:, 0], xb + dx * np.cos(t) - dy * np.sin(t) - b[:, 1])
        agree = (off <= 3 * np.maximum(1, b[:, 2])) & (np.abs(np.log2(scale / s)) < 0.6) & (np.abs((turn - t + np.pi) % (2 * np.pi) - np.pi) < 0.4)
        best = max(best, int(agree.sum()))
    return best


FEATURES = "image_id long, d1 long, d2 long, n_corners long, places binary, bits binary, keys array<long>"


def features(images: DataFrame) -> DataFrame:
    """Descriptors of all images (image_id, width, height, pixels: gray bytes by row); broken or null images have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                ids, widths, heights, pixels = (c.to_pylist() for c in part.columns)
                rows: list = [None] * len(ids)
                sizes: dict = {}
                for i, (w, h, data) in enumerate(zip(widths, heights, pixels, strict=True)):
                    if data is None or not w or not h or len(data) != w * h:
                        rows[i] = (ids[i], None, None, 0, b"", b"", [])
                    else:
                        sizes.setdefault((h, w), []).append(i)
                for (h, w), at in sizes.items():
                    number, where, bits = describe(np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in at]))
                    ends = np.searchsorted(number, np.arange(len(at) + 1))
                    for k, i in enumerate(at):
                        a, b = ends[k], ends[k + 1]
                        digest = hashlib.blake2b(b"%d,%d," % (w, h) + pixels[i], digest_size=16).digest()
                        d = np.frombuffer(digest, np.int64)
                        rows[i] = (ids[i], int(d[0]), int(d[1]), int(b - a), where[a:b].tobytes(), bits[a:b].tobytes(), block_keys(bits[a:b]).view(np.int64).tolist())
                kinds = [*[pa.int64()] * 4, pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInArrow(run, FEATURES)


def copies(images: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """One row per image: image_id, n_corners, component_id and kept (the smallest id of its component).

    Images of equal size and pixels are one from the start. Others are candidates if a descriptor of one and one of the other
    agree in all drawn bits of a table (the Hamming tables), and linked if ``least`` descriptor matches agree on one movement
    (see :func:`consistent`). Pairs are found by :func:`linking.linked_classes`, never all of a bucket. Null ids are kept
    and linked with nothing, as are null or broken images; rows that share an id are taken for one. No rows give no rows.
    """
    base = written(features(images), "features")
    full = base.where("d1 is not null and image_id is not null")
    groups = written(full.groupBy("d1", "d2").agg(F.min("image_id").alias("low")), "images")
    low = groups.select(F.col("low").alias("image_id")).distinct()
    own = full.dropDuplicates(["image_id"]).join(low, "image_id", "left_semi")

    def shapes_of(ids: DataFrame) -> DataFrame:
        return thinned(full.select(F.col("image_id").alias("id"), "places", "bits"), ids, "id").join(ids, "id").dropDuplicates(["id"])

    described, tables = once(shapes_of, "shapes"), []
    shape = lambda places, bits: (np.frombuffer(places, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, TESTS // 8))

    def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
        return consistent(*a, *b) >= least

    def verify(pairs: DataFrame) -> DataFrame:
        shapes = described(tables[-1])
        for x in "ab":
            pairs = pairs.join(shapes.select(F.col("id").alias(x), F.col("places").alias(f"w{x}"), F.col("bits").alias(f"b{x}")), x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [linked(shape(wa, ba), shape(wb, bb)) for wa, ba, wb, bb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

        return pairs.select("a", "b", "wa", "ba", "wb", "bb").mapInArrow(run, "a long, b long")

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Corners of two sides: all images that have enough of them may be copies."""
        return np.where(np.minimum(a[0], b[0]) < least, np.inf, 0.0)

    items = written(own.select(F.col("image_id").alias("id"), "n_corners", "keys"), "items")
    many = items.agg(F.sum(F.size("keys"))).first()[0] or 0
    # images of open buckets are compared inside tasks, where a group's pairs are no rows
    of_cells = lambda ids: shapes_of(ids).select("id", F.struct("places", "bits").alias("line"))
    shapes_in = lambda lines: [shape(x["places"], x["bits"]) for x in lines.to_pylist()]
    classes, _ = linked_classes([(items.select("keys", "id"), many)], items.drop("keys"), near, verify, "media", texts=(of_cells, linked), prepared=shapes_in, among=tables.append)
    discard(items)
    placed = groups.join(classes.withColumnRenamed("id", "low"), "low", "left").select("d1", "d2", F.coalesce("component", "low").alias("component_id"))
    out = base.join(placed, ["d1", "d2"], "left")
    component = F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id"))
    return out.select("image_id", "n_corners", component.alias("component_id"), F.coalesce(F.col("image_id") == component, F.lit(True)).alias("kept"))


#: Pixels of a side of the cell that shows one value.
CELL = 6


def rendered(vectors: DataFrame, key: str = "vec_id", values: str = "embedding", cell: int = CELL) -> DataFrame:
    """Vectors as gray images: the values, in rows of the square root of their number, as cells of ``cell`` pixels.

    A vector whose length is no square, or that is null or holds a null or NaN, gives a null image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, images = [], []
            for v in batch.column(1).to_pylist():
                side = int(round(len(v) ** 0.5)) if v else 0
                if not side or side * side != len(v) or any(x is None or x != x for x in v):
                    sides.append(None)
                    images.append(None)
                    continue
                gray = np.clip(128 + 400 * np.array(v, np.float64), 0, 255).astype(np.uint8).reshape(side, side)
                sides.append(side * cell)
                images.append(np.kron(gray, np.ones((cell, cell), np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sides, pa.int32()), pa.array(sides, pa.int32()), pa.array(images, pa.binary())], names=["image_id", "width", "height", "pixels"])

    return vectors.select(F.col(key).cast("long").alias("image_id"), F.col(values).cast("array<double>")).mapInArrow(run, "image_id long, width int, height int, pixels binary")
