"""Numbers about images: crops, decode factors, sharpness, capture times and places read from files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop_span(low: str, high: str, size: int, margin: float) -> Column:
    """Struct (start, end) of a box side widened by ``margin`` of its length, cut to the image; null if nothing is left."""
    length = F.col(high) - F.col(low)
    start = F.least(F.greatest((F.col(low) - length * F.lit(margin)).cast("int"), F.lit(0)), F.lit(size))
    end = F.least(F.greatest((F.col(high) + length * F.lit(margin)).cast("int"), start), F.lit(size))
    return F.when((length > 0) & (end > start), F.struct(start.alias("start"), end.alias("end")))


def sample_factor(width: str, height: str, most: int) -> Column:
    """Smallest power of two that brings both sides, in whole pixels, to ``most`` or less; null without a size."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    fits = F.filter(powers, lambda s: (F.floor(F.col(width) / s) <= most) & (F.floor(F.col(height) / s) <= most))
    return F.when((F.col(width) > 0) & (F.col(height) > 0), F.element_at(fits, 1))


def capture_ms(text: str) -> Column:
    """Epoch ms of ``2015-07-26T14:55:23`` or ``2018:09:05 15:09:05``, any separator; hours run from 1 to 24. Null if malformed."""
    part = [F.regexp_extract(text, r"^(\d{4})(.)(\d{2})\2(\d{2})[T ](\d{2}):(\d{2}):(\d{2})", i) for i in (1, 3, 4, 5, 6, 7)]
    year, month, day, hour, minute, second = (F.nullif(p, F.lit("")).cast("int") for p in part)
    return F.unix_millis(F.try_make_timestamp(year, month, day, hour % 24, minute, second.cast("decimal(8,6)")))


def is_place(lat: str, lon: str) -> Column:
    """Whether coordinates say anything: (0, 0) and nulls do not."""
    return F.coalesce((F.col(lat) != 0) | (F.col(lon) != 0), F.lit(False)) & F.col(lat).isNotNull() & F.col(lon).isNotNull()


def sharpness(images: DataFrame, key: str = "id") -> DataFrame:
    """Variance of the Laplacian of gray images (key, width, gray: array of ints by row); 0 for under three pixels a side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, gray in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not gray or not width or width < 3 or len(gray) % width or len(gray) // width < 3:
                    out.append(0.0)
                    continue
                g = np.array(gray, np.int64).reshape(-1, width)
                edge = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
                out.append(float((edge.astype(np.float64) ** 2).mean() - edge.mean() ** 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "sharpness"])

    return images.select(F.col(key).cast("long").alias("id"), F.col("width").cast("int"), F.col("gray").cast("array<int>")).mapInArrow(run, "id long, sharpness double")


def vector_bytes(vector: str) -> Column:
    """A float vector as its little-endian 32-bit values, four bytes each."""

    @F.pandas_udf("binary")
    def pack(vectors):
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return pack(vector)


def vector_floats(data: str) -> Column:
    """What :func:`vector_bytes` packed; a rest of less than four bytes is left out."""

    @F.pandas_udf("array<float>")
    def unpack(values):
        return values.map(lambda b: np.frombuffer(b, "<f4", len(b) // 4), na_action="ignore")

    return unpack(data)


def similarity_matrix(src: str, dst: str) -> Column:
    """The turn, scale and shift that maps points to others with the least sum of squares: (a, b, tx, ty) of the matrix
    [a, -b, tx; b, a, ty]. Points are arrays x1, y1, x2, y2, ... of one length, five points for a face.

    Null if a point is missing, if there are fewer than two points, or if all points to be mapped are one.
    """
    n = F.size(src) / 2
    at = F.sequence(F.lit(1), F.size(src), F.lit(2))

    def total(f) -> Column:
        return F.aggregate(at, F.lit(0.0), lambda s, i: s + f(i))

    def x(points: str):
        return lambda i: F.get(points, i - 1).cast("double")

    def y(points: str):
        return lambda i: F.get(points, i).cast("double")

    sx, sy, dx, dy = (total(f) / n for f in (x(src), y(src), x(dst), y(dst)))
    means = F.struct(sx.alias("sx"), sy.alias("sy"), dx.alias("dx"), dy.alias("dy"))
    whole = (F.size(src) == F.size(dst)) & (F.size(src) >= 4) & (F.size(src) % 2 == 0)

    def fitted(m: Column) -> Column:
        u, v = (lambda i: x(src)(i) - m["sx"]), (lambda i: y(src)(i) - m["sy"])
        p, q = (lambda i: x(dst)(i) - m["dx"]), (lambda i: y(dst)(i) - m["dy"])
        sums = F.struct(
            total(lambda i: u(i) * p(i) + v(i) * q(i)).alias("along"), total(lambda i: u(i) * q(i) - v(i) * p(i)).alias("across"),
            total(lambda i: u(i) * u(i) + v(i) * v(i)).alias("spread"), m.alias("m"),
        )
        return F.get(F.transform(F.array(sums), lambda s: F.when(s["spread"] > 0, _placed(s["along"] / s["spread"], s["across"] / s["spread"], s["m"]))), 0)

    return F.when(whole, F.get(F.transform(F.array(means), fitted), 0))


def _placed(a: Column, b: Column, m: Column) -> Column:
    tx, ty = m["dx"] - (a * m["sx"] - b * m["sy"]), m["dy"] - (b * m["sx"] + a * m["sy"])
    return F.struct(a.alias("a"), b.alias("b"), tx.alias("tx"), ty.alias("ty"))
