"""Faces, persons, search over them, and vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import like_pattern
from ..work import written


def good_faces(faces: DataFrame) -> DataFrame:
    """Sure enough and wide enough."""
    return faces.where((F.col("score") >= 0.5) & (F.col("bbox_right") - F.col("bbox_left") >= 15))


def persons_of_photos(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    return faces.join(assignments, faces["id"] == assignments["face_id"]).groupBy("media_full_path").agg(F.sort_array(F.collect_set("person_id")).alias("person_ids"))


def person_summary(persons: DataFrame, assignments: DataFrame, faces: DataFrame) -> DataFrame:
    """Every person with their good faces' count, photos and best face; nobody is left out for having none."""
    good = good_faces(faces).join(assignments, F.col("id") == F.col("face_id")).select("person_id", "id", "score", "media_full_path")
    own = good.groupBy("person_id").agg(F.count("*").alias("n_faces"), F.count_distinct("media_full_path").alias("n_photos"), F.max_by("id", F.struct("score", (-F.col("id")).alias("i"))).alias("cover_face"))
    return persons.join(own, persons["id"] == own["person_id"], "left").select("id", "name", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), F.coalesce("n_photos", F.lit(0)).alias("n_photos"), "cover_face")


def unlabelled(faces: DataFrame, assignments: DataFrame, ignored: DataFrame) -> DataFrame:
    out = good_faces(faces)
    for done in (assignments, ignored):
        out = out.join(done.select(F.col("face_id").alias("id")), "id", "left_anti")
    return out


def suggestion_candidates(faces: DataFrame, assignments: DataFrame, ignored: DataFrame, cannot_links: DataFrame, person_id: int) -> DataFrame:
    return unlabelled(faces, assignments, ignored).join(cannot_links.where(F.col("person_id") == person_id).select(F.col("face_id").alias("id")), "id", "left_anti")


def photos_with(photo_names: DataFrame, tokens: list[str], every: bool) -> DataFrame:
    """Photos (media_full_path, name) where each token, or any, is part of a person's name.

    Relational division by counting distinct matched tokens. No token at all: every photo if all are asked for, else none.
    """
    if not tokens:
        return photo_names.select("media_full_path").distinct() if every else photo_names.select("media_full_path").limit(0)
    asked = F.explode(F.array(*[F.lit(t.lower()) for t in tokens]))
    hits = photo_names.withColumn("token", asked).where(F.contains(F.lower("name"), F.col("token"))).groupBy("media_full_path").agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") >= (len(set(t.lower() for t in tokens)) if every else 1)).select("media_full_path")


def text_search(texts: DataFrame, tokens: list[str], every: bool, column: str = "text") -> DataFrame:
    """Rows whose text has each token, or any (% and _ are wildcards); without tokens none."""
    if not tokens:
        return texts.limit(0)
    test: Column | None = None
    for t in tokens:
        one = like_pattern(column, t)
        test = one if test is None else (test & one if every else test | one)
    return texts.where(test)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double, 0 for unequal lengths."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both).otherwise(0.0)


def unit(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9)))


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean of each key's vectors, brought to length 1; one aggregation, no vectors gathered."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).select(key, unit("v").alias("centroid"))


#: Vectors that are sent to all tasks at most; more are joined in blocks.
CENTROID_BLOCK = 4096
#: Numbers of a product of faces and vectors that a task holds at a time.
AT_ONCE = 1 << 20


def best_similarity(faces: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each face with its largest similarity to one of ``vectors`` (vector).

    Vectors of another length than the face's have similarity 0. The vectors are written first, as counting and packing them would cluster
    twice, and dealt to blocks of a bounded number, each of which is sent to all tasks, which multiply their faces with it.
    """
    vectors = written(vectors.where("vector is not null"), "vectors")
    n = vectors.count()
    blocks = max(1, -(-n // CENTROID_BLOCK))
    faces = faces if blocks == 1 else written(faces, "faces")
    schema = StructType([*faces.schema.fields, StructField("similarity", DoubleType())])
    out = None
    for i in range(blocks):
        part = vectors if blocks == 1 else vectors.where(F.pmod(F.xxhash64("vector"), F.lit(blocks)) == i)
        by_size: dict[int, list] = {}
        for v in part.toArrow().column("vector").to_pylist():
            by_size.setdefault(len(v), []).append(v)
        got = faces.mapInArrow(_nearest({size: np.array(vs, np.float64).reshape(-1, size) for size, vs in by_size.items()}, faces.columns.index("embedding")), schema)
        out = got if out is None else out.unionByName(got)
    if blocks == 1:
        return out
    return out.groupBy(*[c for c in faces.columns if c != "embedding"]).agg(F.max("similarity").alias("similarity"), F.first("embedding").alias("embedding"))


def _nearest(by_size: dict[int, np.ndarray], at: int):
    """Adds to batches the largest product of the vector in column ``at`` with one of the given ones; null without any that can be compared."""
    n = sum(len(v) for v in by_size.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = np.array(pc.list_value_length(column).fill_null(-1))
            best, known = np.zeros(len(sizes)), np.full(len(sizes), n > 0)
            for size, own in by_size.items():
                rows = np.flatnonzero(sizes == size)
                step = max(1, AT_ONCE // max(len(own), size))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    flat = column.take(pa.array(part)).flatten()
                    missing = np.array(flat.is_null()).reshape(len(part), size).any(1)
                    found = (np.array(flat.cast(pa.float64()).fill_null(0.0)).reshape(len(part), size) @ own.T).max(1)
                    if len(own) < n:  # others have another length
                        found = np.where(missing, 0.0, np.maximum(found, 0.0))
                    else:
                        known[part[missing]] = False
                    best[part] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=~known)], names=[*batch.schema.names, "similarity"])

    return run


def sub_centroids(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Sub-centroids of each person (person_id, ord, embedding) by greedy clustering in the order of ``ord``.

    A vector joins the nearest centroid (the first of equal ones) if their similarity is above the threshold; the centroid, times
    the number of its vectors, plus the vector, brought to length 1, is the new one. Else the vector founds one. Sequential by definition: persons are dealt to tasks and sorted, and a task streams its rows, holding
    one person's centroids only, so a person of any number of faces is never gathered. Rows without a vector are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        person, means, counts = None, np.zeros((0, 0)), []  # more rows of means than clusters, as they grow by doubling

        def done() -> pd.DataFrame:
            return pd.DataFrame({"person_id": [person] * len(counts), "cluster": list(range(len(counts))), "n": counts, "centroid": means[: len(counts)].tolist()})

        for batch in batches:
            for p, v in zip(batch.person_id, batch.embedding, strict=True):
                if p != person and counts:
                    yield done()
                    means, counts = np.zeros((0, 0)), []
                person, v = p, np.asarray(v, np.float64)
                near = means[: len(counts)] @ v if counts else None
                k = int(np.argmax(near)) if counts else -1
                if counts and near[k] > threshold:
                    moved = means[k] * counts[k] + v
                    means[k] = moved / max(float(np.linalg.norm(moved)), 1e-9)
                    counts[k] += 1
                else:
                    if len(counts) == len(means):
                        means = np.concatenate([means, np.zeros_like(means)]) if counts else np.zeros((4, len(v)))
                    means[len(counts)] = v
                    counts.append(1)
        if counts:
            yield done()

    dealt = rows.where("embedding is not null").select("person_id", "ord", "embedding").repartition("person_id").sortWithinPartitions("person_id", "ord")
    return dealt.mapInPandas(run, "person_id long, cluster long, n long, centroid array<double>")


def reference_vectors(faces: DataFrame, assignments: DataFrame, anchors: DataFrame, person_id: int) -> DataFrame:
    """Sub-centroids (vector) of one person: of their good faces by id, then of their anchors by id."""
    own = good_faces(faces).join(assignments.where(F.col("person_id") == person_id), F.col("id") == F.col("face_id"), "left_semi").select(F.struct(F.lit(0).alias("k"), "id").alias("ord"), "embedding")
    own = own.unionByName(anchors.where(F.col("person_id") == person_id).select(F.struct(F.lit(1).alias("k"), "id").alias("ord"), "embedding"))
    return sub_centroids(own.withColumn("person_id", F.lit(person_id).cast("long"))).select(F.col("centroid").alias("vector"))


def grid_clusters(geo: DataFrame, zoom: int) -> DataFrame:
    """Geotagged rows by map cell of 180 / 2^zoom degrees: mean place, count and paths' extremes."""
    cell = 180.0 / 2 ** min(max(zoom, 1), 20)
    rows = geo.where("has_geo").select("path", "lat", "lon", F.floor(F.col("lon") / cell).alias("gx"), F.floor(F.col("lat") / cell).alias("gy"))
    return rows.groupBy("gx", "gy").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("n"), F.min("path").alias("first_path"))


def bounding_box(geo: DataFrame) -> DataFrame:
    box = geo.where("has_geo").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    return box.withColumn("one_point", (F.col("south") == F.col("north")) & (F.col("west") == F.col("east")))
