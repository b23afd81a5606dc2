"""Suggestions of faces for all persons at once: block matrix products that an upper bound skips, the best of each person kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import written
from .people import good_faces, sub_centroids, unlabelled

#: Reference vectors that are sent to all tasks at a time: with 64 numbers each, 2 MB.
BLOCK = 4096
#: Numbers of a face's product with the persons' means that a task holds at a time.
AT_ONCE = 1 << 20


def person_vectors(faces: DataFrame, assignments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sub-centroids (person_id, cluster, vector) of every person: of their good faces by id, then of their anchors by id."""
    own = good_faces(faces).join(assignments.select(F.col("face_id").alias("id"), "person_id"), "id")
    own = own.select("person_id", F.struct(F.lit(0).alias("k"), "id").alias("ord"), "embedding")
    own = own.unionByName(anchors.select("person_id", F.struct(F.lit(1).alias("k"), "id").alias("ord"), "embedding"))
    return sub_centroids(own.where("embedding is not null")).select("person_id", "cluster", F.col("centroid").alias("vector"))


class Persons:
    """The reference vectors of some persons, by person, with each person's mean vector and the largest distance from it.

    A face q is at most q·mean + |q| * distance like a person, whatever the person's vectors.
    """

    def __init__(self, person: np.ndarray, vectors: np.ndarray):
        order = np.argsort(person, kind="stable")
        self.vectors = vectors[order]
        self.ids, self.first = np.unique(person[order], return_index=True)
        self.ends = np.append(self.first[1:], len(person))
        size = (self.ends - self.first)[:, None]
        self.means = np.add.reduceat(self.vectors, self.first) / size
        away = np.linalg.norm(self.vectors - np.repeat(self.means, size[:, 0], axis=0), axis=1)
        self.reach = np.maximum.reduceat(away, self.first)

    def best(self, faces: np.ndarray, ids: np.ndarray, never: list, least: np.ndarray, digits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of a person, face ids, rounded similarities) of the pairs that reach ``least``, one value a person."""
        bound = faces @ self.means.T + np.linalg.norm(faces, axis=1)[:, None] * self.reach[None, :]
        near = bound >= least[None, :] - 0.5 * 10.0**-digits - 1e-9
        for p in np.flatnonzero(near.any(0)):
            rows = np.flatnonzero(near[:, p])
            own = int(self.ids[p])
            rows = rows[[own not in never[r] for r in rows]]
            if len(rows):
                found = np.round((faces[rows] @ self.vectors[self.first[p] : self.ends[p]].T).max(1), digits)
                good = found >= least[p]
                if good.any():
                    yield p, ids[rows[good]], found[good]


def suggestions(faces: DataFrame, assignments: DataFrame, ignored: DataFrame, cannot_links: DataFrame, anchors: DataFrame, least: float = 0.3, most: int = 300, digits: int = 5, block: int = BLOCK) -> DataFrame:
    """(person_id, id, similarity, rank): each person's ``most`` most similar unlabelled good faces that are not excluded for the person.

    Similarity is the largest inner product with one of the person's vectors, rounded; equal ones go by ascending id. The vectors are written
    once and sent to all tasks in blocks of a bounded number, dealt by a hash, each block meeting one scan of the faces. A task multiplies its
    faces with the persons' means, and with all vectors only for the pairs that can still be among a person's best of the task, of which
    it hands on ``most`` a person; no pair below that leaves a task. Persons without vectors, faces without one, and faces whose vector has
    another length than a person's, give no rows.
    """
    vectors = written(person_vectors(faces, assignments, anchors).withColumn("size", F.size("vector")), "person-vectors")
    never = cannot_links.groupBy(F.col("face_id").alias("id")).agg(F.collect_set("person_id").alias("never"))
    rows = unlabelled(faces, assignments, ignored).where("embedding is not null").select("id", "embedding").join(never, "id", "left")
    rows = written(rows.select("id", "embedding", F.coalesce("never", F.array().cast("array<bigint>")).alias("never")), "candidates")
    schema = "person_id long, id long, similarity double"
    found = faces.sparkSession.createDataFrame([], schema)
    for size, n in sorted((r["size"], r["count"]) for r in vectors.groupBy("size").count().collect()):
        parts = -(-n // block)
        for i in range(parts):
            own = vectors.where(F.col("size") == size)
            own = own if parts == 1 else own.where(F.pmod(F.xxhash64("person_id", "cluster"), F.lit(parts)) == i)
            own = own.select("person_id", "vector").toArrow()
            if own.num_rows:
                flat = np.array(own.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, size)
                found = found.unionByName(rows.where(F.size("embedding") == size).mapInArrow(_finder(np.array(own.column("person_id"), np.int64), flat, least, most, digits), schema))
    best = found.groupBy("person_id", "id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


def _finder(person: np.ndarray, vectors: np.ndarray, least: float, most: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        persons = Persons(person, vectors)
        limit = np.full(len(persons.ids), least)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(persons.ids)
        step = max(1, AT_ONCE // len(persons.ids))
        for batch in batches:
            flat = np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            ids, never = np.array(batch.column(0), np.int64), batch.column(2).to_pylist()
            for at in range(0, len(ids), step):
                for p, own, found in persons.best(flat[at : at + step], ids[at : at + step], never[at : at + step], limit, digits):
                    own, found = np.concatenate([held[p][0], own]), np.concatenate([held[p][1], found])
                    order = np.lexsort((own, -found))[:most]
                    held[p] = own[order], found[order]
                    if len(order) == most:
                        limit[p] = max(limit[p], found[order[-1]])
        sizes = [len(x[0]) for x in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(persons.ids, sizes)), pa.array(np.concatenate([x[0] for x in held])), pa.array(np.concatenate([x[1] for x in held]))], names=["person_id", "id", "similarity"]
        )

    return run
