"""Queries of changes that are committed to a store: people, favourites, capture times, vectors, streams, indexers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import changes
from ..sources.catalog import Catalog
from ..sources.store import Change, Store, stored
from ..streaming import indexing, ingest
from ..work import work_dir
from .catalog_queries import NOW, query


def _changed(c: Catalog, tables: dict[str, tuple[DataFrame, tuple[str, ...]]], how: Callable[[Change], object]) -> Store:
    """A store of the tables after one change."""
    store = stored(c.spark, work_dir(c.spark, "store"), tables)
    with store.change() as change:
        how(change)
    return store


def _people(c: Catalog) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    return {
        "assignments": (c.assignments.withColumn("updated_at", F.lit(0).cast("long")), ("face_id",)), "cannot_links": (c.cannot_links, ("face_id", "person_id")),
        "anchors": (c.anchors, ("id",)), "persons": (c.persons, ("id",)), "ignored": (c.ignored, ("face_id",)),
    }


def _rows_of(store: Store, **columns: tuple[str, str]) -> DataFrame:
    """(kind, id, person_id) of tables, given the two columns' expressions."""
    out = None
    for kind, (own, person) in columns.items():
        part = store.read(kind).select(F.lit(kind).alias("kind"), F.expr(own).cast("long").alias("id"), F.expr(person).cast("long").alias("person_id"))
        out = part if out is None else out.unionByName(part)
    return out


_PEOPLE = {"assignments": ("face_id", "person_id"), "cannot_links": ("face_id", "person_id"), "anchors": ("id", "person_id"), "persons": ("id", "id"), "ignored": ("face_id", "null")}


def _tagged(change: Change, faces: DataFrame) -> None:
    chosen = lambda k: faces.where(F.col("id") % 20 == k).select(F.col("id").alias("face_id"))
    changes.confirm(change, chosen(1), 3, NOW)
    changes.reject(change, chosen(2), 3)
    changes.ignore(change, chosen(3))
    changes.unignore(change, change.read("ignored").where("face_id % 38 = 0"))
    changes.assign(change, chosen(0), NOW, name="somebody new")


query(
    "D11_tagging",
    """WITH a AS (SELECT face_id, person_id FROM assignments WHERE face_id NOT IN (SELECT id FROM faces WHERE id % 20 IN (0, 1)) UNION ALL SELECT id, 3 FROM faces WHERE id % 20 = 1 UNION ALL SELECT id, (SELECT max(id) + 1 FROM persons) FROM faces WHERE id % 20 = 0)
    SELECT 'assignments' AS kind, face_id AS id, person_id::bigint AS person_id FROM a UNION ALL (SELECT 'cannot_links', face_id, person_id FROM cannot_links UNION SELECT 'cannot_links', id, 3 FROM faces WHERE id % 20 = 2)
    UNION ALL SELECT 'persons', id, id FROM persons UNION ALL SELECT 'persons', max(id) + 1, max(id) + 1 FROM persons
    UNION ALL SELECT 'ignored', i, NULL FROM (SELECT face_id AS i FROM ignored WHERE face_id % 38 <> 0 UNION SELECT id FROM faces WHERE id % 20 = 3) WHERE i NOT IN (SELECT id FROM faces WHERE id % 20 = 0)""",
)(lambda c: _rows_of(_changed(c, _people(c), lambda change: _tagged(change, c.faces)), **{k: v for k, v in _PEOPLE.items() if k != "anchors"}))
query("D11_assign_ignored", "SELECT face_id, 7::bigint AS person_id FROM ignored UNION ALL SELECT face_id, person_id FROM assignments WHERE face_id NOT IN (SELECT face_id FROM ignored)")(
    lambda c: _changed(c, _people(c), lambda change: changes.assign(change, c.ignored, NOW, 7)).read("assignments").select("face_id", "person_id")
)
query(
    "D9_merge_committed",
    """SELECT 'assignments' AS kind, face_id AS id, CASE WHEN person_id = 2 THEN 5 ELSE person_id END::bigint AS person_id FROM assignments
    UNION ALL SELECT DISTINCT 'cannot_links', face_id, CASE WHEN person_id = 2 THEN 5 ELSE person_id END::bigint FROM cannot_links UNION ALL SELECT 'anchors', id, person_id FROM anchors UNION ALL SELECT 'persons', id, id FROM persons WHERE id <> 2""",
)(lambda c: _rows_of(_changed(c, _people(c), lambda change: changes.merge_persons(change, 2, 5)), **{k: v for k, v in _PEOPLE.items() if k != "ignored"}))
query(
    "D10_delete_committed",
    """SELECT 'assignments' AS kind, face_id AS id, person_id FROM assignments WHERE person_id <> 4 UNION ALL SELECT 'cannot_links', face_id, person_id FROM cannot_links WHERE person_id <> 4
    UNION ALL SELECT 'anchors', id, person_id FROM anchors WHERE person_id <> 4 UNION ALL SELECT 'persons', id, id FROM persons WHERE id <> 4""",
)(lambda c: _rows_of(_changed(c, _people(c), lambda change: changes.delete_person(change, 4)), **{k: v for k, v in _PEOPLE.items() if k != "ignored"}))


def _times_fixed(c: Catalog) -> DataFrame:
    """Every fifth file says when it was taken; every fiftieth says something that is no time."""
    said = F.date_format(F.timestamp_millis(F.col("last_modified") - (F.col("id") % 3600) * 1000 + 86_400_000), "yyyy:MM:dd HH:mm:ss")
    texts = c.media.where("id % 5 = 0").select(F.when(F.col("id") % 50 != 0, said).otherwise("none").alias("text"), "full_path", "last_modified")
    store = _changed(c, {"media": (c.media, ("full_path",)), "date_takens": (c.date_takens, ("full_path",))}, lambda change: changes.fix_capture_times(change, texts))
    both = [store.read(t).select(F.lit(t).alias("kind"), "full_path", "date_taken") for t in ("media", "date_takens")]
    return both[0].unionByName(both[1])


query(
    "D13_capture_time_fix",
    """WITH t AS (SELECT full_path, (ms // 1000) * 1000 + 86400000 AS taken FROM (SELECT id, parent_path || '/' || filename AS full_path, ms FROM media0) WHERE id % 5 = 0 AND id % 50 <> 0)
    SELECT 'media' AS kind, full_path, coalesce(t.taken, m.date_taken) AS date_taken FROM media m LEFT JOIN t USING (full_path)
    UNION ALL SELECT 'date_takens', full_path, coalesce(t.taken, d.date_taken) FROM date_takens d FULL JOIN t USING (full_path)""",
)(_times_fixed)


def _no_favorites(c: Catalog) -> DataFrame:
    store = _changed(c, {"media": (c.media, ("full_path",)), "favorites": (c.favorites, ("full_path",))}, changes.clear_favorites)
    return store.read("media").select("id", "is_favorite").unionByName(store.read("favorites").select(F.lit(-1).cast("long").alias("id"), F.lit(True).alias("is_favorite")))


query("D16_clear_favorites", "SELECT id, false AS is_favorite FROM media")(_no_favorites)


def _embedded_anew(c: Catalog) -> DataFrame:
    """A model that reverses vectors, and fails on some faces."""
    fresh = c.faces.select("id", F.when(F.col("id") % 10 != 3, F.reverse("embedding")).alias("embedding"))
    tables = {"faces": (c.faces, ("id",)), "anchors": (c.anchors, ("id",))}
    store = _changed(c, tables, lambda change: changes.replace_embeddings(change, fresh))
    ends = lambda kind: store.read(kind).select(F.lit(kind).alias("kind"), "id", F.get("embedding", 0).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))
    return ends("faces").unionByName(ends("anchors"))


query("V8_embed_anew", "SELECT 'faces' AS kind, id, CASE WHEN id % 10 = 3 THEN embedding[1] ELSE embedding[-1] END::double AS first, CASE WHEN id % 10 = 3 THEN embedding[-1] ELSE embedding[1] END::double AS last FROM faces")(_embedded_anew)

# ---------------------------------------------------------------- streams


def _arrived(c: Catalog) -> Store:
    """The media come twice: all without a size, then some with, some of these twice. The stream runs each time, and takes what has come as a batch."""
    store = ingest.media_store(Store(c.spark, work_dir(c.spark, "media-store")), c.media, buckets=16)
    come = work_dir(c.spark, "media-files")
    rows = c.media.withColumn("arrival", F.lit(0)).withColumn("size", F.lit(0).cast("long"))
    again = c.media.where("id % 3 = 0").withColumn("arrival", F.lit(1)).unionByName(c.media.where("id % 15 = 0").withColumn("arrival", F.lit(2)).withColumn("size", F.col("size") + 1))
    check, files = work_dir(c.spark, "media-stream"), ingest.files_for(c.media)
    for part in (rows, again):
        part.repartition(files, "full_path").write.mode("append").parquet(come)
        source = c.spark.readStream.schema(rows.schema).parquet(come)
        ingest.upsert_stream(source, store, check, order=F.col("arrival")).awaitTermination()
    return store


_ARRIVED = "SELECT * EXCLUDE (size), CASE WHEN id % 15 = 0 THEN size + 1 WHEN id % 3 = 0 THEN size ELSE 0 END::bigint AS size FROM media"

query("ST2_upsert_stream", f"SELECT id, full_path, size FROM ({_ARRIVED})")(lambda c: _arrived(c).read("media").select("id", "full_path", "size"))
query("ST2_refreshed_folders", f"SELECT parent_path AS path, count(*) AS media_count, sum(size)::bigint AS size, bit_or(type) AS media_types FROM ({_ARRIVED}) WHERE deleted_ts = 0 GROUP BY 1")(
    lambda c: _arrived(c).read("directories").select("path", "media_count", "size", "media_types")
)


def _indexed(c: Catalog) -> DataFrame:
    """An indexer over the media names that fails on some, run until nothing is left but what failed for good."""
    store = Store(c.spark, work_dir(c.spark, "indexed"))
    schema = StructType([c.media.schema["full_path"], *StructType.fromDDL("ext string").fields])
    bad = F.col("id") % 37 == 0
    extract = lambda rows: rows.select("full_path", F.when(~bad, text.extension_of("filename")).alias("ext"), F.when(bad, "unreadable").alias("error"))
    indexer = indexing.Indexer(store, "extensions", "full_path", schema, extract, attempts=2, chunk_rows=200_000)
    indexing.chain(store, [(indexer, c.media), (indexer, c.media), (indexer, c.media)])
    done = store.read("extensions").select("full_path", "ext", F.lit(0).alias("attempts"))
    return done.unionByName(store.read("extensions_failed").select("full_path", F.col("error").alias("ext"), "attempts"))


query("ST1_resumed_index", "SELECT full_path, CASE WHEN id % 37 = 0 THEN 'unreadable' ELSE lower(regexp_extract(filename, '[^.]*$')) END AS ext, CASE WHEN id % 37 = 0 THEN 2 ELSE 0 END::int AS attempts FROM media")(_indexed)
