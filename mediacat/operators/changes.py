"""Changes of people, favourites, capture times and faces that touch several tables, each in one commit of a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.imaging import capture_ms
from ..functions.text import name_of, parent_of
from ..sources.store import Change
from ..work import written

# Tables and keys: assignments (face_id), cannot_links (face_id, person_id), anchors (id), persons (id), ignored (face_id),
# faces (id), media (full_path), favorites (full_path), date_takens (full_path)


def confirm(change: Change, faces: DataFrame, person_id: int, now: int) -> None:
    """Faces (face_id) are the person's, by hand, whoever's they were."""
    row = faces.select("face_id", F.lit(person_id).cast("long").alias("person_id"), F.lit(True).alias("is_manual"), F.lit(now).cast("long").alias("updated_at"))
    change.upsert("assignments", row)


def reject(change: Change, faces: DataFrame, person_id: int) -> None:
    """Faces are not to be proposed for the person again; assignments stay."""
    change.upsert("cannot_links", faces.select("face_id", F.lit(person_id).cast("long").alias("person_id")))


def assign(change: Change, faces: DataFrame, now: int, person_id: int | None = None, name: str | None = None) -> int:
    """Confirms faces for a person, a new one of ``name`` if no id is given, and takes them out of the ignored. Returns the person's id."""
    if person_id is None:
        person_id = (change.read("persons").agg(F.max("id")).first()[0] or 0) + 1
        change.upsert("persons", faces.sparkSession.createDataFrame([(person_id, name)], "id long, name string"))
    confirm(change, faces, person_id, now)
    unignore(change, faces)
    return person_id


def ignore(change: Change, faces: DataFrame) -> None:
    change.upsert("ignored", faces.select("face_id"))


def unignore(change: Change, faces: DataFrame) -> None:
    change.delete("ignored", faces.select("face_id"))


def merge_persons(change: Change, source: int, into: int) -> None:
    """Faces and exclusions of one person go to another; the first is deleted, its anchors stay."""
    if source == into:
        return
    own, to = F.col("person_id") == source, F.lit(into).cast("long")
    change.update("assignments", own, person_id=to)
    links = change.read("cannot_links").where(own)
    change.upsert("cannot_links", links.withColumn("person_id", to))
    change.delete("cannot_links", links)
    change.delete("persons", change.read("persons").where(F.col("id") == source))


def delete_person(change: Change, person_id: int) -> None:
    """The person, its assignments, exclusions and anchors go; memberships of groups stay."""
    for name in ("assignments", "cannot_links", "anchors"):
        change.delete(name, change.read(name).where(F.col("person_id") == person_id))
    change.delete("persons", change.read("persons").where(F.col("id") == person_id))


def clear_favorites(change: Change) -> None:
    """No medium is a favourite, and the table of favourites is empty."""
    change.update("media", F.col("is_favorite"), is_favorite=F.lit(False))
    change.clear("favorites")


def fix_capture_times(change: Change, texts: DataFrame, modified: Column | str = "last_modified") -> None:
    """Capture times of files (full_path, text, last_modified), read from what the images say, go to the media and to the table of capture times.

    Texts that are no time are passed over. Media are found by path, A-Z as a-z; the other table gets a row a path as it is given.
    """
    good = texts.withColumn("taken", capture_ms("text")).where("taken is not null and full_path is not null")
    found = good.groupBy(F.lower("full_path").alias("_k")).agg(F.max_by("taken", F.struct("full_path", "taken")).alias("_taken"))
    media = change.read("media")
    hit = media.withColumn("_k", F.lower("full_path")).join(found, "_k")
    change.upsert("media", hit.withColumn("date_taken", F.col("_taken")).select(media.columns))
    row = good.select("full_path", name_of("full_path").alias("filename"), parent_of("full_path").alias("parent_path"), F.col("taken").alias("date_taken"), F.col(modified) if isinstance(modified, str) else modified.alias("last_modified"))
    change.upsert("date_takens", row)


def replace_embeddings(change: Change, embeddings: DataFrame) -> None:
    """New vectors (id, embedding) of faces; those without one keep theirs. Anchors were made by the old model and all go."""
    faces = change.read("faces")
    fresh = embeddings.where("embedding is not null").select("id", F.col("embedding").alias("_e"))
    change.upsert("faces", faces.join(fresh, "id").withColumn("embedding", F.col("_e")).select(faces.columns))
    change.clear("anchors")


def write_back(change: Change, name: str, fresh: DataFrame) -> None:
    """A cached listing becomes ``fresh``: rows that are new or differ are upserted, rows that are gone are deleted, the rest is not
    written. Both meet once, and what differs is written before it is applied."""
    cached, key = change.read(name), change.table(name)["key"]
    names = cached.columns
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in names]
    held = fresh.select(*names, F.lit(True).alias("_in")).alias("f").join(cached.withColumn("_in", F.lit(True)).alias("c"), [F.col(f"f.{k}") == F.col(f"c.{k}") for k in key], "full")
    new, gone = F.col("f._in").isNotNull(), F.col("f._in").isNull()
    cells = [F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in names]
    found = held.where(gone | F.col("c._in").isNull() | ~reduce(Column.__and__, same)).select(*cells, gone.alias("_out"))
    found = written(found, "differences")
    change.upsert(name, found.where("not _out").drop("_out"))
    change.delete(name, found.where("_out"))
