"""Changes to catalog tables, each as a new table; the caller writes it beside the old one and swaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_of, parent_of

BIN = "recycle_bin"


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, whole; the later of several new rows (by ``ord``, then
    one that is the same in every run) holds.

    Rows with a null in the key are like no other: they stay, and new ones are added. One aggregation by key with map-side
    combination, so a hot key is reduced before it is shuffled.
    """
    names = [c for c in old.columns]
    both = old.select(F.struct(*names).alias("r"), F.lit(0).alias("v"), F.lit(0).cast("long").alias("o"))
    fresh = new.select(F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in names]).alias("r"), F.lit(1).alias("v"), (F.col("ord") if "ord" in new.columns else F.lit(0)).cast("long").alias("o"))
    keys = [F.col(f"r.{k}").alias(f"_k{i}") for i, k in enumerate(key)]
    both = both.unionByName(fresh)
    known = reduce(Column.__and__, [F.col(f"r.{k}").isNotNull() for k in key])
    one = both.where(known).groupBy(*keys).agg(F.max_by("r", F.struct("v", "o", F.xxhash64("r"))).alias("r"))
    return one.select("r.*").unionByName(both.where(~known).select("r.*"))


def freed(new: DataFrame, taken: DataFrame, order: str = "id") -> DataFrame:
    """``new`` rows under free values of full_path: one that is ``taken`` (full_path), or that an earlier row wants, gets the
    least number before its extension with which it is neither taken nor wanted.

    Numbers in use are gathered for each name that needs one, so a group holds the numbered copies of one file only.
    """
    stem, ext = F.regexp_replace("full_path", r"\.[^./]*$", ""), F.regexp_extract("full_path", r"(\.[^./]*)$", 1)
    used = taken.select("full_path").unionByName(new.select("full_path")).distinct()
    numbered = used.select(F.regexp_extract(stem, r"^(.*)_(\d{1,9})$", 1).alias("_stem"), ext.alias("_ext"), F.regexp_extract(stem, r"_(\d{1,9})$", 1).try_cast("int").alias("k")).where("k > 0")
    own = new.join(taken.select("full_path", F.lit(1).alias("_taken")).distinct(), "full_path", "left")
    rank = F.row_number().over(Window.partitionBy("full_path").orderBy(order)) - 1 + F.coalesce("_taken", F.lit(0))
    own = own.withColumn("_rank", rank).withColumn("_stem", stem).withColumn("_ext", ext)
    numbers = numbered.join(own.where("_rank > 0").select("_stem", "_ext").distinct(), ["_stem", "_ext"], "left_semi").groupBy("_stem", "_ext").agg(F.collect_set("k").alias("_used"))
    own = own.join(numbers, ["_stem", "_ext"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.element_at(F.array_except(F.sequence(F.lit(1), F.col("_rank") + F.size("_used")), "_used"), F.col("_rank"))
    path = F.when(F.col("_rank") > 0, F.concat("_stem", F.lit("_"), free.cast("string"), "_ext")).otherwise(F.col("full_path"))
    return own.withColumn("full_path", path).select(new.columns)


def rekeyed(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Gives rows the keys of ``changes`` (old_key, new_key); a row that already has a new key is deleted for it."""
    moved = rows.join(changes, rows[key] == changes["old_key"])
    moved = moved.select(*[F.col("new_key").alias(c) if c == key else F.col(c) for c in rows.columns])
    rest = rows.join(changes.select(F.col("old_key").alias(key)), key, "left_anti")
    return upsert(rest.select(rows.columns), moved, key)


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    """An unknown condition does not delete."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def inserted(old: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Appends rows under new ids that follow the largest one, in the order of a column.

    Ids number the ranges of a range partitioning, whose sizes alone reach the driver, so they are dense without one task
    seeing all rows.
    """
    start = old.agg(F.max(key)).first()[0] or 0
    parts = new.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    base, at = {}, start + 1
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    offset = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])[F.col("_p")] if base else F.lit(at)
    fresh = parts.withColumn(key, (offset + F.col("_i")).cast("long"))
    return old.unionByName(fresh.select(old.columns))


def to_bin(media: DataFrame, where: Column, now: int) -> DataFrame:
    """Moves rows to the bin: new path and time of deletion; the folder they came from stays in parent_path."""
    gone = where & (F.col("deleted_ts") == 0)
    return updated(media, gone, full_path=F.concat(F.lit(BIN), "full_path"), deleted_ts=F.lit(now).cast("long"))


def from_bin(media: DataFrame, where: Column, order: str = "full_path") -> DataFrame:
    """Restores rows under the path they had; if that is taken meanwhile, under a free one (see :func:`freed`)."""
    back = F.coalesce(where & (F.col("deleted_ts") != 0), F.lit(False))
    stay, home = media.where(~back), media.where(back).withColumn("full_path", F.regexp_replace("full_path", f"^{BIN}", "")).withColumn("deleted_ts", F.lit(0).cast(media.schema["deleted_ts"].dataType))
    home = freed(home, stay.where("full_path is not null"), order)
    return stay.unionByName(home.withColumn("filename", name_of("full_path")) if "filename" in media.columns else home)


def without_expired(media: DataFrame, now: int, month_ms: int = 30 * 86_400_000) -> DataFrame:
    return deleted(media, (F.col("deleted_ts") != 0) & (F.col("deleted_ts") < now - month_ms))


def moved(media: DataFrame, changes: DataFrame) -> DataFrame:
    """Renames or moves paths (old_key, new_key), name and parent included."""
    out = rekeyed(media, "full_path", changes)
    fresh = changes.select(F.col("new_key").alias("full_path"), F.lit(True).alias("_m")).distinct()
    out = out.join(fresh, "full_path", "left")
    return updated(out, F.coalesce("_m", F.lit(False)), filename=name_of("full_path"), parent_path=parent_of("full_path")).drop("_m")


def merged_persons(assignments: DataFrame, cannot_links: DataFrame, persons: DataFrame, source: int, into: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces and exclusions of one person go to another, who had better exist; the first is deleted."""
    where = F.col("person_id") == source
    to = F.lit(into).cast("long")
    return updated(assignments, where, person_id=to), updated(cannot_links, where, person_id=to).distinct(), deleted(persons, F.col("id") == source)


def deleted_person(assignments: DataFrame, cannot_links: DataFrame, anchors: DataFrame, persons: DataFrame, person_id: int) -> tuple[DataFrame, ...]:
    """All four tables without the person; group memberships stay."""
    own = F.col("person_id") == person_id
    return deleted(assignments, own), deleted(cannot_links, own), deleted(anchors, own), deleted(persons, F.col("id") == person_id)


def rejected(assignments: DataFrame, cannot_links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`not_this_person` for all ``pairs`` (face_id, person_id)."""
    pairs = pairs.select("face_id", "person_id").distinct()
    chosen = assignments.join(pairs, ["face_id", "person_id"], "left_semi")
    manual = chosen.where("is_manual").select("face_id", "person_id")
    excluded = chosen.where("not is_manual").select("face_id", "person_id")
    return assignments.join(manual, ["face_id", "person_id"], "left_anti").select(assignments.columns), cannot_links.unionByName(excluded).distinct()


def imported_people(persons: DataFrame, manifests: DataFrame, imported: DataFrame) -> DataFrame:
    """Persons after an import of ``manifests`` (hash, name, folder): those whose hash is in ``imported`` add nothing, names are
    trimmed, blank names and folders are skipped, and a person of the same name is found rather than made again."""
    names = manifests.join(imported.select("hash").distinct(), "hash", "left_anti").where("trim(name) <> '' and folder <> ''").select(F.trim("name").alias("name")).distinct()
    return inserted(persons, names.join(persons.select("name"), "name", "left_anti"), "name")


def not_this_person(assignments: DataFrame, cannot_links: DataFrame, face_id: int, person_id: int) -> tuple[DataFrame, DataFrame]:
    """A face put there by hand loses its assignment; another is excluded for the person."""
    own = (F.col("face_id") == face_id) & (F.col("person_id") == person_id)
    manual = own & F.col("is_manual")
    chosen = assignments.where(own & ~F.col("is_manual")).select("face_id", "person_id")
    return deleted(assignments, manual), cannot_links.unionByName(chosen).distinct()
