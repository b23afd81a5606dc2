"""Folder-tree shaping: parents made for folders without one of their own, collapse to top folders, sub-folder counts.

Folders come as (path, thumbnail, media_count, size, media_types, last_modified, date_taken), a row a path, in the order of ``ord`` where
there is such a column, else of the path. Paths are compared ignoring case. Every step is a fixed number of joins on exploded ancestors,
however deep the tree: what a made parent adds up is not carried from level to level, each folder adds to all parents above it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefixes
from ..work import written

#: The paths of the bin and of the favourites among folders.
BIN, FAVORITES = "recycle_bin", "favorites"


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffles: what is exploded, or read from small files, is many times larger than the size by which Spark would broadcast it."""
    return left.join(right.hint("merge"), on, how)


def folder_above(path: str | Column) -> Column:
    """The folder that a path lies in; "/" for the topmost, null for "/" itself and for names without a folder."""
    path = F.col(path) if isinstance(path, str) else path
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when((path == "/") | (F.instr(path, "/") == 0), None).otherwise(F.when(cut == "", "/").otherwise(cut))


def _folders_above(path: str) -> Column:
    """All folders above a path, the nearest first."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    upward = F.reverse(F.sequence(F.lit(1), F.size(parts)))
    named = F.transform(upward, lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(F.size(parts) > 0, named).otherwise(F.array().cast("array<string>"))


def listed(dirs: DataFrame) -> DataFrame:
    """Folders with ``has_media`` and the place in the list, of which made parents follow."""
    place = F.col("ord").cast("long") if "ord" in dirs.columns else F.lit(0).cast("long")
    return dirs.select(
        "path", "thumbnail", "media_count", "size", "media_types", "last_modified", "date_taken", F.lit(True).alias("has_media"),
        F.struct(F.lit(0).alias("kind"), place.alias("a"), F.lit(0).cast("long").alias("b"), F.col("path").alias("c")).alias("place"),
    )


def _absorbed(rows: DataFrame, made: DataFrame, descending: bool, in_order: bool) -> DataFrame:
    """The rows of the parents ``made`` (key, path, place, trigger).

    A folder adds to its parent, to the parent's parent, and so on, as long as these are made ones; with ``in_order`` only as long as
    each was made before the next (by trigger). Made parents that differ in case alone each take all children of both, and so add to the
    next parent once each: a folder's part is weighted by their number.
    """
    by_key = made.groupBy("key").agg(F.count("*").alias("n"), F.min("trigger").alias("t"))
    up = rows.select("path", F.posexplode(_folders_above("path")).alias("level", "a")).withColumn("key", F.lower("a"))
    chain = _met(up, by_key, "key").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("level", "key", "n", "t"))).alias("c"))
    late = (lambda x, i: F.coalesce(F.get("c", i - 1)["t"] >= x["t"], F.lit(False))) if in_order else (lambda x, i: F.lit(False))
    ends = F.array_position(F.transform("c", lambda x, i: (x["level"] != i) | late(x, i)), True)
    chain = chain.withColumn("c", F.slice("c", F.lit(1), F.when(ends > 0, ends.cast("int") - 1).otherwise(F.size("c"))))
    weight = lambda i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(1).cast("long"), lambda s, y: s * y["n"])
    parts = chain.select("path", F.explode(F.transform("c", lambda x, i: F.struct(x["key"].alias("key"), i.alias("level"), weight(i).alias("w")))).alias("p")).select("path", "p.*")
    pick = F.max if descending else F.min
    total = _met(rows, parts, "path").groupBy("key").agg(
        F.min_by("thumbnail", F.when(F.col("level") == 0, F.col("place"))).alias("thumbnail"),
        F.sum(F.col("media_count") * F.col("w")).alias("media_count"), F.sum(F.col("size") * F.col("w")).alias("size"), F.bit_or("media_types").alias("media_types"),
        pick("last_modified").alias("last_modified"), pick("date_taken").alias("date_taken"),
    )
    return _met(made, total, "key").withColumn("has_media", F.lit(False)).select(rows.columns)


def with_parents(dirs: DataFrame, descending: bool = True) -> DataFrame:
    """The folders, and a made row for each folder that several listed ones lie in and that is not listed itself.

    Which are made depends on the listed folders alone, but a made one lies in the next above as any other does: counts and sizes add up,
    types are or-ed, times are the latest of the children (the earliest unless ``descending``), the thumbnail is the first child's. The
    number of children is counted by the exact path, all else ignores case. The folders are written first: they are read several times, and
    rolling them up reads all media.
    """
    rows = written(dirs if "place" in dirs.columns else listed(dirs), "listed-folders")
    own = rows.select(F.lower("path").alias("key")).distinct()
    made = rows.select(folder_above("path").alias("parent"), F.struct(F.col("place.a").alias("a"), "path").alias("first")).where("parent is not null")
    made = made.groupBy("parent").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n > 1").withColumn("key", F.lower("parent"))
    made = _met(made, own, "key", "left_anti")
    place = F.struct(F.lit(1).alias("kind"), (-F.length("parent")).cast("long").alias("a"), F.col("first.a").alias("b"), F.col("first.path").alias("c"))
    made = made.select("key", F.col("parent").alias("path"), place.alias("place"), F.lit(None).cast("string").alias("trigger"))
    return rows.unionByName(_absorbed(rows, made, descending, in_order=False))


def collapsed(rows: DataFrame, prefix: str = "", descending: bool = True) -> DataFrame:
    """The folders and those made for the list, with ``kept`` for the ones that the list shows.

    Inside ``prefix``: the folders that lie directly in it. At the top a folder whose parent is listed, or that has a listed sibling, gives
    way to the parent; a parent that is not listed is made, once, when the first such folder by path is looked at. One that is made
    later includes it, one made before does not. Bin and favourites stay at the top. A folder that stays has neither a listed
    parent nor a sibling, so none of those that are left lies directly in another, and one round is all rounds. The folders are written
    first, as in :func:`with_parents`.
    """
    rows = written(rows, "folders")
    special = F.col("path").isin(BIN, FAVORITES)
    found = rows.withColumn("key", F.lower("path")).withColumn("above", folder_above("path")).withColumn("up", F.lower("above"))
    if prefix:
        return found.select(*rows.columns, F.coalesce(~special & (F.col("up") == prefix.lower()), F.lit(False)).alias("kept"))
    siblings = found.where("up is not null").groupBy("up").agg(F.count_distinct("key").alias("n"))
    keys = found.select(F.col("key").alias("up"), F.lit(True).alias("parent_listed")).distinct()
    found = _met(_met(found, siblings, "up", "left"), keys, "up", "left")
    gone = ~special & (F.coalesce("parent_listed", F.lit(False)) | F.coalesce(F.col("n") > 1, F.lit(False)))
    made = found.where(gone & F.col("parent_listed").isNull()).groupBy(F.col("up").alias("key")).agg(F.min("path").alias("trigger"))
    place = F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("trigger").alias("c"))
    made = made.select("key", folder_above("trigger").alias("path"), place.alias("place"), "trigger")
    parents = _absorbed(rows, made, descending, in_order=True)
    return found.select(*rows.columns, (~gone).alias("kept")).unionByName(parents.withColumn("kept", F.lit(True)))


def subfolder_counts(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds to ``parents`` the number of folders with media that count for each, and the sum of the media in those other than itself.

    A folder goes to the parent with its very path, else to the longest one that its path starts with (no path boundary needed, the first of
    equal ones), and counts if that is the folder itself or the one it lies in, or if the one it lies in is among ``children``. Folders
    with media of their own start from their own number, made ones from 0. A prefix test is no equi-join; exploding a path's
    beginnings makes it one, of as many rows as characters.
    """
    own = children.select("path", "media_count", "has_media", F.lower("path").alias("key"), F.lower(folder_above("path")).alias("up"))
    ends = parents.select(F.col("path").alias("parent"), F.lower("path").alias("p"), F.col("place").alias("parent_place"))
    starts = own.select("path", F.posexplode(prefixes("key")).alias("at", "p"))
    order = F.struct((F.col("parent") != F.col("path")).alias("other"), (-F.col("at")).alias("n"), "parent_place")
    goes = _met(starts, ends, "p").groupBy("path").agg(F.min_by("parent", order).alias("parent"))
    among = own.select(F.col("key").alias("up"), F.lit(True).alias("above_listed")).distinct()
    goes = _met(_met(own, goes, "path"), among, "up", "left")
    goes = goes.where((F.lower("parent") == F.col("key")) | (F.lower("parent") == F.col("up")) | F.col("above_listed"))
    total = goes.groupBy("parent").agg(
        F.count_if("has_media").alias("subfolders"), F.sum(F.when(F.col("parent") != F.col("path"), F.col("media_count")).otherwise(0)).alias("more")
    )
    out = _met(parents, total.withColumnRenamed("parent", "path"), "path", "left")
    media = F.when(F.col("has_media"), F.col("media_count")).otherwise(0) + F.coalesce("more", F.lit(0))
    return out.select(*parents.columns, F.coalesce("subfolders", F.lit(0)).alias("subfolders"), media.alias("subfolder_media"))


def shown(dirs: DataFrame, all_dirs: DataFrame | None = None, prefix: str = "", descending: bool = True) -> DataFrame:
    """What a folder list shows when sub-folders are grouped: :func:`with_parents`, :func:`collapsed`, :func:`subfolder_counts`.

    Inside ``prefix`` its own folder, from ``all_dirs`` (default ``dirs``), follows the others, with one sub-folder.
    """
    own = written(listed(dirs), "own-folders") if prefix and all_dirs is None else listed(dirs)
    rows = written(collapsed(with_parents(own, descending), prefix, descending), "shown")
    out = subfolder_counts(rows, rows.where("kept").drop("kept"))
    if prefix:
        own = (own if all_dirs is None else listed(all_dirs)).where(F.lower("path") == prefix.lower())
        own = own.groupBy().agg(F.min_by(F.struct(*own.columns), "place").alias("r")).where("r is not null").select("r.*")
        out = out.unionByName(own.withColumn("subfolders", F.lit(1).cast("long")).withColumn("subfolder_media", F.col("media_count")))
    return out
