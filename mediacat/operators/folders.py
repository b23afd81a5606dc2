"""Folders: roll-ups, visibility, longest prefixes, order. The folder tree is in ``tree``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import GIF, RAW, VIDEO
from ..functions.text import ancestors, name_of, prefixes
from ..work import written


def rollup(rows: DataFrame, descending: bool = True, with_size: bool = True, covers: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row per folder of a listing that is sorted by capture time, then id.

    The thumbnail is the first item in order, unless ``covers`` (path, tmb, ord) names one, the last of several that are among ``files``
    (full_path) if these are given. Times are the extremes of the first
    and last item only, as the listing shows them. One aggregation with map-side combination; no sort of the rows.
    """
    taken = F.col("date_taken")
    order = F.struct((-taken if descending else taken).alias("t"), "id")
    item = F.struct("full_path", "last_modified", "date_taken")
    pick = F.greatest if descending else F.least
    out = rows.groupBy(F.col("parent_path").alias("path")).agg(
        F.count("*").alias("media_count"),
        (F.sum("size") if with_size else F.lit(0).cast("long")).alias("size"),
        F.bit_or("type").alias("media_types"),
        F.min_by(item, order).alias("first"),
        F.max_by(item, order).alias("last"),
    )
    out = out.select(
        "path", name_of("path").alias("filename"), F.col("first.full_path").alias("thumbnail"), "media_count", "size", "media_types",
        pick("first.last_modified", "last.last_modified").alias("last_modified"), pick("first.date_taken", "last.date_taken").alias("date_taken"),
    )
    if covers is not None:
        if files is not None:
            covers = covers.join(files.select(F.col("full_path").alias("tmb")).distinct(), "tmb", "left_semi")
        own = covers.groupBy("path").agg(F.max_by("tmb", "ord").alias("tmb"))
        out = out.join(own, "path", "left").withColumn("thumbnail", F.coalesce("tmb", "thumbnail")).drop("tmb")
    return out


def sort_value(by: str) -> Column:
    return F.col({"name": "filename", "path": "path", "size": "size", "count": "media_count", "modified": "last_modified", "taken": "date_taken"}[by]).cast("string")


def _under(folders: DataFrame, rules: DataFrame, flag: str, above_only: bool = False) -> DataFrame:
    above = folders.select("path", F.explode(ancestors("path")).alias("a"))
    if above_only:
        above = above.where(F.lower("a") != F.lower("path"))
    hit = above.select("path", F.lower("a").alias("a")).join(rules.select(F.lower("path").alias("a")).distinct(), "a", "left_semi")
    return hit.select("path").distinct().withColumn(flag, F.lit(True))


def visibility(folders: DataFrame, included: DataFrame, excluded: DataFrame, nomedia: DataFrame, bursts: DataFrame | None = None, show_hidden: bool = False) -> DataFrame:
    """Adds ``visible`` to folders (path): an ordered list of rules, the first that applies decides.

    1 empty path: no. 2 a burst folder (``bursts``: paths holding burst frames) named img_...: no. 3 dotted name: no. 4 path
    included, exactly: yes. 5 own marker file: no. 6 path excluded, exactly: no. 7 it or a parent included, any case: yes.
    8 the same excluded: no. 9 a dotted part of the path, or a marker above: no. 10 yes. With ``show_hidden`` 3, 5 and 9 are
    skipped. Each rule set joins on exploded ancestors, so every join is an equi-join.
    """
    out = folders
    for rules, flag in ((included, "inc"), (excluded, "exc"), (nomedia, "own")):
        out = out.join(rules.select("path", F.lit(True).alias(flag)).distinct(), "path", "left")
    for rules, flag in ((included, "inc_above"), (excluded, "exc_above"), (nomedia, "marked")):
        out = out.join(_under(folders, rules, flag), "path", "left")
    if bursts is not None:
        out = out.join(bursts.select("path", F.lit(True).alias("burst")).distinct(), "path", "left")
    name = name_of("path")
    shown, off = F.lit(show_hidden), F.lit(not show_hidden)
    rule = F.when(F.col("path") == "", False)
    if bursts is not None:
        rule = rule.when(F.lower(name).startswith("img_") & F.col("burst"), False)
    rule = rule.when(off & name.startswith("."), False).when(F.col("inc"), True)
    rule = rule.when(off & F.col("own"), False).when(F.col("exc"), False).when(F.col("inc_above"), True).when(F.col("exc_above"), False)
    rule = rule.when(shown, True).when((F.instr("path", "/.") > 0) | F.coalesce("marked", F.lit(False)), False).otherwise(True)
    return out.select(*folders.columns, rule.alias("visible"))


def marked_names(folders: DataFrame, included: DataFrame, nomedia: DataFrame) -> DataFrame:
    """Folder names, "(hidden)" added where a marker lies in the folder or above and nothing includes it."""
    out = folders.join(_under(folders, nomedia, "m"), "path", "left").join(_under(folders, included, "i"), "path", "left")
    return out.select("path", F.when(F.col("m") & F.col("i").isNull(), F.concat(name_of("path"), F.lit(" (hidden)"))).otherwise(name_of("path")).alias("name"))


#: Rewrites of a path after which it is taken for one that runs in a circle.
MOST_REWRITES = 40


def resolved(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``real`` to ``paths`` (path): the path without ``aliases`` (path, target), folders that stand for other folders.

    Again and again the longest alias that the path is, or that it lies below, gives way to its target, until none is left. Paths that never
    end so, as their aliases run in a circle, stay as they are. A round is an equi-join of the beginnings of those paths that the last one
    changed, and of these the driver learns only whether there are any.
    """
    short = aliases.where("path <> target").groupBy(F.col("path").alias("a")).agg(F.min("target").alias("target"))
    moving = paths.select("path", F.col("path").alias("real")).where("path is not null").distinct()
    done = None
    for i in range(MOST_REWRITES):
        above = moving.select("path", "real", F.explode(ancestors("real")).alias("a")).join(short, "a")
        longest = above.groupBy("path").agg(F.max_by(F.struct("a", "target"), F.length("a")).alias("m"))
        step = written(moving.join(longest, "path", "left"), f"rewritten-{i}")
        still = step.where("m is null").select("path", "real")
        done = still if done is None else done.unionByName(still)
        moving = step.where("m is not null").select("path", F.concat(F.col("m.target"), F.expr("substring(real, length(m.a) + 1)")).alias("real"))
        if moving.isEmpty():
            break
    return paths.join(done, "path", "left").withColumn("real", F.coalesce("real", "path"))


def distinct_real_folders(folders: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of folders that are one after :func:`resolved`, in any case, the first by ``ord``."""
    real = resolved(folders, aliases).withColumn("_k", F.lower("real"))
    return real.groupBy("_k").agg(F.min_by(F.struct(*folders.columns), "ord").alias("r")).select("r.*")


def distinct_folders(folders: DataFrame) -> DataFrame:
    """Of folders that differ in case only the first (by ``ord``)."""
    first = folders.groupBy(F.lower("path").alias("_k")).agg(F.min_by(F.struct(*folders.columns), "ord").alias("r"))
    return first.select("r.*")


def crowded_ancestors(folders: DataFrame, marker: str = "/android/data", more_than: int = 50) -> DataFrame:
    """Deepest folders under ``marker`` that have more than so many folders below them."""
    above = folders.select("path", F.explode(ancestors("path")).alias("a")).where("a <> path")
    many = above.where(F.instr(F.lower("a"), marker) > 0).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    upper = many.select(F.explode(ancestors("a")).alias("u"), "a").where("u <> a").select(F.col("u").alias("a")).distinct()
    return many.join(upper, "a", "left_anti").select(F.col("a").alias("path"), "n")


def longest_prefix(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent): the longest parent path that the child's path starts with, any case, no path boundary needed.

    A prefix test is not an equi-join; exploding the child's beginnings makes it one, of as many rows as characters.
    """
    starts = children.select(F.col("path").alias("child"), F.posexplode(prefixes(F.lower("path"))).alias("n", "p"))
    hit = starts.join(parents.select(F.col("path").alias("parent"), F.lower("path").alias("p")), "p")
    return hit.groupBy("child").agg(F.max_by("parent", "n").alias("parent"))


def ordered(dirs: DataFrame, by: str = "taken", descending: bool = True, pinned: DataFrame | None = None) -> DataFrame:
    """Adds ``position``'s sort keys: pinned folders first, then the sort value; ties keep the path's order."""
    number = by in ("size", "count", "modified", "taken")
    value = F.coalesce(F.expr(f"try_cast({'media_count' if by == 'count' else {'size': 'size', 'modified': 'last_modified', 'taken': 'date_taken'}.get(by, '0')} as bigint)"), F.lit(0)) if number else F.lower(sort_value(by))
    out = dirs.withColumn("sort_key", value)
    first = F.lit(1)
    if pinned is not None:
        out = out.join(pinned.select("path", F.lit(0).alias("_pin")).distinct(), "path", "left")
        first = F.coalesce("_pin", F.lit(1))
    out = out.withColumn("pin_rank", first)
    return out.drop("_pin").orderBy("pin_rank", F.desc("sort_key") if descending else "sort_key", "path")


def custom_order(dirs: DataFrame, order: str, separator: str = "|||") -> DataFrame:
    """Position in a stored list of paths; folders that are not listed follow, by path."""
    listed = F.array_position(F.split(F.lit(order), r"\|\|\|" if separator == "|||" else separator), F.col("path"))
    return dirs.select("path", F.when(listed > 0, listed).otherwise(F.lit(1 << 30)).cast("long").alias("rank")).orderBy("rank", "path")


def parsed_covers(lines: DataFrame, column: str = "value") -> DataFrame:
    """Covers (path, tmb, ord) of rows of JSON text, each a list of {path, tmb}; a row that is no such list has none."""
    listed = F.from_json(column, "array<struct<path:string,tmb:string>>")
    return lines.select(F.posexplode(listed).alias("ord", "c")).select("c.path", "c.tmb", "ord").where("path is not null and tmb is not null")


#: Albums by type, and by part of a path in any case.
ALBUM_TYPES = {"smart_album_videos": VIDEO, "smart_album_gifs": GIF, "smart_album_raw": RAW}
ALBUM_PARTS = {"smart_album_screenshots": "/screenshots", "smart_album_downloads": "/download", "smart_album_camera": "/dcim/camera"}


def smart_albums(media: DataFrame) -> DataFrame:
    """(album, and the columns of the media) for each album that a medium is in; one look at each row."""
    rules = [(name, F.col("type") == kind) for name, kind in ALBUM_TYPES.items()]
    rules += [(name, F.contains(F.lower("full_path"), F.lit(part))) for name, part in ALBUM_PARTS.items()]
    own = F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())
    return media.select(F.explode(own).alias("album"), *media.columns)
