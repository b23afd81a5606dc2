"""Scans: which media rows a folder, a lookup or a whole listing has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import DEFAULT_MASK, PORTRAIT, effective_taken, has_type, hidden_name, hidden_path, is_marker
from ..functions.text import ancestors, ascii_fold, name_of, parent_of


def in_folder(media: DataFrame, path: str) -> DataFrame:
    """Live media of one folder; the path is compared with A-Z folded."""
    return media.where((F.col("deleted_ts") == 0) & (ascii_fold("parent_path") == ascii_fold(F.lit(path))))


def old_bin_items(media: DataFrame, before: int) -> DataFrame:
    return media.where((F.col("deleted_ts") != 0) & (F.col("deleted_ts") < before))


def with_capture_time(media: DataFrame, date_takens: DataFrame) -> DataFrame:
    """Stored capture times hold over the media's own; an unknown one is the time of the last change."""
    own = date_takens.select("full_path", F.col("date_taken").alias("_stored"))
    return media.join(own, "full_path", "left").withColumn("date_taken", F.coalesce("_stored", effective_taken())).drop("_stored")


def shown(media: DataFrame, mask: int = DEFAULT_MASK, show_hidden: bool = False) -> DataFrame:
    """Rows of the wanted types with a size, hidden names left out unless asked for. An empty mask gives no rows."""
    rows = media.where(has_type(mask) & (F.col("size") > 0))
    return rows if show_hidden else rows.where(~hidden_name())


def listing(media: DataFrame, date_takens: DataFrame, mask: int = DEFAULT_MASK, show_hidden: bool = False) -> DataFrame:
    """Live rows that are to be shown, with effective capture times. The filters precede the join, so they reach the scan."""
    return with_capture_time(shown(media.where("deleted_ts = 0"), mask, show_hidden), date_takens)


#: Names of the two listings that are no folders.
FAVORITES, RECYCLE_BIN = "favorites", "recycle_bin"


def portrait_covers(media: DataFrame, folder: str) -> DataFrame:
    """For each folder named img_... (any case) in ``folder``: its first file named ...cover..., else its first, as a portrait."""
    inner = media.where((F.col("deleted_ts") == 0) & (parent_of("parent_path") == folder) & F.lower(name_of("parent_path")).startswith("img_"))
    row = F.struct(*media.columns)
    best = inner.groupBy("parent_path").agg(F.min_by(row, F.struct((~F.contains(F.lower("filename"), F.lit("cover"))).alias("c"), F.col("filename").alias("f"))).alias("r"))
    return best.select("r.*").withColumn("type", F.lit(PORTRAIT).cast(media.schema["type"].dataType))


def folder_listing(media: DataFrame, date_takens: DataFrame, favorites: DataFrame, folder: str, mask: int = DEFAULT_MASK, show_hidden: bool = False) -> DataFrame:
    """What is shown of one folder, of the favourites (those below hidden folders left out), or of the bin (whose rows keep
    their stored times). Portrait covers are listed if the mask asks for portraits."""
    if folder == RECYCLE_BIN:
        return shown(media.where("deleted_ts <> 0"), mask, show_hidden)
    if folder == FAVORITES:
        paths = favorites.select("full_path").distinct()
        rows = media.where("deleted_ts = 0").join(paths if show_hidden else paths.where(~hidden_path()), "full_path", "left_semi").select(media.columns)
    else:
        rows = media.where((F.col("deleted_ts") == 0) & (F.col("parent_path") == folder))
        if mask & PORTRAIT:
            covers = portrait_covers(media, folder)
            rows = rows.unionByName(covers.join(rows.select("full_path"), "full_path", "left_anti").select(media.columns))
    return with_capture_time(shown(rows, mask, show_hidden), date_takens)


def show_all(media: DataFrame, excluded: DataFrame, protected: DataFrame, mask: int = DEFAULT_MASK, show_hidden: bool = False) -> DataFrame:
    """What is shown of all folders but those that are excluded, or lie below such, and those that are ``protected`` (path)."""
    rows = shown(media.where("deleted_ts = 0"), mask, show_hidden)
    folders = rows.select("parent_path").distinct()
    gone = below(folders, excluded, "parent_path").unionByName(folders.join(protected.select(F.col("path").alias("parent_path")), "parent_path", "left_semi"))
    return rows.join(gone, "parent_path", "left_anti")


def marked_folders(files: DataFrame) -> DataFrame:
    """Folders of marker files, the last changed first."""
    return files.where(is_marker("full_path")).select(parent_of("full_path").alias("path"), "last_modified").orderBy(F.desc("last_modified"), "path")


def newest_folders(media: DataFrame, n: int = 10) -> DataFrame:
    """Distinct parents of the ``n`` newest rows."""
    return media.select("id", "full_path").orderBy(F.desc("id")).limit(n).select(parent_of("full_path").alias("path")).distinct()


def direct_children(media: DataFrame, folder: str, column: str) -> DataFrame:
    """(full_path, value) of a folder's own files, zero values left out."""
    return media.where((parent_of("full_path") == folder) & (F.col(column) != 0)).select("full_path", F.col(column).alias("value"))


def below(folders: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """Folders that are, or lie under, one of ``roots`` (path), in any case: an equi-join on exploded ancestors."""
    above = folders.select(column, F.explode(ancestors(column)).alias("_a")).withColumn("_a", F.lower("_a"))
    hit = above.join(roots.select(F.lower("path").alias("_a")).distinct(), "_a", "left_semi").select(column).distinct()
    return folders.join(hit, column, "left_semi")


def at_paths(rows: DataFrame, wanted: DataFrame, column: str = "full_path") -> DataFrame:
    return rows.join(wanted, column, "left_semi")


def pending(rows: DataFrame, done: DataFrame, column: str = "full_path") -> DataFrame:
    """What an indexer has not worked on yet."""
    return rows.join(done.select(column), column, "left_anti")


MANIFEST = "people array<struct<name:string,folder:string,crops:array<string>>>"


def _crops(manifests: DataFrame) -> DataFrame:
    people = manifests.select(F.explode("people").alias("p")).select(F.trim("p.name").alias("name"), "p.folder", "p.crops")
    return people.where("name <> '' and folder <> ''").select("name", "folder", F.explode("crops").alias("crop"))


def manifest_people(spark, path: str) -> DataFrame:
    """One row per face crop of an import manifest ``{people: [{name, folder, crops: []}]}``; names are trimmed, and people
    without a name or folder skipped."""
    return _crops(spark.read.schema(MANIFEST).json(path, multiLine=True))


def manifest_crops(manifests: DataFrame, column: str = "value") -> DataFrame:
    """The same of manifests that are rows of JSON text."""
    return _crops(manifests.select(F.from_json(column, MANIFEST).alias("m")).select("m.people"))


def imported_favorites(spark, path: str, media: DataFrame) -> DataFrame:
    """Favourites listed one path a line, of files that exist."""
    return listed_favorites(spark.read.text(path), media)


def listed_favorites(lines: DataFrame, media: DataFrame) -> DataFrame:
    """The same of lines (value)."""
    paths = lines.select(F.col("value").alias("full_path")).where("full_path <> ''").distinct()
    return media.select("full_path", "filename", "parent_path").join(paths, "full_path", "left_semi")
