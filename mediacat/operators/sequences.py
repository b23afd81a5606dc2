"""Bursts, sections, sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import day_start
from ..functions.text import ascii_fold, extension_of
from ..work import discard, written


#: Images of a range of time, about, of which a task sorts one or a few.
RANGE_ROWS = 250_000


def burst_rows(images: DataFrame, gap_ms: int = 3000) -> DataFrame:
    """Images (id, parent_path, date_taken) with their group: images in a row, of one folder, at most ``gap_ms`` apart, in the
    order of all images; ``group`` is the time and id of its first image.

    An image of another folder in between ends a group, so order is global. Rows are dealt by ranges of (time, id), so that images of
    one time, or of none, do not end in one task, and written: windows run inside a range, and one narrow row a range carries its last image
    and last group start to the next. Images of unknown time (0) are a group each.
    """
    order = F.struct("date_taken", "id")
    images = written(images.select("id", "parent_path", "date_taken"), "burst-images")
    ranges = images.count() // RANGE_ROWS + 1
    ranges = max(ranges, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(images.repartitionByRange(ranges, "date_taken", "id").withColumn("bucket", F.spark_partition_id()), "burst-ranges")
    discard(images)
    rows = rows.repartition(ranges, "bucket")  # a given number, which is not lowered: a task holds one range or a few
    inside = Window.partitionBy("bucket").orderBy("date_taken", "id")
    seen = F.struct("date_taken", "id", "parent_path")
    ends = rows.groupBy("bucket").agg(F.max_by(seen, order).alias("last"))
    over = Window.orderBy("bucket")
    carried = ends.select("bucket", F.lag("last").over(over).alias("carried"))
    before = F.coalesce(F.lag(seen).over(inside), F.col("carried"))
    rows = rows.join(carried, "bucket").withColumn("before", before)
    same = (F.col("before.parent_path") == F.col("parent_path")) & (F.col("before.date_taken") > 0) & (F.col("date_taken") > 0)
    starts = ~F.coalesce(same & (F.col("date_taken") - F.col("before.date_taken") <= gap_ms), F.lit(False))
    rows = rows.withColumn("start", F.when(starts, order))
    reach = rows.groupBy("bucket").agg(F.max("start").alias("latest"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select("bucket", F.max("latest").over(running).alias("earlier"))
    rows = rows.join(reach, "bucket").withColumn("group", F.coalesce(F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "earlier"))
    return rows.select("id", "parent_path", "date_taken", "group")


def bursts(images: DataFrame, gap_ms: int = 3000) -> DataFrame:
    """Groups of two or more images (see :func:`burst_rows`)."""
    out = burst_rows(images, gap_ms).groupBy("group").agg(F.count("*").alias("n"), F.min("parent_path").alias("folder"), F.min("date_taken").alias("first_taken"), F.max("date_taken").alias("last_taken")).where("n >= 2")
    return out.select(F.col("group.id").alias("first_id"), "n", "folder", "first_taken", "last_taken")


def sharpest(rows: DataFrame, sharpness: DataFrame) -> DataFrame:
    """Of each burst of two or more ``rows`` (id, date_taken, group) the sharpest image, the first of equal ones, and what the
    least sharp one has of it in per cent, cut to a whole number. An image of unknown ``sharpness`` (id, sharpness) has 0."""
    known = rows.join(sharpness, "id", "left").withColumn("s", F.coalesce("sharpness", F.lit(0.0)))
    out = known.groupBy("group").agg(F.count("*").alias("n"), F.max_by("id", F.struct("s", (-F.col("date_taken")).alias("t"), (-F.col("id")).alias("i"))).alias("best_id"), F.max("s").alias("most"), F.min("s").alias("least"))
    share = F.when(F.col("most") > 0, F.floor(F.col("least") / F.col("most") * 100)).otherwise(0).cast("long")
    return out.where("n >= 2").select(F.col("group.id").alias("first_id"), "n", "best_id", share.alias("least_percent"))


def section_key(by: str) -> Column:
    """Key of the section in which a row is listed."""
    return {
        "taken_day": day_start(F.col("date_taken")).cast("string"),
        "taken_month": day_start(F.col("date_taken"), "MONTH").cast("string"),
        "modified_day": day_start(F.col("last_modified")).cast("string"),
        "modified_month": day_start(F.col("last_modified"), "MONTH").cast("string"),
        "type": F.col("type").cast("string"),
        "extension": extension_of("filename"),
        "folder": F.col("parent_path"),
    }[by]


def section_title(by: str, key: str = "section_key", now_ms: int = 0) -> Column:
    """Title of a section; "today" and "yesterday" are relative to ``now_ms``."""
    k = F.col(key)
    if by in ("taken_day", "modified_day"):
        at, today = F.timestamp_millis(k.cast("long")), F.to_date(F.timestamp_millis(F.lit(now_ms)))
        return F.when(F.to_date(at) == today, "today").when(F.to_date(at) == F.date_sub(today, 1), "yesterday").otherwise(F.date_format(at, "yyyy-MM-dd"))
    if by in ("taken_month", "modified_month"):
        return F.date_format(F.timestamp_millis(k.cast("long")), "MMMM yyyy")
    if by == "type":
        names = F.create_map(*[F.lit(x) for pair in (("1", "images"), ("2", "videos"), ("4", "gifs"), ("8", "raws"), ("16", "svgs"), ("32", "portraits")) for x in pair])
        return F.coalesce(names[k], F.lit("unknown"))
    return F.when(k == "", "unknown").otherwise(F.upper(k) if by == "extension" else k)


def sections(rows: DataFrame, by: str) -> DataFrame:
    """Rows with section_key, grid_position (from 0) and section_count; listed by capture time, newest first, then id.

    A few sections may hold all rows, so none is one task's: places in the order of section and row, less the section's first.
    """
    return within(rows.withColumn("section_key", section_key(by)), "section_key", F.desc("date_taken"), "id").withColumnsRenamed({"position": "grid_position", "count": "section_count"})


def ungrouped(rows: DataFrame) -> DataFrame:
    """The one section of a listing that scrolls sideways, or is not to be grouped: empty key, rows by capture time."""
    return placed(rows, F.desc("date_taken"), "id").withColumn("section_key", F.lit("")).withColumn("grid_position", F.col("place") - 1).drop("place")


def shuffled(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Rows with their place in a random order that the seed fixes."""
    return placed(rows.withColumn("_r", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))), "_r", key).drop("_r")


def group_setting(flags: Column, show_all: bool) -> Column:
    """Grouping by folder (32) outside show-all loses 33, which leaves the bit for "none" (1) set."""
    folder = flags.bitwiseAND(F.lit(32)) != 0
    return F.when(folder & F.lit(not show_all), flags - 33).otherwise(flags)


def sort_key(by: str) -> Column:
    return {"name": F.lower("filename"), "path": F.lower("full_path"), "size": F.col("size"), "modified": F.col("last_modified"), "taken": F.col("date_taken")}[by]


def sorted_media(rows: DataFrame, by: str, descending: bool) -> DataFrame:
    """Stable in both directions: ties stay in id order."""
    return rows.orderBy(F.desc(sort_key(by)) if descending else sort_key(by), "id")


def sorted_faces(faces: DataFrame, by: str, descending: bool) -> DataFrame:
    """Descending is the reverse of ascending, so ties turn round too."""
    return faces.orderBy(F.desc(by), F.desc("id")) if descending else faces.orderBy(by, "id")


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """All ``rows`` with their place (from 1) in a total ``order``.

    Rows are range-partitioned and sorted, and written with their number inside the partition, so that numbers and counts are
    of one run; the sums of the counts before, one narrow row a partition, are added.
    """
    own = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("_part").agg(F.count("*").alias("n"))
    counts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return own.join(F.broadcast(counts), "_part").withColumn("place", place).drop("_part", "_at", "_before")


def within(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """All ``rows`` with their position (from 0) inside their ``key`` and the key's count; keys may be few and large."""
    out = placed(rows, key, *order)
    own = out.groupBy(key).agg(F.min("place").alias("_first"), F.count("*").alias("count"))
    return out.join(own, key).withColumn("position", F.col("place") - F.col("_first")).drop("place", "_first")


def sync_list(rows: DataFrame) -> DataFrame:
    """(id, kind, last_modified, place) as a device is told: images, latest first, then videos, latest first; equal times by id.

    An id has the place of its first occurrence and the values of its last, so a video whose id an image has takes the image's place. Places number what is left, so they are dense over both parts.
    """
    part = F.when(F.col("type") == 2, 1).otherwise(0)
    both = rows.where("type in (1, 2)").select("id", "type", "last_modified", part.alias("part"), F.struct(part.alias("p"), (-F.col("last_modified")).alias("t"), "id").alias("slot"))
    one = both.groupBy("id").agg(F.min("slot").alias("slot"), F.max_by(F.struct("type", "last_modified"), F.struct("part", (-F.col("last_modified")).alias("t"))).alias("v"))
    return placed(one.select("id", F.col("v.type").alias("type"), F.col("v.last_modified").alias("last_modified"), "slot"), "slot").drop("slot")


def searched(rows: DataFrame, text: str, column: str = "filename") -> DataFrame:
    """Names containing ``text`` in any case (nothing is a wildcard); those that start with it have rank 0."""
    name, wanted = F.lower(column), text.lower()
    return rows.where(F.contains(name, F.lit(wanted))).withColumn("rank", F.when(name.startswith(wanted), 0).otherwise(1))


def named(groups: DataFrame) -> DataFrame:
    return groups.orderBy(ascii_fold("name"), "id")
