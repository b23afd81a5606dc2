"""What leaves the catalog: listings as JSON and HTML, favourites as text, new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escaped, mime_of, name_of
from ..operators.mutate import freed

#: Items that an index page shows.
PAGE_ITEMS = 2000


def listing_json(media: DataFrame) -> DataFrame:
    """One JSON object a row: id, relpath, name, size, mtime, bucket, mime."""
    item = F.struct("id", F.col("parent_path").alias("relpath"), F.col("filename").alias("name"), "size", F.col("last_modified").alias("mtime"), name_of("parent_path").alias("bucket"), mime_of("filename").alias("mime"))
    return media.select(F.to_json(item).alias("value"))


def index_html(media: DataFrame, items: int = PAGE_ITEMS) -> DataFrame:
    """List items of the newest files, names escaped; the number is what a page shows."""
    newest = media.orderBy(F.desc("last_modified"), F.desc("id")).limit(items)
    return newest.select(F.concat(F.lit('<li><a href="/api/file?id='), F.col("id").cast("string"), F.lit('">'), html_escaped("filename"), F.lit("</a></li>")).alias("value"))


def favorites_lines(favorites: DataFrame) -> DataFrame:
    """One path a line."""
    return favorites.select(F.col("full_path").alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)


def appended(media: DataFrame, new: DataFrame) -> DataFrame:
    """New files under names that are free: a taken name gets a number before its extension, and nothing is overwritten."""
    fresh = freed(new, media)
    return media.unionByName(fresh.withColumn("filename", name_of("full_path")).select(media.columns))
