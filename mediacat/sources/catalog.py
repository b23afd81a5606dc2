"""Catalog tables, derived from the generic event, document and vector tables (rules: FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging
from ..functions.kinds import type_of
from ..work import short_batches

ROOT = "/storage/emulated/0/"
FOLDERS = ("DCIM/Camera", "Pictures/Screenshots", "Download", "WhatsApp/Media/.Statuses", "Android/data/com.x/stickers/", "Pictures/Trip")
EXTENSIONS = (".jpg", ".JPG", ".png", ".mp4", ".gif", ".dng", ".svg", ".jpeg", ".txt", ".heic")
INCLUDED = (f"{ROOT}WhatsApp/Media/.Statuses/click", f"{ROOT}pictures/screenshots")
EXCLUDED = (f"{ROOT}Download", f"{ROOT}Pictures/Trip/view")
PROTECTED = (f"{ROOT}DCIM/Camera/click", f"{ROOT}pictures/screenshots/view")
NOMEDIA = (f"{ROOT}Android/data", f"{ROOT}Pictures/Screenshots/purchase")
PINNED = (f"{ROOT}Pictures/Trip/click", f"{ROOT}DCIM/Camera/view")


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n.cast("int") + 1)


class Catalog:
    """The tables of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, stream: bool = False):
        self.spark, self.sf_dir, self.stream = spark, sf_dir, stream

    def read(self, name: str) -> DataFrame:
        short_batches(self.spark)
        path = f"{self.sf_dir}/{name}.parquet"
        rows = self.spark.read.parquet(path)
        if not self.stream:
            return rows
        source = self.spark.readStream.schema(rows.schema)
        if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):  # one file; a stream reads folders
            return source.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        return source.parquet(path)

    def streamed(self) -> Catalog:
        """The same tables as streams of the files that there are and that come."""
        return Catalog(self.spark, self.sf_dir, stream=True)

    def rows(self, values: tuple, column: str) -> DataFrame:
        return self.spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, ord int")

    @cached_property
    def media(self) -> DataFrame:
        i, user = F.col("event_id"), F.col("user_id")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        folder = F.concat(F.lit(ROOT), _pick(FOLDERS, user % 6), F.when(user % 6 == 4, user.cast("string")).otherwise(""), F.lit("/"), "event_type")
        name = F.concat(F.when(i % 41 == 0, ".").otherwise(""), F.lit("IMG_"), i.cast("string"), _pick(EXTENSIONS, i % 10))
        return self.read("events").select(
            i.alias("id"),
            name.alias("filename"),
            F.concat(folder, F.lit("/"), name).alias("full_path"),
            folder.alias("parent_path"),
            (ms + (i % 3600) * 1000).alias("last_modified"),
            F.when(i % 17 == 0, 0).otherwise(ms).alias("date_taken"),
            F.when(i % 53 == 0, 0).otherwise(F.floor(F.col("value") * 1000)).cast("long").alias("size"),
            type_of(name).alias("type"),
            F.when(i % 10 == 3, i % 300).otherwise(0).cast("int").alias("video_duration"),
            (i % 13 == 0).alias("is_favorite"),
            F.when(i % 29 == 0, ms + 86_400_000).otherwise(0).alias("deleted_ts"),
            i.alias("media_store_id"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """(full_path, last_modified) of the media and of a marker file in each marked folder."""
        marks = self.rows(NOMEDIA, "path").select(F.concat("path", F.lit("/.nomedia")).alias("full_path"), (F.col("ord") * 1000).cast("long").alias("last_modified"))
        return self.media.select("full_path", "last_modified").unionByName(marks)

    @cached_property
    def date_takens(self) -> DataFrame:
        return self.media.where("id % 7 = 0").select("full_path", "filename", "parent_path", (F.col("last_modified") - (F.col("id") % 3600) * 1000 + 5000).alias("date_taken"), "last_modified")

    @cached_property
    def favorites(self) -> DataFrame:
        return self.media.where("id % 13 = 0").select("full_path", "filename", "parent_path")

    @cached_property
    def faces(self) -> DataFrame:
        v = F.col("vec_id")
        photo = self.media.select(F.col("id").alias("photo"), F.col("full_path").alias("media_full_path"))
        faces = self.read("embeddings").select(
            v.alias("id"), (v - v % 3).alias("photo"), (v % 3).cast("int").alias("face_index"), ((v % 97) / F.lit(96.0)).alias("score"),
            ((v * 7) % 500).cast("int").alias("bbox_left"), ((v * 7) % 500 + v % 60).cast("int").alias("bbox_right"), "embedding",
        )
        return faces.join(photo, "photo").drop("photo")

    @cached_property
    def persons(self) -> DataFrame:
        return self.read("nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def assignments(self) -> DataFrame:
        return self.read("embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("face_id"), F.col("label").cast("long").alias("person_id"), (F.col("vec_id") % 8 == 0).alias("is_manual"))

    @cached_property
    def cannot_links(self) -> DataFrame:
        return self.read("embeddings").where("vec_id % 11 = 0").select(F.col("vec_id").alias("face_id"), F.col("label").cast("long").alias("person_id"))

    @cached_property
    def anchors(self) -> DataFrame:
        return self.read("embeddings").where("vec_id % 50 = 1").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("person_id"), "embedding")

    @cached_property
    def ignored(self) -> DataFrame:
        return self.read("embeddings").where("vec_id % 19 = 0").select(F.col("vec_id").alias("face_id"))

    @cached_property
    def groups(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def members(self) -> DataFrame:
        return self.read("nation").where("n_nationkey < 10").select(F.col("n_regionkey").cast("long").alias("group_id"), F.col("n_nationkey").cast("long").alias("person_id"))

    @cached_property
    def geo(self) -> DataFrame:
        k = F.col("c_custkey")
        south = k % 3 == 0
        return self.read("customer").select(
            F.concat(F.lit("/geo/"), k.cast("string")).alias("path"),
            (F.when(south, -35.0).otherwise(47.0) + ((k * 7919) % 3000) / F.lit(1000.0)).alias("lat"),
            (F.when(south, -72.0).otherwise(16.0) + ((k * 104729) % 6000) / F.lit(1000.0)).alias("lon"),
            (k % 5 != 0).alias("has_geo"),
        )

    @cached_property
    def ocr(self) -> DataFrame:
        return self.read("documents").select(F.concat(F.lit("/ocr/"), F.col("doc_id").cast("string")).alias("path"), F.substring("text", 1, 8000).alias("text"))

    @cached_property
    def whole_ocr(self) -> DataFrame:
        """Recognised texts without the cut of the index."""
        return self.read("documents").select(F.concat(F.lit("/ocr/"), F.col("doc_id").cast("string")).alias("path"), "text")

    @cached_property
    def sharpness(self) -> DataFrame:
        """(id, sharpness) of the media of which a vector is taken for the pixels."""
        gray = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int"))
        return imaging.sharpness(self.read("embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), gray.alias("gray")))

    @cached_property
    def qr(self) -> DataFrame:
        return self.read("pages").select(F.concat(F.lit("/ocr/"), F.col("page_id").cast("string")).alias("path"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("").alias("qr_text"))
