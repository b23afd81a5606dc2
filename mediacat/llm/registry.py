"""Queries of the corpus operators, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).withColumn("held_out", held_out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license

    return license.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings``, shown as gray images, are the media column."""
    from . import media

    return media.copies(media.rendered(table(spark, sf_dir, "embeddings"))).withColumnRenamed("image_id", "vec_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of lines and the numbers of those that go."""
    from . import lines

    docs = table(spark, sf_dir, "documents")
    gone = lines.duplicate_lines(docs).groupBy("doc_id", "part").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("part"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return sizes.join(gone, ["doc_id", "part"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages)
    index = warc.write_index(archives)
    return warc.lookup(index, archives, warc.keys_of(pages)).drop("url")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import search

    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_chat": op3_chat,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_license": op6_license,
    "op7_packing": op7_packing,
    "op8_media_copies": op8_media_copies,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_ranked_search": op11_ranked_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_pieces": op13_pieces,
}

SQL: dict[str, str] = {"op2_near_duplicates": sql.OP2, "op3_chat": sql.OP3, "op10_warc": sql.OP10, "op11_ranked_search": sql.OP11, "op12_fill_in_middle": sql.OP12}
