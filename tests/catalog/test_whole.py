"""Queries over whole texts and whole lists."""

import pytest
from pyspark.sql import functions as F

from mediacat.functions import text
from mediacat.operators import sequences
from mediacat.plans import catalog_queries as q


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """What is sought stands only after the 8,000th character."""
    base = str(tmp_path_factory.mktemp("long"))
    texts = [(0, "x " * 5000 + "License of th_the other"), (1, "x " * 5000), (2, None), (3, "x " * 200 + "\u00c9"), (4, "x " * 200 + "E")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, "u") for i in range(5)], "page_id long, url string").write.parquet(f"{base}/pages.parquet")
    return base


@pytest.mark.parametrize("name", ["U1_text_any", "U2_text_all", "X3_wildcards", "J13_text_and_code", "U1_text_any_whole"])
def test_found_at_the_end(spark, long_texts, name):
    assert [r.path for r in q.QUERIES[name](spark, long_texts).collect()] == ["/ocr/0"]


def test_all_characters_are_unaccented(spark, long_texts):
    got = {r.doc_id: r.digest for r in q.QUERIES["X1_unaccented_whole"](spark, long_texts).collect()}
    want = spark.range(1).select(F.md5(F.lit("x " * 200 + "e"))).first()[0]
    assert got[3] == got[4] == want and got[2] is None and got[0] != got[1]


WHOLE = ["O1_sorted_by_name_whole", "O1_sorted_by_size_whole", "O1_sorted_by_taken_whole", "O4_sorted_faces_whole", "O6_natural_order_whole", "O9_search_order_whole"]


@pytest.mark.parametrize("name", WHOLE)
def test_both_names_place_every_row(spark, name):
    sf = "/root/testdata/sf0.01"
    whole = [r.id for r in q.QUERIES[name](spark, sf).orderBy("place").collect()]
    also = [r.id for r in q.QUERIES[name.removesuffix("_whole")](spark, sf).orderBy("place").collect()]
    assert whole == also and len(whole) > 200


def test_places_over_many_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 37 % 11).alias("k"))
    want = {r.id: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.k, r.id)))}
    assert {r.id: r.place for r in sequences.placed(rows, F.desc("k"), "id").collect()} == want
    assert sequences.placed(rows.where("id < 0"), "id").count() == 0


def test_dot_products_of_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    got = q.QUERIES["M3_dot_products_whole"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() and -1.00001 <= got.agg(F.min("dot")).first()[0]


def test_hidden_names(spark):
    df = spark.createDataFrame([("a.jpg",), ("..a.jpg",), (".b",)], "n string")
    assert [tuple(r) for r in df.select(text.hidden("n"), text.unhidden("n")).collect()] == [(".a.jpg", "a.jpg"), ("..a.jpg", ".a.jpg"), (".b", "b")]
