import random

import pytest
from pyspark.sql import functions as F

from mediacat.operators import people, textindex
from mediacat.sources.store import Store

WORDS = ["License", "the", "THE other", "a%b", "x_y", "Été", "日本語", "one\ntwo", "aaa", "end", "a\\b", "ab", "ba", ".", "  "]
QUERIES = [["License"], ["th"], ["t"], ["T%e"], ["%"], ["a%b%"], ["日本"], ["É"], ["nowhere"], ["license", "the"], ["e_d"], [], ["a\\b"]]


def made_up(draw, n):
    return [(f"/ocr/{i}", "".join(draw.choice(WORDS) + draw.choice(["", " ", "-"]) for _ in range(draw.choice([0, 1, 5, 60])))) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    draw = random.Random(8)
    rows = made_up(draw, 150)
    old = textindex.BLOCK_BYTES
    index = textindex.TextIndex(Store(spark, f"file://{tmp_path_factory.mktemp('index')}/store"))
    half = spark.createDataFrame([*rows[:70], (None, "the"), ("/null", None)], "path string, text string").repartition(2)
    assert index.add(half) == 70
    first = index.store.bytes(), len(index._batches())
    assert index.add(half) == 0 and len(index._batches()) == first[1]
    assert index.add(spark.createDataFrame(rows[50:], "path string, text string")) == 80 and len(index._batches()) == 2
    assert old == textindex.BLOCK_BYTES
    return index, spark.createDataFrame(rows, "path string, text string").cache()


@pytest.mark.parametrize("every", [True, False])
def test_equals_the_scan(indexed, every):
    index, texts = indexed
    for tokens in QUERIES if every else QUERIES[9:11]:
        want = sorted(r.path for r in people.text_search(texts, tokens, every).select("path").collect())
        assert sorted(r.path for r in index.search(tokens, every).collect()) == want, tokens


def test_one_run_without_wildcards_reads_no_text(indexed):
    index, texts = indexed
    plan = index.search(["license"], True)._jdf.queryExecution().executedPlan().toString()
    assert "text-copies" not in plan
    wanted = index.candidates("th%other")
    share = index.texts().join(wanted, ["block", "doc"], "left_semi").agg(F.sum(F.length("text"))).first()[0] / index.texts().agg(F.sum(F.length("text"))).first()[0]
    assert share < 1 and index._checked(wanted, "th%other").count() == texts.where(F.lower("text").like("%th%other%")).count()


def test_small_blocks(spark, tmp_path):
    rows = made_up(random.Random(9), 40)
    index = textindex.TextIndex(Store(spark, f"file://{tmp_path}/store"))
    assert index.search(["x"], True).count() == 0 and index.add(spark.createDataFrame([], "path string, text string")) == 0
    index.add(spark.createDataFrame(rows, "path string, text string").coalesce(1))
    batches = list(textindex._blocked(iter(spark.createDataFrame(rows, "path string, text string").toArrow().to_batches())))
    assert sum(b.num_rows for b in batches) == 40
    for tokens in (["the"], ["b"]):
        assert index.search(tokens, True).count() == people.text_search(spark.createDataFrame(rows, "path string, text string"), tokens, True).count()
