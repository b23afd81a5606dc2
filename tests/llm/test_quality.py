import numpy as np
from pyspark.sql import functions as F

from mediacat.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    model = quality.fit(docs, labels.where(~held))
    assert model.exchanged > 100
    got = quality.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert got.score.between(0, 1).all()
    print("accuracy", (got.kept == good).mean(), "clean kept", got.kept[good].mean(), "bad caught", (~got.kept[~good]).mean(), "toxic", (~got.kept[got.toxic == 1]).mean(), "n", len(got))
    assert got.kept[good].mean() > 0.95 and (~got.kept[~good]).mean() > 0.8


def test_edge_rows(spark):
    rows = [(i, ("good fine words " if i % 2 else "$$$ ### junk ") * 5, None, "s", "c") for i in range(40)]
    rows += [(100, None, "en", None, "c"), (101, "", None, "s", "c"), (None, "good words", None, None, "c"), (102, "word " * 300_000, "en", "s", "c"), (1, "good fine words", None, "s", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0, "c") for i in range(30)] + [(31, None, 1, "c"), (None, 1, 0, "c"), (1, 1, None, "c"), (999, 1, 0, "c")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.kept for r in got}
    assert all(by[i] == (i % 2 == 1) for i in range(2, 40))
    assert quality.fit(docs, labels.limit(0)) is None and all(r.kept for r in quality.score(docs, None).collect())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs.drop("lang", "source"), model).count() == len(rows)


def test_sparse_rows():
    x = quality.Sets.of([np.array([1, 5]), np.array([], int), np.array([5])])
    w = np.zeros(quality.WORDS)
    w[[1, 5]] = 2, 3
    assert x.dot(w).tolist() == [5, 0, 3] and x.back(np.array([1.0, 7, 2]))[[1, 5]].tolist() == [1, 3]
    assert x.rows(np.array([2])).columns.tolist() == [5]
