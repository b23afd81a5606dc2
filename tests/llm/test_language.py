import numpy as np
from pyspark.sql import functions as F

from mediacat.llm import language, registry


def test_codewords_are_far_apart():
    for k in range(1, 20):
        c = language.codebook(k)
        assert len(c) == k and all((c[i] != c[j]).sum() >= max(1, c.shape[1] // 3) for i in range(k) for j in range(i))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_edge_rows(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 $$ ---", "de", "x"), (None, "und die", None, "x"), (103, "the and " * 200_000, None, "x"), (103, "the", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "de"), (103, "en"), (0, "en"), (1, "de")} <= got
    assert language.predict(docs, model).count() == len(rows)
    none = language.fit(docs, F.lit(False))
    assert none is None and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "aa bb", "en"), (2, "cc", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()} == {"en"}


def test_features_do_not_cross_texts():
    import pyarrow as pa

    both = language.features(pa.array(["ab cd", None, "xyz"]))
    assert np.allclose(both[0], language.features(pa.array(["ab cd"]))[0]) and np.allclose(both[2], language.features(pa.array(["xyz"]))[0]) and not both[1].any()
