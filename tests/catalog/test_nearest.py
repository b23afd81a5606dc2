import numpy as np

from mediacat.operators import people


def test_many_vectors_are_multiplied_not_looped(spark, monkeypatch):
    """The nearest of vectors of several lengths, with nulls; no expression walks the numbers one by one."""
    draw = np.random.default_rng(3)
    faces = [(i, [float(x) for x in draw.normal(size=8 if i % 5 else 3)]) for i in range(60)] + [(60, None), (61, [1.0] * 7 + [None])]
    vectors = [[float(x) for x in draw.normal(size=8 if i % 4 else 3)] for i in range(30)]
    df = spark.createDataFrame(faces, "id long, embedding array<double>")
    want = {i: max([0.0, *(float(np.dot(f, v)) for v in vectors if f and None not in f and len(v) == len(f))]) for i, f in faces}
    for block in (4096, 7):
        monkeypatch.setattr(people, "CENTROID_BLOCK", block)
        out = people.best_similarity(df, spark.createDataFrame([(v,) for v in vectors], "vector array<double>"))
        got = {r.id: r.similarity for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        assert "MapInArrow" in out._jdf.queryExecution().toString()
    none = people.best_similarity(df, spark.createDataFrame([], "vector array<double>"))
    assert {r.similarity for r in none.collect()} == {None}
