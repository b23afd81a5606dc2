from pyspark.sql.types import StructType

from mediacat.operators import changes, folders
from mediacat.sources.store import Store


def test_a_medium_may_be_in_several_albums_or_none(spark):
    rows = spark.createDataFrame([(1, "/s/DCIM/Camera/a.mp4", 2), (2, "/s/Download/x.gif", 4), (3, "/s/p/y.jpg", 1), (4, None, 8), (5, "/s/SCREENSHOTS/z.png", None), (6, "/download", 0)], "id long, full_path string, type int")
    got = sorted((r.album.removeprefix("smart_album_"), r.id) for r in folders.smart_albums(rows).collect())
    assert got == [("camera", 1), ("downloads", 2), ("downloads", 6), ("gifs", 2), ("raw", 4), ("screenshots", 5), ("videos", 1)]


def test_covers_of_broken_texts_are_none(spark):
    lines = spark.createDataFrame([('[{"path":"/a","tmb":"/a/1"},{"path":"/a","tmb":"/a/2"},{"path":"/b"}]',), ("{broken",), (None,), ("[]",), ("",)], "value string")
    assert [tuple(r) for r in folders.parsed_covers(lines).orderBy("ord").collect()] == [("/a", "/a/1", 0), ("/a", "/a/2", 1)]


def test_write_back_writes_what_differs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("m", StructType().add("k", "long").add("v", "string"), "k", buckets=1)
    table = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    for fresh in ([(1, "a"), (2, None), (3, "c")], [(1, "a"), (2, None), (4, "d")], [(1, None), (2, "b"), (4, "d")], []):
        with store.change() as change:
            changes.write_back(change, "m", table(*fresh))
        assert sorted(map(tuple, store.read("m").collect()), key=repr) == sorted(fresh, key=repr)
    last = store.snapshot()["tables"]["m"]["segments"]
    with store.change() as change:
        changes.write_back(change, "m", table())
    assert store.snapshot()["tables"]["m"]["segments"] == last
