"""Small tables for rules that are easy to get wrong."""

import json

from pyspark.sql import functions as F

from mediacat.functions import kinds, text
from mediacat.work import setting
from mediacat.operators import folders, mutate, people, scan, sequences
from mediacat.sources import sinks


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def test_folding_is_ascii_only_where_stored_text_is_compared(spark):
    rows = spark.createDataFrame([("Á",), ("á",), ("A",), (None,)], "x string").select(text.ascii_fold("x").alias("x"))
    assert [r.x for r in rows.collect()] == ["Á", "á", "a", None]


def test_wildcards_in_stored_text_search_but_not_in_name_search(spark):
    t = spark.createDataFrame([(1, "50% off"), (2, "50 x off"), (3, None)], "id int, text string")
    assert {r.id for r in people.text_search(t, ["50%off"], True).collect()} == {1, 2}
    assert people.text_search(t, [], True).count() == 0
    n = t.withColumnRenamed("text", "filename")
    assert {(r.id, r["rank"]) for r in sequences.searched(n, "50%").collect()} == {(1, 0)}


def test_empty_token_lists(spark):
    names = spark.createDataFrame([("p1", "Ann"), ("p2", "Bob"), ("p1", "Bob")], "media_full_path string, name string")
    got = lambda t, every: {r.media_full_path for r in people.photos_with(names, t, every).collect()}
    assert got([], True) == {"p1", "p2"} and got([], False) == set()
    assert got(["ann", "bo"], True) == {"p1"} and got(["ann", "bo"], False) == {"p1", "p2"} and got(["%"], False) == set()


def test_visibility_rules_in_order(spark):
    f = paths(spark, "", "/a/.h", "/a/IMG_1", "/inc", "/INC", "/inc/x", "/exc", "/exc/x", "/excx", "/m", "/m/x", "/b/.c/d", "/ok", "/m/inc")
    got = {r.path: r.visible for r in folders.visibility(f, paths(spark, "/inc", "/m/inc"), paths(spark, "/exc"), paths(spark, "/m", "/inc"), bursts=paths(spark, "/a/IMG_1")).collect()}
    assert got == {"": False, "/a/.h": False, "/a/IMG_1": False, "/inc": True, "/INC": True, "/inc/x": True, "/exc": False, "/exc/x": False, "/excx": True, "/m": False, "/m/x": False, "/b/.c/d": False, "/ok": True, "/m/inc": True}
    shown = {r.path: r.visible for r in folders.visibility(f, paths(spark), paths(spark, "/exc"), paths(spark, "/m"), show_hidden=True).collect()}
    assert shown["/a/.h"] and shown["/m"] and not shown["/exc"] and not shown["/exc/x"] and shown["/b/.c/d"]


def test_bursts_are_broken_by_other_folders_and_cross_buckets(spark):
    rows = [(1, "A", 1000), (2, "A", 2000), (3, "B", 3000), (4, "A", 4000), (5, "A", 7000), (6, "A", 10001), (7, "A", 0), (8, "A", 0), (9, "A", 13001), (10, "A", 16000)]
    df = spark.createDataFrame(rows, "id long, parent_path string, date_taken long")
    for ranges in ("1", "3", "10"):
        with setting(spark, "spark.sql.shuffle.partitions", ranges), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            got = {(r.first_id, r.n) for r in sequences.bursts(df, 3000).collect()}
        assert got == {(1, 2), (4, 2), (6, 3)}, ranges
    assert sequences.bursts(df.limit(0)).count() == 0


def test_folder_times_come_from_first_and_last_item(spark):
    rows = [(1, "/a", "/a/1", 5, 30, 1, 1), (2, "/a", "/a/2", 99, 20, 1, 2), (3, "/a", "/a/3", 7, 10, 1, 1)]
    df = spark.createDataFrame(rows, "id long, parent_path string, full_path string, last_modified long, date_taken long, size long, type int")
    (r,) = folders.rollup(df).collect()
    assert (r.last_modified, r.date_taken, r.thumbnail, r.media_types) == (7, 30, "/a/1", 3)
    (r,) = folders.rollup(df, descending=False, with_size=False).collect()
    assert (r.last_modified, r.date_taken, r.thumbnail, r.size) == (5, 10, "/a/3", 0)


def test_prefix_with_and_without_boundary(spark):
    assert {r.path for r in scan.below(paths(spark, "/a/b", "/a/bc", "/A/B/x"), paths(spark, "/a/b")).collect()} == {"/a/b", "/A/B/x"}
    got = {(r.child, r.parent) for r in folders.longest_prefix(paths(spark, "/a/b", "/a/bc", "/z"), paths(spark, "/a/b", "/a")).collect()}
    assert got == {("/a/b", "/a/b"), ("/a/bc", "/a/b")}


def test_ties(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 9, "y")], "id long, size long, filename string").withColumn("score", F.col("size"))
    assert [r.id for r in sequences.sorted_media(df, "size", True).collect()] == [3, 1, 2]
    assert [r.id for r in sequences.sorted_faces(df, "score", True).collect()] == [3, 2, 1]


def test_group_setting_keeps_the_none_bit(spark):
    df = spark.createDataFrame([(32,), (1056,), (2080,), (4,)], "f int")
    assert [r[0] for r in df.select(sequences.group_setting(F.col("f"), False)).collect()] == [-1, 1023, 2047, 4]
    assert [r[0] for r in df.select(sequences.group_setting(F.col("f"), True)).collect()] == [32, 1056, 2080, 4]


def test_map_cells_floor_below_zero(spark):
    geo = spark.createDataFrame([("a", -0.1, -0.1, True), ("b", 0.1, 0.1, True), ("c", 1.0, 1.0, False)], "path string, lat double, lon double, has_geo boolean")
    assert {(r.gx, r.gy, r.n) for r in people.grid_clusters(geo, 3).collect()} == {(-1, -1, 1), (0, 0, 1)}
    assert people.bounding_box(geo.where("path = 'a'")).first().one_point


def test_two_type_cascades(spark):
    df = spark.createDataFrame([("a.JPG",), ("b.xyz",), ("c",), ("d.mp4",), ("e.Svg",)], "n string")
    assert [tuple(r) for r in df.select(kinds.type_of("n"), kinds.type_of_added("n")).collect()] == [(1, 1), (0, 1), (0, 1), (2, 2), (16, 16)]


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("a",), ("B2",), ("a9b",)], "n string")
    assert [r.n for r in df.orderBy(text.natural_key("n")).collect()] == ["a", "a9", "a9b", "a10", "B2"]


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, ord int")
    once = mutate.upsert(old, new, "k")
    assert {tuple(r) for r in once.collect()} == {("a", 1, "x"), ("b", 4, None), ("c", 5, None)} == {tuple(r) for r in mutate.upsert(once, new, "k").collect()}


def test_rekeying_deletes_the_row_in_the_way(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    changes = spark.createDataFrame([("a", "b")], "old_key string, new_key string")
    assert {tuple(r) for r in mutate.rekeyed(rows, "k", changes).collect()} == {("b", 1), ("c", 3)}


def test_new_ids_are_dense(spark):
    old = spark.createDataFrame([(7, "z")], "id long, name string")
    new = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "name string").repartition(5)
    got = sorted((r.id, r.name) for r in mutate.inserted(old, new, "name").collect())
    assert [g[0] for g in got] == list(range(7, 58)) and [g[1] for g in got[1:]] == [f"n{i:03d}" for i in range(50)]
    assert mutate.inserted(old, new.limit(0), "name").count() == 1


def test_bin_and_back(spark):
    m = spark.createDataFrame([("/a/x", "/a", 0, "x"), ("/a/y", "/a", 5, "y")], "full_path string, parent_path string, deleted_ts long, filename string")
    gone = mutate.to_bin(m, F.col("filename") == "x", 9)
    assert {tuple(r)[:3] for r in gone.collect()} == {("recycle_bin/a/x", "/a", 9), ("/a/y", "/a", 5)}
    assert {tuple(r)[:3] for r in mutate.from_bin(gone, F.col("filename") == "x").collect()} == {("/a/x", "/a", 0), ("/a/y", "/a", 5)}
    assert mutate.without_expired(gone, 100, 92).count() == 1


def test_greedy_sub_centroids(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 2, [0.0, 1.0]), (2, 0, [0.6, 0.8]), (1, 3, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "person_id long, ord long, embedding array<double>").repartition(3)
    assert sorted((r.person_id, r.cluster, r.n) for r in people.sub_centroids(df).select("person_id", "cluster", "n").collect()) == [(1, 0, 2), (1, 1, 2), (2, 0, 1)]


def test_similarity_in_blocks(spark, monkeypatch):
    faces = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0])], "id long, embedding array<double>")
    vectors = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([0.8, 0.6],)], "vector array<double>")
    whole = {r.id: round(r.similarity, 9) for r in people.best_similarity(faces, vectors).collect()}
    monkeypatch.setattr(people, "CENTROID_BLOCK", 1)
    assert whole == {r.id: round(r.similarity, 9) for r in people.best_similarity(faces, vectors).collect()} == {1: 1.0, 2: 0.96, 3: 0.0}


def test_imports_and_exports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"people": [{"name": "Ann", "folder": "f", "crops": ["1", "2"]}, {"name": "Bob", "folder": "g", "crops": []}]}))
    assert {tuple(r) for r in scan.manifest_people(spark, str(tmp_path / "m.json")).collect()} == {("Ann", "f", "1"), ("Ann", "f", "2")}
    m = spark.createDataFrame([(1, "/a", "x&<y.jpg", "/a/x&<y.jpg", 3, 4), (2, "/a", "z.mp4", "/a/z.mp4", 5, 6)], "id long, parent_path string, filename string, full_path string, size long, last_modified long")
    sinks.write_lines(m.select("full_path"), str(tmp_path / "fav"))
    assert scan.imported_favorites(spark, str(tmp_path / "fav"), m.where("id = 2")).first().full_path == "/a/z.mp4"
    assert json.loads(sinks.listing_json(m.where("id = 2")).first().value) == {"id": 2, "relpath": "/a", "name": "z.mp4", "size": 5, "mtime": 6, "bucket": "a", "mime": "video/mp4"}
    assert [r.value for r in sinks.index_html(m, 1).collect()] == ['<li><a href="/api/file?id=2">z.mp4</a></li>'] and "x&amp;&lt;y" in sinks.index_html(m).collect()[1].value
    new = m.where("id = 2").withColumn("id", F.lit(9).cast("long"))
    assert {r.full_path for r in sinks.appended(m, new).collect()} == {"/a/x&<y.jpg", "/a/z.mp4", "/a/z_1.mp4"}


def test_capture_times(spark):
    from mediacat.functions import imaging

    rows = ["2015-07-26T14:55:23", "2018:09:05 15:09:05", "2018:09:05 24:00:01", "2018:13:05 01:00:00", "rubbish", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(imaging.capture_ms("t")).collect()] == [1437922523000, 1536160145000, 1536105601000, None, None, None, None]


def test_sample_factor_and_sharpness(spark):
    from mediacat.functions import imaging

    df = spark.createDataFrame([(100, 100), (2049, 10), (2050, 10), (0, 5), (4100, 9000)], "w int, h int")
    assert [r[0] for r in df.select(imaging.sample_factor("w", "h", 1024)).collect()] == [1, 2, 4 if 2050 // 2 > 1024 else 2, None, 16 if 9000 // 8 > 1024 else 8]
    images = spark.createDataFrame([(1, 3, [0, 0, 0, 0, 9, 0, 0, 0, 0]), (2, 2, [1, 2, 3, 4]), (3, None, None), (4, 4, [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0])], "id long, width int, gray array<int>")
    assert {r.id: r.sharpness for r in imaging.sharpness(images).collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 6.25}


def test_null_keys_are_like_no_other(spark):
    old = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    new = spark.createDataFrame([(None, 3), (None, 4), ("a", 5)], "k string, v int")
    assert sorted(map(tuple, mutate.upsert(old, new, "k").collect()), key=str) == sorted([(None, 1), (None, 3), (None, 4), ("a", 5)], key=str)


def test_restored_rows_get_free_names(spark):
    rows = [("recycle_bin/a/x.jpg", 5, 1), ("/a/x.jpg", 0, 2), ("/a/x_1.jpg", 0, 3), ("recycle_bin/a/x_2.jpg", 6, 4), ("recycle_bin/a/y", 7, 5), ("/a.b/y", 0, 6), ("recycle_bin/a.b/y", 8, 7)]
    m = spark.createDataFrame(rows, "full_path string, deleted_ts long, id int")
    got = {r.id: r.full_path for r in mutate.from_bin(m, F.lit(True)).collect()}
    assert got == {1: "/a/x_3.jpg", 2: "/a/x.jpg", 3: "/a/x_1.jpg", 4: "/a/x_2.jpg", 5: "/a/y", 6: "/a.b/y", 7: "/a.b/y_1"}
    new = spark.createDataFrame([(1, "/a/n.png"), (2, "/a/n.png"), (3, "/a/n_1.png")], "id int, full_path string")
    assert {r.id: r.full_path for r in mutate.freed(new, new.limit(0)).collect()} == {1: "/a/n.png", 2: "/a/n_2.png", 3: "/a/n_1.png"}


def test_folder_listings(spark):
    names = [("/f", "a.jpg", 0), ("/f", ".h.jpg", 0), ("/f", "b.mp4", 0), ("/f", "gone.jpg", 9), ("/f/IMG_1", "00.jpg", 0), ("/f/IMG_1", "01_Cover.jpg", 0), ("/f/img_2", "z.jpg", 0), ("/f/other", "q.jpg", 0), ("/.p", "fav.jpg", 0)]
    rows = [(i, p, n, f"{p}/{n}", d, 1, 5, 6, 2 if n.endswith("mp4") else 1) for i, (p, n, d) in enumerate(names)]
    m = spark.createDataFrame(rows, "id int, parent_path string, filename string, full_path string, deleted_ts long, size long, date_taken long, last_modified long, type int")
    taken = spark.createDataFrame([], "full_path string, date_taken long")
    fav = m.where("id in (0, 8)").select("full_path")
    got = lambda folder, mask=63, **k: {(r.filename, r.type) for r in scan.folder_listing(m, taken, fav, folder, mask, **k).collect()}
    assert got("/f") == {("a.jpg", 1), ("b.mp4", 2), ("01_Cover.jpg", 32), ("z.jpg", 32)} and got("/f", 31) == {("a.jpg", 1), ("b.mp4", 2)}
    assert got(scan.FAVORITES) == {("a.jpg", 1)} and got(scan.FAVORITES, show_hidden=True) == {("a.jpg", 1), ("fav.jpg", 1)}
    assert got(scan.RECYCLE_BIN) == {("gone.jpg", 1)}


def test_manifest_names_are_trimmed_or_skipped(spark):
    m = spark.createDataFrame([('{"people": [{"name": " Ann ", "folder": "f", "crops": ["1"]}, {"name": " ", "folder": "f", "crops": ["2"]}, {"name": "Bo", "folder": "", "crops": ["3"]}, {"name": "Cy", "folder": "g"}]}',), ("rubbish",), (None,)], "value string")
    assert [tuple(r) for r in scan.manifest_crops(m).collect()] == [("Ann", "f", "1")]
    persons = spark.createDataFrame([(4, "Ann")], "id long, name string")
    more = spark.createDataFrame([("h", " Ann", "f"), ("h", "Bo ", "f"), ("h", "Bo", "g"), ("old", "Cy", "f")], "hash string, name string, folder string")
    known = spark.createDataFrame([("old",)], "hash string")
    once = mutate.imported_people(persons, more, known)
    assert sorted(map(tuple, once.collect())) == [(4, "Ann"), (5, "Bo")] == sorted(map(tuple, mutate.imported_people(once, more, known).collect()))


def test_vector_bytes_round_trip(spark):
    import struct

    from mediacat.functions import imaging

    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>").select("v", imaging.vector_bytes("v").alias("b"))
    rows = df.select("v", "b", imaging.vector_floats("b").alias("w")).collect()
    assert bytes(rows[0].b) == struct.pack("<2f", 1.5, -2.0) and [r.w for r in rows] == [r.v for r in rows]


def test_sections_of_few_keys(spark):
    rows = spark.range(0, 300, 1, 5).select("id", (F.col("id") % 7).cast("long").alias("date_taken"), (F.col("id") % 2).cast("int").alias("type"))
    got = {(r.id, r.section_key, r.grid_position, r.section_count) for r in sequences.sections(rows, "type").collect()}
    want = set()
    for k in (0, 1):
        own = sorted((r for r in rows.collect() if r.type == k), key=lambda r: (-r.date_taken, r.id))
        want |= {(r.id, str(k), i, len(own)) for i, r in enumerate(own)}
    assert got == want and sequences.sections(rows.limit(0), "type").count() == 0
