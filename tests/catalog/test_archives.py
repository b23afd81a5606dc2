import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediacat.sources import archives
from mediacat.sources.store import stored


def store_of(spark, path):
    store = stored(spark, f"file://{path}/store", {"persons": (spark.createDataFrame([(7, "Ann")], "id long, name string"), ("id",))})
    store.create("crops", StructType().add("archive", "string").add("crop", "string").add("person_id", "long").add("digest", "string"), "archive", "crop", "person_id")
    store.create("import_manifests", StructType().add("manifest_hash", "string").add("imported_at", "long").add("person_count", "long"), "manifest_hash")
    return store


def test_what_is_written_is_read_by_many_tasks(spark, tmp_path):
    rows = [(a, f"d/{i}", bytes([i % 256]) * (i * 37 % 5000)) for a in ("x", "y") for i in range(60)] + [("x", "empty", None)]
    at = archives.write_archives(spark.createDataFrame(rows, "archive string, name string, content binary"), f"file://{tmp_path}/zips")
    at = spark.createDataFrame(at.collect(), at.schema)
    with zipfile.ZipFile(f"{tmp_path}/zips/x.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 61
    got = archives.contents(archives.entries(at))
    assert sorted((r.archive.rpartition("/")[2][0], r.name, bytes(r.content)) for r in got.collect()) == sorted((a, n, c or b"") for a, n, c in rows)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_damaged_entries_are_named(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for n in ("one", "two"):
            z.writestr(n, f"content of {n}")
    data = bytearray(path.read_bytes())
    data[data.index(b"content of two")] ^= 1
    path.write_bytes(data)
    got = {r.name: (r.content and bytes(r.content), r.error) for r in archives.contents(archives.entries(spark.createDataFrame([(f"file://{path}",)], "archive string"))).collect()}
    assert got == {"one": (b"content of one", None), "two": (None, "ValueError: checksum")}


def test_an_address_of_an_unknown_kind_fails_before_work(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)filesystem|scheme|protocol"):
        archives.write_archives(spark.createDataFrame([("x", "n", b"1")], "archive string, name string, content binary"), "s3a://bucket/zips")


def test_second_imports_add_nothing(spark, tmp_path):
    manifest = {"people": [{"name": " Ann ", "folder": "f", "crops": ["c/1", "c/none"]}, {"name": "Bea", "folder": "g", "crops": ["c/2"]}, {"name": " ", "folder": "h", "crops": ["c/2"]}, {"name": "Cid", "folder": "", "crops": []}, {"name": "Dan", "folder": "x"}]}
    for name in ("one", "copy"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("manifest.json", json.dumps(manifest))
            z.writestr("c/1", "first")
            z.writestr("c/2", "second")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"people": []}))
    store = store_of(spark, tmp_path)
    seen = []
    for names in (("one", "copy"), ("one",), ("copy", "other"), ("other",)):
        with store.change() as change:
            archives.import_people(change, spark.createDataFrame([(f"file://{tmp_path}/{n}.zip",) for n in names], "archive string"), len(seen))
        seen.append((sorted(map(tuple, store.read("persons").collect())), store.read("crops").count(), store.read("import_manifests").count()))
    assert seen[0] == ([(7, "Ann"), (8, "Bea")], 3, 1) and seen[1] == seen[0] and seen[2] == (seen[0][0], 3, 2) and seen[3] == seen[2]
    crops = {(r.crop, r.person_id): r.digest for r in store.read("crops").collect()}
    assert crops["c/none", 7] is None and crops["c/1", 7] is not None and crops["c/2", 8] != crops["c/1", 7]
