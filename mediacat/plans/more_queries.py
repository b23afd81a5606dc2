"""Queries of suggestions for everybody, streamed bursts, folder aliases, face alignment, and rules with exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import imaging, kinds
from ..operators import changes, folders, scan, sequences, suggest, textindex
from ..sources import archives, sinks
from ..sources.catalog import EXCLUDED, INCLUDED, NOMEDIA, PINNED, ROOT, Catalog
from ..sources.store import Store, stored
from ..streaming import bursts, ingest
from ..work import work_dir, written
from .catalog_queries import SQL, _sub_centroids_sql, listed, query

# ---------------------------------------------------------------- faces

_GOOD = "score >= 0.5 AND bbox_right - bbox_left >= 15"
_VECTORS = _sub_centroids_sql(f"""SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY k, id) AS i, e FROM (SELECT a.person_id, 0 AS k, f.id, f.embedding::double[] AS e FROM faces f JOIN assignments a ON f.id = a.face_id
    WHERE {_GOOD} UNION ALL SELECT person_id, 1, id, embedding::double[] FROM anchors)""")
query(
    "V4_all_persons",
    f"""WITH c AS (SELECT id, embedding::double[] AS e FROM faces WHERE {_GOOD} AND id NOT IN (SELECT face_id FROM assignments) AND id NOT IN (SELECT face_id FROM ignored)), v AS ({_VECTORS}),
    s AS (SELECT person_id, id, round(max(list_dot_product(e, v.c)), 5) AS similarity FROM c, v WHERE NOT EXISTS (SELECT 1 FROM cannot_links x WHERE x.face_id = c.id AND x.person_id = v.person_id) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.1) SELECT person_id, id, similarity, rank::int AS rank FROM r WHERE rank <= 300""",
)(lambda c: suggest.suggestions(c.faces, c.assignments, c.ignored, c.cannot_links, c.anchors, least=0.1))

_SUMS = ", ".join(f"(s[{i}] - sx) AS u{i}, (s[{i + 1}] - sy) AS v{i}, (d[{i}] - dx) AS p{i}, (d[{i + 1}] - dy) AS q{i}" for i in (1, 3, 5, 7, 9))
_ALONG, _ACROSS, _SPREAD = (" + ".join(t.format(i=i) for i in (1, 3, 5, 7, 9)) for t in ("u{i} * p{i} + v{i} * q{i}", "u{i} * q{i} - v{i} * p{i}", "u{i} * u{i} + v{i} * v{i}"))
query(
    "M6_alignment",
    f"""WITH m AS (SELECT vec_id, embedding[1:10]::double[] AS s, embedding[11:20]::double[] AS d FROM embeddings), c AS (SELECT *, (s[1]+s[3]+s[5]+s[7]+s[9]) / 5 AS sx, (s[2]+s[4]+s[6]+s[8]+s[10]) / 5 AS sy, (d[1]+d[3]+d[5]+d[7]+d[9]) / 5 AS dx, (d[2]+d[4]+d[6]+d[8]+d[10]) / 5 AS dy FROM m),
    k AS (SELECT *, {_SUMS} FROM c), f AS (SELECT *, ({_ALONG}) / ({_SPREAD}) AS a, ({_ACROSS}) / ({_SPREAD}) AS b FROM k)
    SELECT vec_id, round(a, 5) AS a, round(b, 5) AS b, round(dx - (a * sx - b * sy), 5) AS tx, round(dy - (b * sx + a * sy), 5) AS ty FROM f""",
)(
    lambda c: c.read("embeddings")
    .select("vec_id", F.slice("embedding", 1, 10).alias("s"), F.slice("embedding", 11, 10).alias("d"))
    .select("vec_id", imaging.similarity_matrix("s", "d").alias("m"))
    .select("vec_id", *[F.round(f"m.{x}", 5).alias(x) for x in ("a", "b", "tx", "ty")])
)

# ---------------------------------------------------------------- streams


def _streamed_bursts(c: Catalog) -> DataFrame:
    """Images come three times, by time, each in files of a bounded number of rows, which the stream takes as a batch."""
    images = written(listed(c).where("type = 1").select("id", "parent_path", "date_taken"), "burst-images")
    store = bursts.burst_store(Store(c.spark, work_dir(c.spark, "burst-store")))
    come = work_dir(c.spark, "burst-files")
    files = ingest.files_for(images)
    low, high = images.approxQuantile("date_taken", [0.34, 0.67], 0.01)
    check = work_dir(c.spark, "burst-check")
    for part in (F.col("date_taken") <= low, (F.col("date_taken") > low) & (F.col("date_taken") <= high), F.col("date_taken") > high):
        images.where(part).repartition(files, "id").write.mode("append").parquet(come)
        source = c.spark.readStream.schema(images.schema).parquet(come)
        bursts.burst_stream(source, store, check, delay_ms=0, gap_ms=60_000).awaitTermination()
    with store.change() as change:
        bursts.advance(change, None, 0, gap_ms=60_000, to_end=True)
    return store.read("bursts").select("first_id", "n", "folder", "first_taken", "last_taken")


query("W1_streamed_bursts")(_streamed_bursts)
SQL["W1_streamed_bursts"] = SQL["W1_burst_groups"]

# ---------------------------------------------------------------- folders

#: Folders that stand for others: /sdcard for the root, and an old name of a folder below it, in two steps.
_ALIASES = (("/sdcard", ROOT.rstrip("/")), ("/sdcard0", "/sdcard"), (f"{ROOT}Camera", f"{ROOT}DCIM/Camera"), ("/loop", "/loop/again"))


def _aliased(c: Catalog) -> tuple[DataFrame, DataFrame]:
    real = c.media.select(F.col("parent_path").alias("path")).distinct()
    below = F.expr(f"substring(path, {len(ROOT)})")
    rows = real.select("path", F.lit(1).alias("ord")).unionByName(real.select(F.concat(F.lit("/sdcard0"), below).alias("path"), F.lit(0).alias("ord")))
    rows = rows.unionByName(real.where("path like '%DCIM/Camera/%'").select(F.regexp_replace("path", "DCIM/Camera", "CAMERA").alias("path"), F.lit(2).alias("ord")))
    rows = rows.unionByName(real.where("path like '%DCIM/Camera/%'").select(F.regexp_replace("path", "DCIM/Camera", "Camera").alias("path"), F.lit(3).alias("ord")))
    return rows, c.spark.createDataFrame(_ALIASES, "path string, target string")


query(
    "F18_real_folders",
    f"""WITH r AS (SELECT DISTINCT parent_path AS path FROM media), a AS (SELECT path, path AS real, 1 AS ord FROM r UNION ALL SELECT '/sdcard0' || substr(path, {len(ROOT)}), path, 0 FROM r
    UNION ALL SELECT replace(path, 'DCIM/Camera', 'CAMERA'), replace(path, 'DCIM/Camera', 'CAMERA'), 2 FROM r WHERE contains(path, 'DCIM/Camera/') UNION ALL SELECT replace(path, 'DCIM/Camera', 'Camera'), path, 3 FROM r WHERE contains(path, 'DCIM/Camera/'))
    SELECT path, ord FROM (SELECT *, row_number() OVER (PARTITION BY lower(real) ORDER BY ord) AS n FROM a) WHERE n = 1""",
)(lambda c: folders.distinct_real_folders(*_aliased(c)).select("path", "ord"))

_UNDER = "EXISTS (SELECT 1 FROM {t} x WHERE lower(f.path) || '/' LIKE lower(x.path) || '/%')"
# folders named after an image are a burst's if a file in them says so
_FOLDERS = "SELECT DISTINCT parent_path AS path, false AS burst FROM media UNION ALL SELECT parent_path || '/IMG_' || id, id % 2 = 0 FROM media WHERE id % 10 = 1 UNION ALL SELECT parent_path || '/.' || id, false FROM media WHERE id % 10 = 2"


def _with_bursts(c: Catalog) -> tuple[DataFrame, DataFrame]:
    own = c.media.where("id % 10 = 1").select(F.concat("parent_path", F.lit("/IMG_"), F.col("id").cast("string")).alias("path"), "id")
    dotted = c.media.where("id % 10 = 2").select(F.concat("parent_path", F.lit("/."), F.col("id").cast("string")).alias("path"))
    return c.media.select(F.col("parent_path").alias("path")).distinct().unionByName(own.select("path")).unionByName(dotted), own.where("id % 2 = 0").select("path")


def _visible(c: Catalog, show_hidden: bool) -> DataFrame:
    paths, in_bursts = _with_bursts(c)
    return folders.visibility(paths, c.rows(INCLUDED, "path"), c.rows(EXCLUDED, "path"), c.rows(NOMEDIA, "path"), in_bursts, show_hidden)


query(
    "F10_bursts_and_dots",
    f"""SELECT path, CASE WHEN burst THEN false WHEN regexp_extract(path, '[^/]*$') LIKE '.%' THEN false WHEN path IN (SELECT path FROM included) THEN true WHEN path IN (SELECT path FROM nomedia) THEN false
    WHEN path IN (SELECT path FROM excluded) THEN false WHEN {_UNDER.format(t="included")} THEN true WHEN {_UNDER.format(t="excluded")} THEN false WHEN path LIKE '%/.%' OR {_UNDER.format(t="nomedia")} THEN false ELSE true END AS visible FROM ({_FOLDERS}) f""",
)(lambda c: _visible(c, False))
query(
    "F10_show_hidden",
    f"""SELECT path, CASE WHEN burst THEN false WHEN path IN (SELECT path FROM included) THEN true WHEN path IN (SELECT path FROM excluded) THEN false WHEN {_UNDER.format(t="included")} THEN true WHEN {_UNDER.format(t="excluded")} THEN false ELSE true END AS visible FROM ({_FOLDERS}) f""",
)(lambda c: _visible(c, True))


def _covered(c: Catalog) -> DataFrame:
    """Covers named for every folder: a file that is there, then one that is not; and for two, a later one that is there."""
    last = c.media.groupBy(F.col("parent_path").alias("path")).agg(F.max("full_path").alias("tmb"), F.min("full_path").alias("other"))
    covers = last.select("path", "tmb", F.lit(1).alias("ord")).unionByName(last.select("path", F.concat("tmb", F.lit(".gone")).alias("tmb"), F.lit(2).alias("ord")))
    covers = covers.unionByName(last.join(c.rows(PINNED, "path").select("path"), "path").select("path", F.col("other").alias("tmb"), F.lit(3).alias("ord")))
    return folders.rollup(listed(c), covers=covers, files=c.media).select("path", "thumbnail")


query("J16_covers_that_exist", "SELECT parent_path AS path, CASE WHEN parent_path IN (SELECT path FROM pinned) THEN min(full_path) ELSE max(full_path) END AS thumbnail FROM media WHERE parent_path IN (SELECT path FROM dirs) GROUP BY 1")(_covered)
def _counters(c: Catalog) -> DataFrame:
    """One pass a table, each a row of counts; they meet as rows, not as a product."""
    parts = {
        "faces": c.faces.agg(F.count("*")), "photos_with_faces": c.faces.agg(F.count_distinct("media_full_path")), "processed": c.media.where("type = 1").agg(F.count("*")), "read": c.whole_ocr.agg(F.count("*")), "with_text": c.whole_ocr.agg(F.count_if(F.col("text") != "")),
        "scanned": c.qr.agg(F.count("*")), "with_content": c.qr.agg(F.count_if(F.col("qr_text") != "")), "placed": c.geo.agg(F.count("*")), "geotagged": c.geo.agg(F.count_if("has_geo")), "anchors": c.anchors.agg(F.count("*")),
    }
    rows = None
    for name, part in parts.items():
        own = part.toDF("n").withColumn("name", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


query(
    "A4_index_counters",
    """SELECT (SELECT count(*) FROM faces) AS faces, (SELECT count(DISTINCT media_full_path) FROM faces) AS photos_with_faces, (SELECT count(*) FROM media WHERE type = 1) AS processed, (SELECT count(*) FROM whole_ocr) AS read, (SELECT count_if(text <> '')::bigint FROM whole_ocr) AS with_text,
    (SELECT count(*) FROM qr) AS scanned, (SELECT count_if(qr_text <> '')::bigint FROM qr) AS with_content, (SELECT count(*) FROM geo) AS placed, (SELECT count_if(has_geo)::bigint FROM geo) AS geotagged, (SELECT count(*) FROM anchors) AS anchors""",
)(_counters)
query(
    "O10_shared_ids",
    """WITH r AS (SELECT id // 4 AS id, type, last_modified FROM clean WHERE type IN (1, 2)), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY type = 2, last_modified DESC) AS a, row_number() OVER (PARTITION BY id ORDER BY type = 2 DESC, last_modified) AS z FROM r),
    s AS (SELECT x.id, x.type = 2 AS part, x.last_modified AS m, y.type, y.last_modified FROM f x JOIN f y ON x.id = y.id AND x.a = 1 AND y.z = 1) SELECT id, type, last_modified, row_number() OVER (ORDER BY part, m DESC, id) AS place FROM s""",
)(lambda c: sequences.sync_list(listed(c).withColumn("id", F.floor(F.col("id") / 4))))


def _by_local_day(c: Catalog) -> DataFrame:
    """A day range about each medium's own local day; the session's zone decides what that is."""
    ms = F.col("last_modified")
    return c.media.select("id", kinds.day_start(ms).alias("day"), kinds.in_days(ms + 86_400_000, ms, ms).alias("next_in"), kinds.in_days(ms, ms, ms).alias("self_in"))


query("DT1_local_days", "SELECT id, floor(last_modified / 86400000)::bigint * 86400000 AS day, false AS next_in, true AS self_in FROM media")(_by_local_day)

# ---------------------------------------------------------------- text by index

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _searched(c: Catalog, tokens: list[str], every: bool) -> DataFrame:
    """The whole recognised texts come in two batches, the second of which holds all; the index takes what is new."""
    index = textindex.TextIndex(Store(c.spark, work_dir(c.spark, "text-index")))
    index.add(c.whole_ocr.where("crc32(path) % 2 = 0"))
    index.add(c.whole_ocr)
    return index.search(tokens, every)


query("U1_indexed_any", f"SELECT path FROM whole_ocr WHERE {_FOLDED} LIKE '%license%' OR {_FOLDED} LIKE '%th_the%'")(lambda c: _searched(c, ["License", "th_the"], False))
query("U2_indexed_all", f"SELECT path FROM whole_ocr WHERE {_FOLDED} LIKE '%license%' AND {_FOLDED} LIKE '%th%er%' AND {_FOLDED} LIKE '%z%'")(lambda c: _searched(c, ["LICENSE", "th%er", "z"], True))

# ---------------------------------------------------------------- archives


def _archived(c: Catalog) -> DataFrame:
    """Entries (archive, name, content) of archives of face crops: a page shows the person of its nation, five people make an archive."""
    k = F.col("page_id") % 25
    crops = c.read("pages").select(F.floor(k / 5).cast("string").alias("archive"), k.alias("key"), F.concat(F.lit("crops/"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("content"))
    people = crops.join(c.read("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("person")), "key")
    by_person = people.groupBy("archive", "key", "person").agg(F.array_join(F.transform(F.sort_array(F.collect_list("name")), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",").alias("crops"))
    one = F.concat(F.lit('{"name":" '), "person", F.lit('","folder":"f'), F.col("key").cast("string"), F.lit('","crops":['), "crops", F.lit("]}"))
    manifests = by_person.groupBy("archive").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", one.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    manifests = manifests.select("archive", F.lit("manifest.json").alias("name"), F.concat(F.lit('{"people":['), "t", F.lit("]}")).alias("content"))
    return crops.select("archive", "name", "content").unionByName(manifests)


def _imported(c: Catalog) -> DataFrame:
    """The archives are imported twice; the second time adds nothing."""
    store = stored(c.spark, work_dir(c.spark, "import-store"), {"persons": (c.persons, ("id",))})
    store.create("crops", StructType().add("archive", "string").add("crop", "string").add("person_id", "long").add("digest", "string"), "archive", "crop", "person_id")
    store.create("import_manifests", StructType().add("manifest_hash", "string").add("imported_at", "long").add("person_count", "long"), "manifest_hash")
    written_archives = archives.write_archives(_archived(c), work_dir(c.spark, "archives"))
    at = c.spark.createDataFrame([(r.archive,) for r in written_archives.collect()], "archive string")
    for now in (1, 2):
        with store.change() as change:
            archives.import_people(change, at, now)
    persons = store.read("persons")
    names = persons.select("id", F.col("name").alias("detail"))
    crops = store.read("crops").select(F.lit("crop").alias("kind"), F.col("crop").alias("item"), F.col("person_id").alias("id"), "digest").join(names, "id").select("kind", "item", F.concat_ws(" ", "detail", "digest").alias("value"))
    people = persons.select(F.lit("person"), F.col("id").cast("string"), "name")
    return crops.union(people).union(store.read("import_manifests").select(F.lit("manifest"), "manifest_hash", F.concat_ws(" ", "person_count", "imported_at")))


query(
    "S23_archive_import",
    """WITH c AS (SELECT page_id % 25 // 5 AS archive, page_id % 25 AS key, 'crops/' || page_id AS name, html, n_name AS person FROM pages JOIN nation ON n_nationkey = page_id % 25),
    p AS (SELECT archive, key, person, string_agg('"' || name || '"', ',' ORDER BY name) AS crops FROM c GROUP BY ALL), m AS (SELECT sha256('{"people":[' || string_agg('{"name":" ' || person || '","folder":"f' || key || '","crops":[' || crops || ']}', ',' ORDER BY key) || ']}') AS hash, count(*) AS n FROM p GROUP BY archive),
    s AS (SELECT id, name FROM persons UNION ALL SELECT (SELECT max(id) FROM persons) + row_number() OVER (ORDER BY person), person FROM (SELECT DISTINCT person FROM c) WHERE person NOT IN (SELECT name FROM persons))
    SELECT 'crop' AS kind, name AS item, person || ' ' || sha256(html) AS value FROM c UNION ALL SELECT 'person', id::varchar, name FROM s UNION ALL SELECT 'manifest', hash, n || ' 1' FROM m""",
)(_imported)


# ---------------------------------------------------------------- albums, covers, favourites, caches


query(
    "F17_all_albums",
    """SELECT album, count(*) AS n, sum(size)::bigint AS size FROM (SELECT unnest(list_filter([CASE WHEN type = 2 THEN 'smart_album_videos' END, CASE WHEN type = 4 THEN 'smart_album_gifs' END, CASE WHEN type = 8 THEN 'smart_album_raw' END,
    CASE WHEN full_path ILIKE '%/screenshots%' THEN 'smart_album_screenshots' END, CASE WHEN full_path ILIKE '%/download%' THEN 'smart_album_downloads' END, CASE WHEN full_path ILIKE '%/dcim/camera%' THEN 'smart_album_camera' END], lambda x: x IS NOT NULL)) AS album, size FROM clean) GROUP BY 1""",
)(lambda c: folders.smart_albums(listed(c)).groupBy("album").agg(F.count("*").alias("n"), F.sum("size").alias("size")))


def _covers_as_json(c: Catalog) -> DataFrame:
    """Each folder's cover is stored as a list of one, in a text of its own; some texts are no lists."""
    last = c.media.groupBy(F.col("parent_path").alias("path")).agg(F.max("full_path").alias("tmb"))
    text = F.when(F.length("path") % 5 != 0, F.to_json(F.array(F.struct("path", "tmb")))).otherwise("{broken")
    return folders.rollup(listed(c), covers=folders.parsed_covers(last.select(text.alias("value"))), files=c.media).select("path", "thumbnail")


query(
    "JS1_album_covers",
    """SELECT r.path, CASE WHEN crc.good THEN crc.last ELSE r.thumbnail END AS thumbnail FROM rolled r JOIN (SELECT parent_path AS path, max(full_path) AS last, length(parent_path) % 5 <> 0 AS good FROM media GROUP BY 1) crc USING (path)""",
)(_covers_as_json)


def _favorites_file(c: Catalog) -> DataFrame:
    """The favourites are written as text, a path a line, with lines for files that are not there, and read as another catalog's."""
    at = work_dir(c.spark, "favorites-text")
    lines = sinks.favorites_lines(c.favorites)
    sinks.write_lines(lines.unionByName(lines.select(F.concat("value", F.lit(".gone")).alias("value"))).unionByName(lines.where("crc32(value) % 3 = 0")), at)
    return scan.imported_favorites(c.spark, at, c.media)


query("S24_favorites_file", "SELECT full_path, filename, parent_path FROM favorites")(_favorites_file)


def _caches(c: Catalog) -> DataFrame:
    """Caches of an older state: every eleventh medium is missing, every seventh has another size, and files and folders that are gone."""
    fresh = written(listed(c).select("id", "full_path", "parent_path", "size", "type", "last_modified", "date_taken"), "fresh")
    over = written(folders.rollup(fresh), "over")
    old = fresh.where("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("size")).cast("long"))
    old = old.unionByName(fresh.where("id % 13 = 0").withColumn("full_path", F.concat("full_path", F.lit(".gone"))))
    gone = over.withColumn("path", F.concat("path", F.lit("/gone")))
    store = stored(c.spark, work_dir(c.spark, "caches"), {"media": (old, ("full_path",)), "directories": (over.where("media_count % 2 = 0").unionByName(gone), ("path",))})
    with store.change() as change:
        changes.write_back(change, "media", fresh)
        changes.write_back(change, "directories", over)
    media = store.read("media").select(F.lit("media").alias("kind"), F.col("full_path").alias("path"), "size")
    return media.unionByName(store.read("directories").select(F.lit("directories").alias("kind"), "path", "size"))


query("Z6_caches_written", "SELECT 'media' AS kind, full_path AS path, size FROM clean UNION ALL SELECT 'directories', path, size FROM dirs")(_caches)
