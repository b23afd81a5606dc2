"""Catalog queries by operator id, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging, kinds, text
from ..operators import folders, mutate, people, scan, sequences
from ..sources import sinks
from ..sources.catalog import EXCLUDED, INCLUDED, NOMEDIA, PINNED, PROTECTED, ROOT, Catalog
from ..sources.catalog_sql import sql as with_tables
from ..streaming import ingest
from ..work import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CAMERA = f"{ROOT}DCIM/Camera/click"
NOW = 1_706_745_600_000  # 2024-02-01


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return build

    return register


def also(name: str, of: str) -> None:
    """The same query under a second name."""
    QUERIES[name] = QUERIES[of]
    SQL[name] = SQL[of]


def listed(c: Catalog) -> DataFrame:
    return scan.listing(c.media, c.date_takens)


def dirs(c: Catalog) -> DataFrame:
    return folders.rollup(listed(c))


# ---------------------------------------------------------------- scans

query("S1_media_in_folder", f"SELECT id, full_path FROM media WHERE deleted_ts = 0 AND parent_path = '{CAMERA}'")(lambda c: scan.in_folder(c.media, CAMERA.upper()).select("id", "full_path"))
query("S2_media_of_type", "SELECT id, full_path FROM media WHERE type = 2")(lambda c: c.media.where("type = 2").select("id", "full_path"))
query("S3_favorites", "SELECT id, full_path FROM media WHERE is_favorite AND deleted_ts = 0")(lambda c: c.media.where("is_favorite and deleted_ts = 0").select("id", "full_path"))
query("S4_old_bin_items", f"SELECT id, deleted_ts FROM media WHERE deleted_ts <> 0 AND deleted_ts < {NOW - 15 * 86_400_000}")(lambda c: scan.old_bin_items(c.media, NOW - 15 * 86_400_000).select("id", "deleted_ts"))
query("S5_folder_thumbnail", f"SELECT parent_path AS path, full_path AS thumbnail FROM clean WHERE parent_path = '{CAMERA}' ORDER BY date_taken DESC, id LIMIT 1")(
    lambda c: dirs(c).where(F.col("path") == CAMERA).select("path", "thumbnail")
)
query("S6_capture_times", f"SELECT full_path, date_taken FROM date_takens WHERE parent_path = '{CAMERA}'")(lambda c: c.date_takens.where(text.ascii_fold("parent_path") == CAMERA.lower()).select("full_path", "date_taken"))
query("S7_faces", "SELECT id, media_full_path, face_index FROM faces WHERE embedding IS NOT NULL")(lambda c: c.faces.where("embedding is not null").select("id", "media_full_path", "face_index"))
query("S8_faces_by_ids", "SELECT id, media_full_path FROM faces WHERE id IN (SELECT face_id FROM ignored)")(lambda c: c.faces.join(c.ignored.withColumnRenamed("face_id", "id"), "id", "left_semi").select("id", "media_full_path"))
query("S9_geotagged", "SELECT path, round(lat, 6) AS lat, round(lon, 6) AS lon FROM geo WHERE has_geo")(lambda c: c.geo.where("has_geo").select("path", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")))
query("S10_paths_with_codes", "SELECT path FROM qr WHERE qr_text <> ''")(lambda c: c.qr.where("qr_text <> ''").select("path"))
query("S11_groups_of_person", "SELECT g.id, g.name, count(*) AS n_members FROM groups0 g JOIN members m ON g.id = m.group_id GROUP BY 1, 2")(
    lambda c: c.groups.join(c.members, c.groups["id"] == c.members["group_id"]).groupBy("id", "name").agg(F.count("*").alias("n_members"))
)
query("S12_provider_scan", "SELECT id, parent_path, date_taken, size, type, floor(video_duration / 1e3 + 0.5)::bigint AS seconds FROM clean")(
    lambda c: listed(c).select("id", "parent_path", "date_taken", "size", "type", kinds.seconds_of(F.col("video_duration")).cast("long").alias("seconds"))
)
_FOLDER_SQL = "SELECT m.id, coalesce(d.date_taken, nullif(m.date_taken, 0), m.last_modified) AS date_taken, m.type FROM media m LEFT JOIN date_takens d USING (full_path) WHERE m.deleted_ts = 0 AND m.type <> 0 AND m.size > 0 AND m.filename NOT LIKE '.%'"
query("S13_folder_listing", f"{_FOLDER_SQL} AND m.parent_path = '{CAMERA}'")(lambda c: scan.folder_listing(c.media, c.date_takens, c.favorites, CAMERA, kinds.DEFAULT_MASK | kinds.PORTRAIT).select("id", "date_taken", "type"))
query("S13_favorites_listing", f"{_FOLDER_SQL} AND m.full_path IN (SELECT full_path FROM favorites WHERE full_path NOT LIKE '%/.%')")(lambda c: scan.folder_listing(c.media, c.date_takens, c.favorites, scan.FAVORITES).select("id", "date_taken", "type"))
query("S13_bin_listing", "SELECT id, date_taken, type FROM media WHERE deleted_ts <> 0 AND type <> 0 AND size > 0 AND filename NOT LIKE '.%'")(lambda c: scan.folder_listing(c.media, c.date_takens, c.favorites, scan.RECYCLE_BIN).select("id", "date_taken", "type"))
query("S15_direct_children", f"SELECT full_path, size AS value FROM media WHERE full_path LIKE '{CAMERA}/%' AND full_path NOT LIKE '{CAMERA}/%/%' AND size <> 0")(lambda c: scan.direct_children(c.media, CAMERA, "size"))
query("S16_modified_map", "SELECT full_path, last_modified FROM media WHERE last_modified <> 0")(lambda c: c.media.where("last_modified <> 0").select("full_path", "last_modified"))
query("S17_newest_folders", "SELECT DISTINCT parent_path AS path FROM (SELECT * FROM media ORDER BY id DESC LIMIT 10)")(lambda c: scan.newest_folders(c.media))
query("S18_included_expanded", "SELECT DISTINCT m.parent_path AS path FROM media m JOIN included i ON lower(m.parent_path) || '/' LIKE lower(i.path) || '/%'")(
    lambda c: scan.below(c.media.select(F.col("parent_path").alias("path")).distinct(), c.rows(INCLUDED, "path"))
)
query("S19_folders_with_media", "SELECT DISTINCT parent_path AS path FROM media WHERE type <> 0")(lambda c: c.media.where("type <> 0").select(F.col("parent_path").alias("path")).distinct())
query("S20_marked_folders", "SELECT path, last_modified FROM (SELECT path, ord * 1000 AS last_modified FROM nomedia UNION ALL SELECT parent_path, last_modified FROM media WHERE filename = '.nomedia')")(lambda c: scan.marked_folders(c.files))
query("S21_lookup_by_id", "SELECT id, full_path FROM media WHERE id IN (SELECT face_id FROM ignored)")(lambda c: scan.at_paths(c.media, c.ignored.withColumnRenamed("face_id", "id"), "id").select("id", "full_path"))
query("S22_image_paths", "SELECT full_path FROM media WHERE type = 1 AND deleted_ts = 0")(lambda c: c.media.where("type = 1 and deleted_ts = 0 and full_path is not null").select("full_path"))

query("S26_show_all", "SELECT id, full_path FROM clean c WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE lower(c.parent_path) || '/' LIKE lower(e.path) || '/%') AND parent_path NOT IN (SELECT path FROM protected)")(
    lambda c: scan.show_all(c.media, c.rows(EXCLUDED, "path"), c.rows(PROTECTED, "path")).select("id", "full_path")
)
_PEOPLE = "SELECT CASE WHEN id % 4 = 3 THEN '  ' ELSE ' ' || name || ' ' END AS name, CASE WHEN id % 5 = 4 THEN '' ELSE 'people/' || id END AS folder, face_id FROM persons JOIN assignments ON person_id = id WHERE face_id % 3 = 0"
query("S23_manifest_crops", f"SELECT trim(name) AS name, folder, 'crop' || face_id AS crop FROM ({_PEOPLE}) WHERE trim(name) <> '' AND folder <> ''")(lambda c: scan.manifest_crops(_manifests(c)))
query("S24_imported_favorites", "SELECT full_path, filename, parent_path FROM favorites")(
    lambda c: scan.listed_favorites(c.favorites.select(F.col("full_path").alias("value")).unionByName(c.spark.createDataFrame([("",), ("/no/such.jpg",)], "value string")), c.media)
)


def _manifests(c: Catalog) -> DataFrame:
    """A manifest of each person, as JSON text."""
    crops = c.assignments.where("face_id % 3 = 0").groupBy(F.col("person_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list("face_id")), lambda x: F.concat(F.lit("crop"), x.cast("string"))).alias("crops"))
    name = F.when(F.col("id") % 4 == 3, "  ").otherwise(F.concat(F.lit(" "), "name", F.lit(" ")))
    folder = F.when(F.col("id") % 5 == 4, "").otherwise(F.concat(F.lit("people/"), F.col("id").cast("string")))
    person = F.struct(name.alias("name"), folder.alias("folder"), "crops")
    return c.persons.join(crops, "id").select("id", F.to_json(F.struct(F.array(person).alias("people"))).alias("value"))


# ---------------------------------------------------------------- filters

query(
    "F1_type_cascade",
    "SELECT lower(regexp_extract(filename, '[^.]*$')) AS ext, CASE WHEN lower(regexp_extract(filename, '[^.]*$')) IN ('jpg','jpeg','png','heic') THEN 1 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'mp4' THEN 2 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'gif' THEN 4 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'dng' THEN 8 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'svg' THEN 16 ELSE 0 END AS type, count(*) AS n FROM media GROUP BY 1, 2",
)(lambda c: c.media.groupBy(text.extension_of("filename").alias("ext"), kinds.type_of("filename").alias("type")).agg(F.count("*").alias("n")))
query("F2_type_of_added", "SELECT CASE WHEN lower(regexp_extract(filename, '[^.]*$')) = 'mp4' THEN 2 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'gif' THEN 4 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'dng' THEN 8 WHEN lower(regexp_extract(filename, '[^.]*$')) = 'svg' THEN 16 ELSE 1 END AS type, count(*) AS n FROM media GROUP BY 1")(
    lambda c: c.media.groupBy(kinds.type_of_added("filename").alias("type")).agg(F.count("*").alias("n"))
)
query("F3_type_mask", "SELECT id, type FROM media WHERE (type & 10) <> 0")(lambda c: c.media.where(kinds.has_type(10)).select("id", "type"))
query("F4_folder_mask", "SELECT path, media_types FROM dirs WHERE (media_types & 8) <> 0")(lambda c: dirs(c).where(kinds.has_type(8, "media_types")).select("path", "media_types"))
query("F5_extension_filter", "SELECT id FROM media WHERE lower(filename) LIKE '%.jpg' OR lower(filename) LIKE '%.jpeg'")(lambda c: c.media.where(text.extension_of("filename").isin("jpg", "jpeg")).select("id"))
query("F6_picker_image_only", "SELECT id FROM clean WHERE type <> 2")(lambda c: scan.listing(c.media, c.date_takens, kinds.DEFAULT_MASK & ~kinds.VIDEO).select("id"))
query("F7_hidden_names", "SELECT id FROM media WHERE filename LIKE '.%'")(lambda c: c.media.where(kinds.hidden_name()).select("id"))
query("F8_hidden_paths", "SELECT id FROM media WHERE full_path LIKE '%/.%'")(lambda c: c.media.where(kinds.hidden_path()).select("id"))
query("F9_with_size", "SELECT id FROM media WHERE size > 0")(lambda c: c.media.where("size > 0").select("id"))


def _folder_rules(c: Catalog):
    return c.media.select(F.col("parent_path").alias("path")).distinct(), c.rows(INCLUDED, "path"), c.rows(EXCLUDED, "path"), c.rows(NOMEDIA, "path")


_UNDER = "EXISTS (SELECT 1 FROM {t} x WHERE lower(f.path) || '/' LIKE lower(x.path) || '/%')"
query(
    "F10_folder_visibility",
    f"""SELECT path, CASE WHEN path = '' THEN false WHEN regexp_extract(path, '[^/]*$') LIKE '.%' THEN false WHEN path IN (SELECT path FROM included) THEN true
    WHEN path IN (SELECT path FROM nomedia) THEN false WHEN path IN (SELECT path FROM excluded) THEN false WHEN {_UNDER.format(t="included")} THEN true WHEN {_UNDER.format(t="excluded")} THEN false
    WHEN path LIKE '%/.%' OR {_UNDER.format(t="nomedia")} THEN false ELSE true END AS visible FROM (SELECT DISTINCT parent_path AS path FROM media) f""",
)(lambda c: folders.visibility(*_folder_rules(c)))
query("F11_under_excluded", f"SELECT path FROM (SELECT DISTINCT parent_path AS path FROM media) f WHERE {_UNDER.format(t='excluded')}")(lambda c: scan.below(_folder_rules(c)[0], c.rows(EXCLUDED, "path")))
query(
    "F12_marked_names",
    f"SELECT path, regexp_extract(path, '[^/]*$') || CASE WHEN {_UNDER.format(t='nomedia')} AND NOT {_UNDER.format(t='included')} THEN ' (hidden)' ELSE '' END AS name FROM (SELECT DISTINCT parent_path AS path FROM media) f",
)(lambda c: folders.marked_names(*[_folder_rules(c)[i] for i in (0, 1, 3)]))
query("F13_good_faces", "SELECT id FROM faces WHERE score >= 0.5 AND bbox_right - bbox_left >= 15")(lambda c: people.good_faces(c.faces).select("id"))
query("F14_time_range", "SELECT id, date_taken FROM clean WHERE date_taken BETWEEN 1704844800000 AND 1705449599999")(lambda c: listed(c).where(F.col("date_taken").between(1704844800000, 1705449599999)).select("id", "date_taken"))
query("DT3_day_range", "SELECT id, date_taken FROM clean WHERE make_timestamp(date_taken * 1000)::date BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")(lambda c: listed(c).where(kinds.in_days(F.col("date_taken"), F.lit(1704891234567), F.lit(1705391234567))).select("id", "date_taken"))
query("F15_slideshow", "SELECT id FROM clean WHERE type = 1 OR type = 4")(lambda c: listed(c).where(kinds.has_type(kinds.IMAGE | kinds.PORTRAIT | kinds.GIF)).select("id"))
query("F16_name_search", "SELECT id, CASE WHEN lower(filename) LIKE 'img\\_12%' ESCAPE '\\' THEN 0 ELSE 1 END AS rank FROM media WHERE contains(lower(filename), 'img_12')")(lambda c: sequences.searched(c.media, "IMG_12").select("id", "rank"))
query("F17_smart_albums", "SELECT 'videos' AS album, count(*) AS n FROM clean WHERE type = 2 UNION ALL SELECT 'screenshots', count(*) FROM clean WHERE lower(full_path) LIKE '%screenshots%'")(
    lambda c: listed(c).where("type = 2").agg(F.lit("videos").alias("album"), F.count("*").alias("n")).unionByName(listed(c).where(F.contains(F.lower("full_path"), F.lit("screenshots"))).agg(F.lit("screenshots").alias("album"), F.count("*").alias("n")))
)
query("F18_distinct_folders", "SELECT path FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY ord) AS r FROM (SELECT path, ord FROM included UNION ALL SELECT upper(path), ord + 10 FROM included)) WHERE r = 1")(
    lambda c: folders.distinct_folders(c.rows(INCLUDED, "path").unionByName(c.rows(INCLUDED, "path").select(F.upper("path").alias("path"), F.col("ord") + 10).toDF("path", "ord"))).select("path")
)
query("F19_media_predicates", "SELECT count_if(lower(filename) LIKE '%.heic') AS heic, count_if(lower(filename) LIKE '%.webp') AS webp, count_if(filename LIKE '.%') AS hidden, count_if(deleted_ts <> 0) AS in_bin FROM media")(
    lambda c: c.media.agg(*[F.count_if(x).alias(n) for n, x in (("heic", text.extension_of("filename") == "heic"), ("webp", text.extension_of("filename") == "webp"), ("hidden", kinds.hidden_name()), ("in_bin", F.col("deleted_ts") != 0))])
)
query("F20_stale_paths", "SELECT full_path FROM favorites WHERE full_path NOT IN (SELECT full_path FROM clean)")(lambda c: scan.pending(c.favorites, listed(c)).select("full_path"))
query("F21_hidden_above", f"SELECT path FROM (SELECT DISTINCT parent_path AS path FROM media) f WHERE path LIKE '%/.%' OR {_UNDER.format(t='nomedia')}")(
    lambda c: folders.visibility(_folder_rules(c)[0], c.rows(INCLUDED, "path").limit(0), c.rows(EXCLUDED, "path").limit(0), c.rows(NOMEDIA, "path")).where("not visible").select("path")
)
query("F22_bulk_selection", f"SELECT id, size FROM media WHERE parent_path = '{CAMERA}' AND (type & 31) <> 0 AND filename NOT LIKE '.%'")(lambda c: c.media.where((F.col("parent_path") == CAMERA) & kinds.has_type(31) & ~kinds.hidden_name()).select("id", "size"))

# ---------------------------------------------------------------- joins

query("J1_valid_favorites", "SELECT f.full_path FROM favorites f JOIN media m USING (full_path) WHERE m.deleted_ts = 0")(lambda c: c.favorites.join(c.media.where("deleted_ts = 0"), "full_path", "left_semi").select("full_path"))
query("J2_capture_time", "SELECT m.id, coalesce(d.date_taken, nullif(m.date_taken, 0), m.last_modified) AS date_taken FROM media m LEFT JOIN date_takens d USING (full_path)")(lambda c: scan.with_capture_time(c.media, c.date_takens).select("id", "date_taken"))
query("J3_favorite_flag", "SELECT id, full_path IN (SELECT full_path FROM favorites) AS favorite FROM media")(
    lambda c: c.media.join(c.favorites.select("full_path", F.lit(True).alias("f")).distinct(), "full_path", "left").select("id", F.coalesce("f", F.lit(False)).alias("favorite"))
)
query("J4_favorite_sizes", "SELECT f.full_path, coalesce(m.size, 0) AS size FROM favorites f LEFT JOIN media m USING (full_path)")(lambda c: c.favorites.join(c.media.select("full_path", "size"), "full_path", "left").select("full_path", F.coalesce("size", F.lit(0)).alias("size")))
query("J5_persons_of_photos", "SELECT media_full_path, list_aggregate(list_sort(list(DISTINCT person_id)), 'string_agg', ',') AS persons FROM faces f JOIN assignments a ON f.id = a.face_id GROUP BY 1")(
    lambda c: people.persons_of_photos(c.faces, c.assignments).select("media_full_path", F.array_join(F.transform("person_ids", lambda x: x.cast("string")), ",").alias("persons"))
)
_SUMMARY = """SELECT p.id, p.name, count(f.id) AS n_faces, count(DISTINCT f.media_full_path) AS n_photos, arg_max(f.id, round(f.score * 96) * 1000000000 - f.id) AS cover_face
    FROM persons p LEFT JOIN (assignments a JOIN faces f ON f.id = a.face_id AND f.score >= 0.5 AND f.bbox_right - f.bbox_left >= 15) ON a.person_id = p.id GROUP BY 1, 2"""
query("J6_confirmed_persons", _SUMMARY)(lambda c: people.person_summary(c.persons, c.assignments, c.faces))
query("J7_persons_in_group", "SELECT id, name FROM persons WHERE id IN (SELECT person_id FROM members WHERE group_id = 1)")(lambda c: c.persons.join(c.members.where("group_id = 1").select(F.col("person_id").alias("id")), "id", "left_semi"))
query("J8_unlabelled", "SELECT id FROM faces WHERE score >= 0.5 AND bbox_right - bbox_left >= 15 AND id NOT IN (SELECT face_id FROM assignments) AND id NOT IN (SELECT face_id FROM ignored)")(lambda c: people.unlabelled(c.faces, c.assignments, c.ignored).select("id"))
_CANDIDATES = "SELECT id, embedding FROM faces WHERE score >= 0.5 AND bbox_right - bbox_left >= 15 AND id NOT IN (SELECT face_id FROM assignments) AND id NOT IN (SELECT face_id FROM ignored) AND id NOT IN (SELECT face_id FROM cannot_links WHERE person_id = 3)"
query("J9_suggestion_candidates", f"SELECT id FROM ({_CANDIDATES})")(lambda c: people.suggestion_candidates(c.faces, c.assignments, c.ignored, c.cannot_links, 3).select("id"))
query("J10_todo", "SELECT full_path FROM media WHERE type = 1 AND full_path NOT IN (SELECT media_full_path FROM faces)")(lambda c: scan.pending(c.media.where("type = 1"), c.faces.select(F.col("media_full_path").alias("full_path"))).select("full_path"))
query("J11_face_metadata", "SELECT f.id, coalesce(nullif(m.date_taken, 0), m.last_modified, 0) AS date_taken, coalesce(m.size, 0) AS size FROM faces f LEFT JOIN media m ON f.media_full_path = m.full_path")(
    lambda c: c.faces.join(c.media.select(F.col("full_path").alias("media_full_path"), "date_taken", "last_modified", "size"), "media_full_path", "left").select("id", F.coalesce(kinds.effective_taken(), F.lit(0)).alias("date_taken"), F.coalesce("size", F.lit(0)).alias("size"))
)
query("J12_map_selection", "SELECT path FROM geo WHERE has_geo AND path IN (SELECT '/geo/' || face_id FROM ignored)")(lambda c: c.geo.where("has_geo").join(c.ignored.select(F.concat(F.lit("/geo/"), F.col("face_id").cast("string")).alias("path")), "path", "left_semi").select("path"))
query("J13_text_and_code_whole", "SELECT o.path FROM whole_ocr o JOIN qr q USING (path) WHERE q.qr_text <> '' AND translate(o.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%'")(
    lambda c: people.text_search(c.whole_ocr, ["the"], True).join(c.qr.where("qr_text <> ''"), "path", "left_semi").select("path")
)
_NAMES = "SELECT DISTINCT f.media_full_path, lower(p.name) AS name FROM faces f JOIN assignments a ON f.id = a.face_id JOIN persons p ON p.id = a.person_id"


def _photo_names(c: Catalog) -> DataFrame:
    named = c.assignments.join(c.persons.withColumnRenamed("id", "person_id"), "person_id").select(F.col("face_id").alias("id"), "name")
    return c.faces.join(named, "id").select("media_full_path", "name").distinct()


for _every, _n in ((True, 2), (False, 1)):
    query(
        f"J14_people_{'all' if _every else 'any'}",
        f"SELECT media_full_path FROM (SELECT media_full_path, max(contains(name, 'an')::int) + max(contains(name, 'ra')::int) AS n FROM ({_NAMES}) GROUP BY 1) WHERE n >= {_n}",
    )(lambda c, every=_every: people.photos_with(_photo_names(c), ["AN", "ra"], every))
query("J15_longest_prefix", "SELECT child, arg_max(parent, length(parent)) AS parent FROM (SELECT d.path AS child, p.path AS parent FROM dirs d JOIN (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM dirs) p ON starts_with(lower(d.path), lower(p.path))) GROUP BY 1")(
    lambda c: folders.longest_prefix(dirs(c).select("path"), dirs(c).select(text.parent_of("path").alias("path")).distinct())
)
query("J16_album_covers", "SELECT d.path, coalesce(p.ord::varchar, 'none') AS cover FROM dirs d LEFT JOIN pinned p USING (path)")(
    lambda c: folders.rollup(listed(c).withColumn("full_path", F.lit("none")), covers=c.rows(PINNED, "path").withColumn("tmb", F.col("ord").cast("string"))).select("path", F.col("thumbnail").alias("cover"))
)
query("J17_reconcile", "SELECT 'delete' AS action, full_path FROM media WHERE full_path NOT IN (SELECT full_path FROM clean) UNION ALL SELECT 'upsert', full_path FROM clean")(
    lambda c: scan.pending(c.media, listed(c)).select(F.lit("delete").alias("action"), "full_path").unionByName(listed(c).select(F.lit("upsert").alias("action"), "full_path"))
)
def _sub_centroids_sql(vectors: str) -> str:
    """DuckDB SQL for the sub-centroids (person_id, c, n) of ``vectors`` (person_id, i from 1, e double[])."""
    return f"""WITH RECURSIVE v AS MATERIALIZED ({vectors}), s AS (SELECT person_id, i, [e] AS cents, [1] AS ns FROM v WHERE i = 1 UNION ALL
        SELECT person_id, i, CASE WHEN k > 0 THEN [CASE WHEN j = k THEN u ELSE cents[j] END for j in range(1, len(cents) + 1)] ELSE list_append(cents, e) END,
          CASE WHEN k > 0 THEN [CASE WHEN j = k THEN ns[j] + 1 ELSE ns[j] END for j in range(1, len(ns) + 1)] ELSE list_append(ns, 1) END
        FROM (SELECT *, [x / greatest(sqrt(list_sum([y * y for y in m])), 1e-9) for x in m] AS u
          FROM (SELECT *, CASE WHEN k > 0 THEN [cents[k][d] * ns[k] + e[d] for d in range(1, len(e) + 1)] ELSE e END AS m
            FROM (SELECT *, CASE WHEN list_max(sims) > 0.6 THEN list_position(sims, list_max(sims)) ELSE 0 END AS k
              FROM (SELECT s.person_id, v.i, s.cents, s.ns, v.e, [list_dot_product(x, v.e) for x in s.cents] AS sims FROM s JOIN v ON v.person_id = s.person_id AND v.i = s.i + 1)))))
      SELECT person_id, unnest(cents) AS c, unnest(ns) AS n, generate_subscripts(ns, 1) - 1 AS cluster FROM s QUALIFY i = max(i) OVER (PARTITION BY person_id)"""


_REFERENCE = _sub_centroids_sql("""SELECT 3::bigint AS person_id, row_number() OVER (ORDER BY k, id) AS i, e FROM (SELECT 0 AS k, f.id, f.embedding::double[] AS e FROM faces f JOIN assignments a ON f.id = a.face_id AND a.person_id = 3
    WHERE f.score >= 0.5 AND f.bbox_right - f.bbox_left >= 15 UNION ALL SELECT 1, id, embedding::double[] FROM anchors WHERE person_id = 3)""")
_SIMILAR = f"SELECT f.id, round(max(list_dot_product(f.embedding::double[], r.c)), 5) AS similarity FROM ({_CANDIDATES}) f, ({_REFERENCE}) r GROUP BY 1"


def _similar(c: Catalog) -> DataFrame:
    faces = people.suggestion_candidates(c.faces, c.assignments, c.ignored, c.cannot_links, 3).select("id", "embedding")
    vectors = people.reference_vectors(c.faces, c.assignments, c.anchors, 3)
    return people.best_similarity(faces, vectors).where("similarity is not null").select("id", F.round("similarity", 5).alias("similarity"))


query("J18_similarity", _SIMILAR)(_similar)
query("J19_widgets", "SELECT p.ord::int AS widget_id, d.path, d.media_count FROM pinned p LEFT JOIN dirs d USING (path) WHERE d.path IS NOT NULL")(
    lambda c: c.rows(PINNED, "path").join(dirs(c), "path").select(F.col("ord").alias("widget_id"), "path", "media_count")
)

# ---------------------------------------------------------------- aggregations

query(
    "A1_folder_rollup",
    """SELECT parent_path AS path, regexp_extract(parent_path, '[^/]*$') AS filename, max(CASE WHEN a = 1 THEN full_path END) AS thumbnail, count(*) AS media_count, sum(size)::bigint AS size, bit_or(type) AS media_types,
    max(CASE WHEN a = 1 OR z = 1 THEN last_modified END) AS last_modified, max(CASE WHEN a = 1 OR z = 1 THEN date_taken END) AS date_taken
    FROM (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY date_taken DESC, id) AS a, row_number() OVER (PARTITION BY parent_path ORDER BY date_taken, id DESC) AS z FROM clean) GROUP BY 1""",
)(dirs)
query("A2_type_set", "SELECT bit_or(type) AS types FROM clean")(lambda c: listed(c).agg(F.bit_or("type").alias("types")))
query("A3_sort_values", "SELECT path, media_count::varchar AS sort_value FROM dirs")(lambda c: dirs(c).select("path", folders.sort_value("count").alias("sort_value")))
query(
    "A4_counters",
    "SELECT count_if(is_favorite AND deleted_ts = 0) AS favorites, count_if(deleted_ts <> 0) AS deleted, (SELECT count(*) FROM faces) AS faces, (SELECT count(DISTINCT media_full_path) FROM faces) AS photos, (SELECT count_if(has_geo) FROM geo) AS geotagged, (SELECT count_if(qr_text <> '') FROM qr) AS codes FROM media",
)(
    lambda c: c.media.agg(F.count_if(F.col("is_favorite") & (F.col("deleted_ts") == 0)).alias("favorites"), F.count_if(F.col("deleted_ts") != 0).alias("deleted"))
    .crossJoin(c.faces.agg(F.count("*").alias("faces"), F.count_distinct("media_full_path").alias("photos")))
    .crossJoin(c.geo.agg(F.count_if("has_geo").alias("geotagged")))
    .crossJoin(c.qr.agg(F.count_if(F.col("qr_text") != "").alias("codes")))
)
query("A5_bin_size", "SELECT sum(CASE WHEN size = 0 THEN 1000 ELSE size END)::bigint AS size FROM media WHERE deleted_ts <> 0")(lambda c: c.media.where("deleted_ts <> 0").agg(F.sum(F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.lit(1000))).alias("size")))
query("A9_geo_clusters", "SELECT floor(lon / 0.703125)::bigint AS gx, floor(lat / 0.703125)::bigint AS gy, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n, min(path) AS first_path FROM geo WHERE has_geo GROUP BY 1, 2")(lambda c: people.grid_clusters(c.geo, 8))
query("A10_bounding_box", "SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, min(lat) = max(lat) AND min(lon) = max(lon) AS one_point FROM geo WHERE has_geo")(lambda c: people.bounding_box(c.geo))
query("A11_crowded_folders", """WITH f AS (SELECT DISTINCT parent_path AS path FROM media), a AS (SELECT path, unnest([array_to_string((string_split(path, '/'))[1:i], '/') for i in range(2, len(string_split(path, '/')))]) AS a FROM f),
    k AS (SELECT a, count(*) AS n FROM a WHERE contains(lower(a), '/android/data') GROUP BY 1 HAVING count(*) > 50) SELECT a AS path, n FROM k WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.a LIKE k.a || '/%')""")(lambda c: folders.crowded_ancestors(_folder_rules(c)[0]))
query("A12_person_covers", f"SELECT id, cover_face, n_photos FROM ({_SUMMARY}) WHERE n_faces > 0")(lambda c: people.person_summary(c.persons, c.assignments, c.faces).where("n_faces > 0").select("id", "cover_face", "n_photos"))
query("A13_section_labels", "SELECT DISTINCT lower(regexp_extract(filename, '[^.]*$')) || ' (' || count(*) OVER (PARTITION BY lower(regexp_extract(filename, '[^.]*$'))) || ')' AS label FROM clean")(
    lambda c: sequences.sections(listed(c), "extension").select(F.concat("section_key", F.lit(" ("), F.col("section_count").cast("string"), F.lit(")")).alias("label")).distinct()
)
_BURSTS = """SELECT *, sum(CASE WHEN pp = parent_path AND pt > 0 AND date_taken > 0 AND date_taken - pt <= 60000 THEN 0 ELSE 1 END) OVER (ORDER BY date_taken, id) AS grp
    FROM (SELECT *, lag(parent_path) OVER w AS pp, lag(date_taken) OVER w AS pt FROM clean WHERE type = 1 WINDOW w AS (ORDER BY date_taken, id))"""
query(
    "A14_sharpest",
    f"""SELECT min_by(id, t) AS first_id, count(*) AS n, min_by(id, r) AS best_id, CASE WHEN max(s) > 0 THEN floor(min(s) / max(s) * 100)::bigint ELSE 0 END AS least_percent
    FROM (SELECT id, grp, coalesce(sharpness, 0e0) AS s, row_number() OVER (ORDER BY date_taken, id) AS t, row_number() OVER (ORDER BY coalesce(sharpness, 0e0) DESC, date_taken, id) AS r FROM ({_BURSTS}) LEFT JOIN sharp USING (id)) GROUP BY grp HAVING count(*) >= 2""",
)(lambda c: sequences.sharpest(sequences.burst_rows(listed(c).where("type = 1"), 60_000), c.sharpness))
query("A15_centroids", """WITH e AS (SELECT label::bigint AS person_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT person_id, i, avg(x) AS x FROM e GROUP BY 1, 2)
    SELECT person_id, round(max(CASE WHEN i = 1 THEN x END) / sqrt(sum(x * x)), 5) AS first_value, count(*) AS n FROM m GROUP BY 1""")(
    lambda c: people.centroids(c.read("embeddings").withColumn("person_id", F.col("label").cast("long")), "person_id").select("person_id", F.round(F.element_at("centroid", 1), 5).alias("first_value"), F.size("centroid").cast("long").alias("n"))
)
query("A16_selection_size", f"SELECT sum(size)::bigint AS size FROM media WHERE parent_path = '{CAMERA}'")(lambda c: c.media.where(F.col("parent_path") == CAMERA).agg(F.sum("size").alias("size")))

# ---------------------------------------------------------------- sequences, orders

query("W1_burst_groups", """WITH i AS (SELECT *, lag(parent_path) OVER w AS pp, lag(date_taken) OVER w AS pt FROM clean WHERE type = 1 WINDOW w AS (ORDER BY date_taken, id)),
    g AS (SELECT *, sum(CASE WHEN pp = parent_path AND pt > 0 AND date_taken > 0 AND date_taken - pt <= 60000 THEN 0 ELSE 1 END) OVER (ORDER BY date_taken, id) AS grp FROM i)
    SELECT arg_min(id, date_taken * 1000000 + id) AS first_id, count(*) AS n, min(parent_path) AS folder, min(date_taken) AS first_taken, max(date_taken) AS last_taken FROM g GROUP BY grp HAVING count(*) >= 2""")(lambda c: sequences.bursts(listed(c).where("type = 1"), 60_000))
for _by, _key in (
    ("taken_day", "epoch_ms(date_trunc('day', make_timestamp(date_taken * 1000)))::varchar"), ("taken_month", "epoch_ms(date_trunc('month', make_timestamp(date_taken * 1000)))::varchar"),
    ("modified_month", "epoch_ms(date_trunc('month', make_timestamp(last_modified * 1000)))::varchar"), ("type", "type::varchar"), ("extension", "lower(regexp_extract(filename, '[^.]*$'))"), ("folder", "parent_path"),
):
    query(f"W2_sections_{_by}", f"SELECT id, {_key} AS section_key, row_number() OVER (PARTITION BY {_key} ORDER BY date_taken DESC, id) - 1 AS grid_position FROM clean")(lambda c, by=_by: sequences.sections(listed(c), by).select("id", "section_key", F.col("grid_position").cast("long").alias("grid_position")))
query("W4_section_order", "SELECT k::varchar AS section_key, n, dense_rank() OVER (ORDER BY k DESC) AS section_ord FROM (SELECT epoch_ms(date_trunc('day', make_timestamp(date_taken * 1000))) AS k, count(*) AS n FROM clean GROUP BY 1)")(
    lambda c: listed(c).groupBy(sequences.section_key("taken_day").alias("section_key")).agg(F.count("*").alias("n")).select("section_key", "n", F.expr("dense_rank() over (order by cast(section_key as bigint) desc)").cast("long").alias("section_ord"))
)
query("W5_section_titles", f"SELECT DISTINCT CASE WHEN d = DATE '2024-01-31' THEN 'today' WHEN d = DATE '2024-01-30' THEN 'yesterday' ELSE strftime(d, '%Y-%m-%d') END AS title FROM (SELECT make_timestamp(date_taken * 1000)::date AS d FROM clean)")(
    lambda c: listed(c).select(sequences.section_key("taken_day").alias("section_key")).distinct().select(sequences.section_title("taken_day", now_ms=NOW - 1).alias("title")).distinct()
)
_FLAGS = "CASE id % 4 WHEN 0 THEN 32 WHEN 1 THEN 1056 WHEN 2 THEN 2080 ELSE 2 END"
query("W6_group_setting", f"SELECT id, CASE WHEN ({_FLAGS} & 32) <> 0 THEN {_FLAGS} - 33 ELSE {_FLAGS} END AS used FROM media")(
    lambda c: c.media.select("id", sequences.group_setting(F.expr(_FLAGS), False).alias("used"))
)
query("W7_ungrouped", "SELECT id, '' AS section_key, row_number() OVER (ORDER BY date_taken DESC, id) - 1 AS grid_position FROM clean")(lambda c: sequences.ungrouped(listed(c).select("id", "date_taken")).select("id", "section_key", "grid_position"))
for _by, _key in (("name", "lower(filename)"), ("size", "size"), ("taken", "date_taken")):
    query(f"O1_sorted_by_{_by}_whole", f"SELECT id, row_number() OVER (ORDER BY {_key} DESC, id) AS place FROM clean")(
        lambda c, by=_by: sequences.placed(listed(c).select("id", sequences.sort_key(by).alias("k")), F.desc("k"), "id").select("id", "place")
    )
query("O2_custom_order", f"SELECT path, CASE WHEN path = '{PINNED[0]}' THEN 1 WHEN path = '{PINNED[1]}' THEN 2 ELSE 1073741824 END::bigint AS rank FROM dirs")(lambda c: folders.custom_order(dirs(c), "|||".join(PINNED)))
query("O3_pinned_first", "SELECT path, CASE WHEN path IN (SELECT path FROM pinned) THEN 0 ELSE 1 END AS pin_rank, media_count AS sort_key FROM dirs")(lambda c: folders.ordered(dirs(c), "count", pinned=c.rows(PINNED, "path")).select("path", "pin_rank", "sort_key"))
query("O4_sorted_faces_whole", "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id DESC) AS place FROM faces")(
    lambda c: sequences.placed(c.faces.select("id", "score"), F.desc("score"), F.desc("id")).select("id", F.round("score", 6).alias("score"), "place")
)
query("O5_persons_by_faces", f"SELECT id, n_faces, row_number() OVER (ORDER BY n_faces DESC, lower(name), id) AS place FROM ({_SUMMARY})")(
    lambda c: sequences.placed(people.person_summary(c.persons, c.assignments, c.faces).select("id", "n_faces", F.lower("name").alias("k")), F.desc("n_faces"), "k", "id").select("id", "n_faces", "place")
)
query("O8_random", "SELECT id, row_number() OVER (ORDER BY md5(id || '-7'), id) AS place FROM clean")(lambda c: sequences.shuffled(listed(c).select("id"), 7))
query("O6_natural_order_whole", "SELECT id, row_number() OVER (ORDER BY CASE WHEN filename LIKE '.%' THEN 0 ELSE 1 END, id) AS place FROM media")(
    lambda c: sequences.placed(c.media.select("id", text.natural_key("filename").alias("k")), "k", "id").select("id", "place")
)
query("O7_unlabelled_cap", "SELECT id FROM faces WHERE score >= 0.5 AND bbox_right - bbox_left >= 15 AND id NOT IN (SELECT face_id FROM assignments) AND id NOT IN (SELECT face_id FROM ignored) ORDER BY score DESC, id LIMIT 1500")(lambda c: people.unlabelled(c.faces, c.assignments, c.ignored).orderBy(F.desc("score"), "id").limit(1500).select("id"))
query("O9_search_order_whole", "SELECT id, date_taken, row_number() OVER (ORDER BY date_taken DESC, id) AS place FROM clean WHERE contains(lower(filename), '77')")(
    lambda c: sequences.placed(sequences.searched(listed(c), "77").select("id", "date_taken"), F.desc("date_taken"), "id").select("id", "date_taken", "place")
)
query("O10_sync_list", "SELECT id, CASE WHEN type = 2 THEN 1 ELSE 0 END AS part, row_number() OVER (PARTITION BY type = 2 ORDER BY last_modified DESC, id) AS place FROM clean WHERE type IN (1, 2)")(
    lambda c: sequences.within(listed(c).where("type in (1, 2)").select("id", (F.col("type") == 2).cast("int").alias("part"), "last_modified"), "part", F.desc("last_modified"), "id").select("id", "part", (F.col("position") + 1).alias("place"))
)

# ---------------------------------------------------------------- sets, scalars

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
query("U1_text_any_whole", f"SELECT path FROM whole_ocr WHERE {_FOLD} LIKE '%license%' OR {_FOLD} LIKE '%th_the%'")(lambda c: people.text_search(c.whole_ocr, ["License", "th_the"], False).select("path"))
query("U2_text_all_whole", f"SELECT path FROM whole_ocr WHERE {_FOLD} LIKE '%license%' AND {_FOLD} LIKE '%the%'")(lambda c: people.text_search(c.whole_ocr, ["LICENSE", "the"], True).select("path"))
query("U3_folders_to_scan", "SELECT path FROM (SELECT DISTINCT parent_path AS path FROM (SELECT * FROM media ORDER BY id DESC LIMIT 10) UNION SELECT path FROM included UNION SELECT path FROM pinned)")(
    lambda c: scan.newest_folders(c.media).unionByName(c.rows(INCLUDED, "path").select("path")).unionByName(c.rows(PINNED, "path").select("path")).distinct()
)
query("U4_difference", "SELECT path FROM dirs EXCEPT SELECT path FROM pinned")(lambda c: dirs(c).select("path").exceptAll(c.rows(PINNED, "path").select("path")))
query("U5_ever_shown", "SELECT path FROM pinned UNION SELECT d.path FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE starts_with(d.path, e.path))")(
    lambda c: c.rows(PINNED, "path").select("path").unionByName(
        dirs(c).select("path").join(dirs(c).select("path", F.explode(text.prefixes("path")).alias("p")).join(c.rows(EXCLUDED, "path").select(F.col("path").alias("p")), "p", "left_semi").select("path").distinct(), "path", "left_anti")
    ).distinct()
)
query("U6_temp_folder", "SELECT '/temp' AS path, -1::bigint AS n UNION ALL SELECT path, media_count FROM dirs")(lambda c: c.spark.createDataFrame([("/temp", -1)], "path string, n long").unionByName(dirs(c).select("path", F.col("media_count").alias("n"))))
query("X1_unaccented_whole", "SELECT doc_id, md5(trim(strip_accents(lower(text)), ' ' || chr(10) || chr(13) || chr(9))) AS digest FROM documents")(lambda c: c.read("documents").select("doc_id", F.md5(text.unaccented("text")).alias("digest")))
query("X2_path_parts", "SELECT id, regexp_replace(full_path, '/[^/]*$', '') AS parent, regexp_extract(full_path, '[^/]*$') AS name, lower(regexp_extract(filename, '[^.]*$')) AS ext FROM media")(
    lambda c: c.media.select("id", text.parent_of("full_path").alias("parent"), text.name_of("full_path").alias("name"), text.extension_of("filename").alias("ext"))
)
query("X3_wildcards_whole", f"SELECT path FROM whole_ocr WHERE {_FOLD} LIKE '%th%er%'")(lambda c: c.whole_ocr.where(text.like_pattern("text", "Th%eR")).select("path"))
query("X4_tokens", r"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') if x <> ''] AS t FROM documents)")(
    lambda c: c.read("documents").withColumn("t", text.tokens("text")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))
)
query("X5_index_cuts", "SELECT 'text' AS kind, path, md5(substr(text, 1, 8000)) AS digest FROM whole_ocr UNION ALL SELECT 'code', path, md5(substr(qr_text, 1, 4000)) FROM qr")(
    lambda c: c.ocr.select(F.lit("text").alias("kind"), "path", F.md5("text").alias("digest")).unionByName(c.qr.select(F.lit("code").alias("kind"), "path", F.md5(F.substring("qr_text", 1, 4000)).alias("digest")))
)
query("X6_hidden_names", "SELECT id, CASE WHEN filename LIKE '.%' THEN filename ELSE '.' || filename END AS hidden, CASE WHEN filename LIKE '.%' THEN substr(filename, 2) ELSE filename END AS unhidden FROM media")(lambda c: c.media.select("id", text.hidden("filename").alias("hidden"), text.unhidden("filename").alias("unhidden")))
query("X7_bin_paths", "SELECT id, 'recycle_bin' || full_path AS bin_path FROM media WHERE deleted_ts <> 0")(lambda c: c.media.where("deleted_ts <> 0").select("id", F.concat(F.lit(mutate.BIN), "full_path").alias("bin_path")))
query("X8_mime", "SELECT CASE WHEN lower(regexp_extract(filename, '[^.]*$')) IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN lower(regexp_extract(filename, '[^.]*$')) IN ('png', 'gif', 'heic') THEN 'image/' || lower(regexp_extract(filename, '[^.]*$')) WHEN lower(regexp_extract(filename, '[^.]*$')) = 'mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM media GROUP BY 1")(lambda c: c.media.groupBy(text.mime_of("filename").alias("mime")).agg(F.count("*").alias("n")))
query("X9_html_escape", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")(lambda c: c.read("pages").select("page_id", F.md5(text.html_escaped("html")).alias("digest")))
query("X10_ancestors", "SELECT path, array_to_string(list_reverse([array_to_string((string_split(path, '/'))[1:i], '/') for i in range(2, len(string_split(path, '/')) + 1)]), ',') AS above FROM dirs")(lambda c: dirs(c).select("path", F.array_join(F.reverse(text.ancestors("path")), ",").alias("above")))
query("X11_signature", "SELECT id, full_path || '-' || last_modified || '-' || size AS signature FROM media")(lambda c: c.media.select("id", F.concat_ws("-", "full_path", "last_modified", "size").alias("signature")))
query("X12_location", "SELECT count(*) AS n, CASE WHEN full_path LIKE '/storage/emulated/%' THEN 1 WHEN full_path LIKE 'otg:/%' THEN 3 ELSE 2 END AS location FROM media GROUP BY 2")(lambda c: c.media.groupBy(kinds.location_of("full_path").alias("location")).agg(F.count("*").alias("n")))
query("M3_dot_products_whole", """WITH e AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
    l AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), k AS (SELECT label, list(x / greatest(n, 1e-9) ORDER BY i) AS c FROM m JOIN l USING (label) GROUP BY 1)
    SELECT vec_id, label, round(list_dot_product(embedding::double[], c), 5) AS dot FROM embeddings JOIN k USING (label)""")(
    lambda c: c.read("embeddings").join(people.centroids(c.read("embeddings"), "label"), "label").select("vec_id", "label", F.round(people.dot("embedding", "centroid"), 5).alias("dot"))
)
query("M4_unit_vectors", "SELECT vec_id, round(embedding[1]::double / sqrt(list_sum([x::double * x::double for x in embedding])), 5) AS first_value FROM embeddings")(lambda c: c.read("embeddings").select("vec_id", F.round(F.element_at(people.unit("embedding"), 1), 5).alias("first_value")))
query("V4_suggestions", f"SELECT id, similarity FROM ({_SIMILAR}) WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 300")(lambda c: _similar(c).where("similarity >= 0.2").orderBy(F.desc("similarity"), "id").limit(300))
query("V3_sub_centroids", "SELECT person_id, cluster, n::bigint AS n FROM (" + _sub_centroids_sql("SELECT a.person_id, row_number() OVER (PARTITION BY a.person_id ORDER BY f.id) AS i, f.embedding::double[] AS e FROM assignments a JOIN faces f ON f.id = a.face_id") + ")")(
    lambda c: people.sub_centroids(c.assignments.join(c.faces, c.faces["id"] == c.assignments["face_id"]).select("person_id", F.col("id").alias("ord"), "embedding")).select("person_id", "cluster", "n")
)
query("N1_vector_bytes")(lambda c: c.read("embeddings").select("vec_id", F.hex(imaging.vector_bytes("embedding")).alias("bytes")))

for _name in [n for n in QUERIES if n.endswith("_whole")]:
    also(_name.removesuffix("_whole"), _name)

# ---------------------------------------------------------------- images

query(
    "M5_crop_spans",
    "SELECT id, a AS start, b AS \"end\" FROM (SELECT id, least(greatest(trunc(bbox_left - (bbox_right - bbox_left) * 0.3e0)::int, 0), 500) AS a, least(trunc(bbox_right + (bbox_right - bbox_left) * 0.3e0)::int, 500) AS b, bbox_right - bbox_left AS n FROM faces) WHERE n > 0 AND b > a",
)(lambda c: c.faces.withColumn("s", imaging.crop_span("bbox_left", "bbox_right", 500, 0.3)).where("s is not null").select("id", "s.start", "s.end"))
query("M7_sample_factors", "SELECT id, CASE WHEN w <= 0 OR h <= 0 THEN NULL ELSE (SELECT min(s) FROM (VALUES (1), (2), (4), (8), (16), (32)) t(s) WHERE w // s <= 1024 AND h // s <= 1024) END AS factor FROM (SELECT id, size % 9001 AS w, size % 5003 AS h FROM media)")(
    lambda c: c.media.select("id", (F.col("size") % 9001).alias("w"), (F.col("size") % 5003).alias("h")).select("id", imaging.sample_factor("w", "h", 1024).alias("factor"))
)
query("DT2_capture_text", "SELECT id, (ms // 1000) * 1000 AS taken FROM media0")(
    lambda c: c.media.select("id", F.date_format(F.timestamp_millis(F.col("last_modified") - (F.col("id") % 3600) * 1000), "yyyy:MM:dd HH:mm:ss").alias("t")).select("id", imaging.capture_ms("t").alias("taken"))
)
query("G1_places", "SELECT path, NOT (lat = 0 AND lon = 0) AS has_geo FROM (SELECT path, CASE WHEN has_geo THEN lat ELSE 0 END AS lat, CASE WHEN has_geo THEN lon ELSE 0 END AS lon FROM geo)")(
    lambda c: c.geo.select("path", F.when(F.col("has_geo"), F.col("lat")).otherwise(0.0).alias("lat"), F.when(F.col("has_geo"), F.col("lon")).otherwise(0.0).alias("lon")).select("path", imaging.is_place("lat", "lon").alias("has_geo"))
)
query("H1_content_hash", "SELECT page_id, sha256(html) AS digest FROM pages")(lambda c: c.read("pages").select("page_id", F.sha2("html", 256).alias("digest")))
query(
    "A17_sharpness",
    """WITH g AS (SELECT vec_id AS id, [floor((x::double + 1) * 100)::int for x in embedding] AS g FROM embeddings),
    l AS (SELECT id, unnest(flatten([[g[8*y+x] + g[8*y+x+2] + g[8*(y-1)+x+1] + g[8*(y+1)+x+1] - 4*g[8*y+x+1] for x in range(1, 7)] for y in range(1, 7)])) AS e FROM g)
    SELECT id, round(avg(e::double * e) - avg(e::double) * avg(e::double), 4) AS sharpness FROM l GROUP BY 1""",
)(
    lambda c: imaging.sharpness(c.read("embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int")).alias("gray"))).select("id", F.round("sharpness", 4).alias("sharpness"))
)

# ---------------------------------------------------------------- changes

query("D1_upsert", "SELECT full_path, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END::bigint AS size FROM media")(
    lambda c: mutate.upsert(c.media.select("full_path", F.lit(0).cast("long").alias("size")), c.date_takens.select("full_path", F.lit(1).alias("size")), "full_path")
)
query("D2_rekey", "SELECT id, CASE WHEN id = 10 THEN (SELECT full_path FROM media WHERE id = 20) ELSE full_path END AS full_path FROM media WHERE id <> 20")(
    lambda c: mutate.rekeyed(c.media.select("id", "full_path"), "full_path", c.media.where("id = 10").select(F.col("full_path").alias("old_key")).crossJoin(c.media.where("id = 20").select(F.col("full_path").alias("new_key"))))
)
query("D3_update", "SELECT id, CASE WHEN type = 2 THEN true ELSE is_favorite END AS is_favorite FROM media")(lambda c: mutate.updated(c.media, F.col("type") == 2, is_favorite=F.lit(True)).select("id", "is_favorite"))
query("D4_delete", "SELECT id FROM media WHERE deleted_ts = 0")(lambda c: mutate.deleted(c.media, F.col("deleted_ts") != 0).select("id"))
query("D5_insert", "SELECT id, name FROM persons UNION ALL SELECT (SELECT max(id) FROM persons) + row_number() OVER (ORDER BY name), name FROM groups0")(lambda c: mutate.inserted(c.persons, c.groups.select("name"), "name"))
query("D6_to_bin", f"SELECT id, CASE WHEN type = 4 AND deleted_ts = 0 THEN 'recycle_bin' || full_path ELSE full_path END AS full_path, CASE WHEN type = 4 AND deleted_ts = 0 THEN {NOW} ELSE deleted_ts END AS deleted_ts FROM media")(lambda c: mutate.to_bin(c.media, F.col("type") == 4, NOW).select("id", "full_path", "deleted_ts"))
query("D7_from_bin", "SELECT id, full_path, 0::bigint AS deleted_ts FROM media WHERE deleted_ts <> 0 OR type = 4")(lambda c: mutate.from_bin(mutate.to_bin(c.media, F.col("type") == 4, NOW), F.lit(True)).where("id % 29 = 0 or type = 4").select("id", "full_path", "deleted_ts"))
query("D8_expired", f"SELECT id FROM media WHERE deleted_ts = 0 OR deleted_ts >= {NOW - 15 * 86_400_000}")(lambda c: mutate.without_expired(c.media, NOW, 15 * 86_400_000).select("id"))
query("D7_restore_collisions", "SELECT id, full_path FROM media WHERE type = 4 UNION ALL SELECT id + 1000000, regexp_replace(full_path, '\\.[^.]*$', '') || '_1.' || regexp_extract(full_path, '[^.]*$') FROM media WHERE type = 4")(
    lambda c: mutate.from_bin(mutate.to_bin(c.media.where("type = 4").withColumn("deleted_ts", F.lit(0).cast("long")).withColumn("id", F.col("id") + 1_000_000), F.lit(True), NOW).unionByName(c.media.where("type = 4").withColumn("deleted_ts", F.lit(0).cast("long"))), F.lit(True)).select("id", "full_path")
)


def _kinds_of(**tables: DataFrame) -> DataFrame:
    """(kind, id, person_id) of several tables, to compare them in one."""
    out = None
    for kind, rows in tables.items():
        own = rows.select(F.lit(kind).alias("kind"), F.col("id" if "id" in rows.columns else "face_id").cast("long").alias("id"), F.col("person_id" if "person_id" in rows.columns else "id").cast("long").alias("person_id"))
        out = own if out is None else out.unionByName(own)
    return out


query("D9_merge_persons", """SELECT 'assignments' AS kind, face_id AS id, CASE WHEN person_id = 2 THEN 5 ELSE person_id END::bigint AS person_id FROM assignments
    UNION ALL SELECT DISTINCT 'cannot', face_id, CASE WHEN person_id = 2 THEN 5 ELSE person_id END::bigint FROM cannot_links UNION ALL SELECT 'persons', id, id FROM persons WHERE id <> 2""")(
    lambda c: _kinds_of(**dict(zip(("assignments", "cannot", "persons"), mutate.merged_persons(c.assignments, c.cannot_links, c.persons, 2, 5), strict=True)))
)
query("D10_delete_person", """SELECT 'assignments' AS kind, face_id AS id, person_id FROM assignments WHERE person_id <> 4 UNION ALL SELECT 'cannot', face_id, person_id FROM cannot_links WHERE person_id <> 4
    UNION ALL SELECT 'anchors', id, person_id FROM anchors WHERE person_id <> 4 UNION ALL SELECT 'persons', id, id FROM persons WHERE id <> 4""")(
    lambda c: _kinds_of(**dict(zip(("assignments", "cannot", "anchors", "persons"), mutate.deleted_person(c.assignments, c.cannot_links, c.anchors, c.persons, 4), strict=True)))
)
query("D12_not_this_person", "SELECT face_id, person_id FROM cannot_links UNION SELECT face_id, person_id FROM assignments WHERE face_id % 12 = 4 AND NOT is_manual")(
    lambda c: mutate.rejected(c.assignments, c.cannot_links, c.assignments.where("face_id % 12 = 4"))[1]
)
query("D14_manifest_import", """SELECT id, name FROM persons UNION ALL SELECT (SELECT max(id) FROM persons) + row_number() OVER (ORDER BY n_name), n_name FROM nation
    WHERE n_nationkey % 6 <> 5 AND n_nationkey % 3 <> 1 AND n_name NOT IN (SELECT name FROM persons)""")(
    lambda c: mutate.imported_people(
        c.persons,
        c.read("nation").select(F.concat(F.lit("h"), (F.col("n_nationkey") % 3).cast("string")).alias("hash"), F.when(F.col("n_nationkey") % 6 == 5, " ").otherwise(F.concat("n_name", F.lit(" "))).alias("name"), F.lit("people").alias("folder")),
        c.spark.createDataFrame([("h1",)], "hash string"),
    )
)
query("D15_move", f"SELECT id, full_path, filename, parent_path FROM media WHERE parent_path <> '{CAMERA}' UNION ALL SELECT id, '/moved/' || filename, filename, '/moved' FROM media WHERE parent_path = '{CAMERA}'")(
    lambda c: mutate.moved(c.media, c.media.where(F.col("parent_path") == CAMERA).select(F.col("full_path").alias("old_key"), F.concat(F.lit("/moved/"), "filename").alias("new_key"))).select("id", "full_path", "filename", "parent_path")
)
# ---------------------------------------------------------------- what leaves the catalog

query("Z1_listing_json", "SELECT to_json({'id': id, 'relpath': parent_path, 'name': filename, 'size': size, 'mtime': last_modified, 'bucket': regexp_extract(parent_path, '[^/]*$'), 'mime': CASE " + " ".join(f"WHEN lower(regexp_extract(filename, '[^.]*$')) = '{e}' THEN '{m}'" for e, m in (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"), ("heic", "image/heic"), ("mp4", "video/mp4"))) + " ELSE 'application/octet-stream' END})::varchar AS value FROM clean")(
    lambda c: sinks.listing_json(listed(c))
)
query("Z2_index_page", """SELECT '<li><a href="/api/file?id=' || id || '">' || replace(replace(replace(filename, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</a></li>' AS value FROM (SELECT * FROM clean ORDER BY last_modified DESC, id DESC LIMIT 2000)""")(lambda c: sinks.index_html(listed(c)))
query("Z3_favorites_lines", "SELECT full_path AS value FROM favorites")(lambda c: sinks.favorites_lines(c.favorites))
query("Z5_new_files", "SELECT id, full_path FROM media UNION ALL SELECT id + 1000000, regexp_replace(full_path, '\\.[^.]*$', '') || '_1.' || regexp_extract(full_path, '[^.]*$') FROM media WHERE id % 9 = 0")(
    lambda c: sinks.appended(c.media, c.media.where("id % 9 = 0").withColumn("id", F.col("id") + 1_000_000)).select("id", "full_path")
)
# an upsert takes no row away: cached folders that show nothing any more keep the 0 of the cache
query(
    "Z6_write_back",
    """SELECT parent_path AS path, count(*) AS media_count FROM clean GROUP BY 1 UNION ALL SELECT DISTINCT parent_path || '/old', 0::bigint FROM media
    UNION ALL SELECT DISTINCT parent_path, 0::bigint FROM media WHERE parent_path NOT IN (SELECT parent_path FROM clean)""",
)(
    lambda c: mutate.upsert(c.media.select(F.concat("parent_path", F.lit("/old")).alias("path")).unionByName(c.media.select(F.col("parent_path").alias("path"))).distinct().withColumn("media_count", F.lit(0).cast("long")), dirs(c), "path")
)

# ---------------------------------------------------------------- streams


@query("ST1_index_stream", "SELECT id, lower(regexp_extract(filename, '[^.]*$')) AS ext FROM media")
def _indexed(c: Catalog) -> DataFrame:
    """An indexer that runs over the rows of the event files once."""
    out, check = (work_dir(c.spark, n) for n in ("indexed", "indexer"))
    ingest.index_stream(c.streamed().media, lambda rows: rows.select("id", text.extension_of("filename").alias("ext")), out, check).awaitTermination()
    return c.spark.read.schema("id long, ext string").parquet(out)


query("ST3_new_rows", "SELECT id FROM media WHERE id > (SELECT max(id) FROM media) - 100")(lambda c: ingest.new_since(c.media, c.media.agg(F.max("id")).first()[0] - 100).select("id"))
