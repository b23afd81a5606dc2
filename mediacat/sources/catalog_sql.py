"""The same derivations in DuckDB SQL, written independently, for checking results."""

from __future__ import annotations

import re

_P = "/storage/emulated/0/"


def _values(*rows: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(rows)) + ") t(path, ord)"


TABLES = {
    "media0": f"""SELECT event_id AS id, epoch_us(ts)//1000 AS ms, value,
        '{_P}' || CASE user_id % 6 WHEN 0 THEN 'DCIM/Camera' WHEN 1 THEN 'Pictures/Screenshots' WHEN 2 THEN 'Download' WHEN 3 THEN 'WhatsApp/Media/.Statuses'
          WHEN 4 THEN 'Android/data/com.x/stickers/' || user_id ELSE 'Pictures/Trip' END || '/' || event_type AS parent_path,
        CASE WHEN event_id % 41 = 0 THEN '.' ELSE '' END || 'IMG_' || event_id || (['.jpg','.JPG','.png','.mp4','.gif','.dng','.svg','.jpeg','.txt','.heic'])[(event_id % 10 + 1)::int] AS filename FROM events""",
    "media": """SELECT id, filename, parent_path || '/' || filename AS full_path, parent_path, ms + (id % 3600) * 1000 AS last_modified,
        CASE WHEN id % 17 = 0 THEN 0 ELSE ms END AS date_taken, CASE WHEN id % 53 = 0 THEN 0 ELSE floor(value * 1000)::bigint END AS size,
        CASE id % 10 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 8 WHEN 6 THEN 16 WHEN 8 THEN 0 ELSE 1 END::int AS type,
        CASE WHEN id % 10 = 3 THEN id % 300 ELSE 0 END::int AS video_duration, id % 13 = 0 AS is_favorite,
        CASE WHEN id % 29 = 0 THEN ms + 86400000 ELSE 0 END AS deleted_ts, id AS media_store_id FROM media0""",
    "date_takens": "SELECT full_path, filename, parent_path, last_modified - (id % 3600) * 1000 + 5000 AS date_taken, last_modified FROM media WHERE id % 7 = 0",
    "favorites": "SELECT full_path, filename, parent_path FROM media WHERE id % 13 = 0",
    "faces": """SELECT v.vec_id AS id, m.full_path AS media_full_path, (v.vec_id % 3)::int AS face_index, (v.vec_id % 97) / 96e0 AS score,
        ((v.vec_id * 7) % 500)::int AS bbox_left, ((v.vec_id * 7) % 500 + v.vec_id % 60)::int AS bbox_right, v.embedding FROM embeddings v JOIN media m ON m.id = v.vec_id - v.vec_id % 3""",
    "persons": "SELECT n_nationkey::bigint AS id, n_name AS name FROM nation WHERE n_nationkey < 10",
    "assignments": "SELECT vec_id AS face_id, label::bigint AS person_id, vec_id % 8 = 0 AS is_manual FROM embeddings WHERE vec_id % 4 = 0",
    "cannot_links": "SELECT vec_id AS face_id, label::bigint AS person_id FROM embeddings WHERE vec_id % 11 = 0",
    "anchors": "SELECT vec_id AS id, label::bigint AS person_id, embedding FROM embeddings WHERE vec_id % 50 = 1",
    "ignored": "SELECT vec_id AS face_id FROM embeddings WHERE vec_id % 19 = 0",
    "groups0": "SELECT r_regionkey::bigint AS id, r_name AS name FROM region",
    "members": "SELECT n_regionkey::bigint AS group_id, n_nationkey::bigint AS person_id FROM nation WHERE n_nationkey < 10",
    "geo": """SELECT '/geo/' || c_custkey AS path, (CASE WHEN c_custkey % 3 = 0 THEN -35e0 ELSE 47e0 END) + ((c_custkey * 7919) % 3000) / 1e3 AS lat,
        (CASE WHEN c_custkey % 3 = 0 THEN -72e0 ELSE 16e0 END) + ((c_custkey * 104729) % 6000) / 1e3 AS lon, c_custkey % 5 <> 0 AS has_geo FROM customer""",
    "ocr": "SELECT '/ocr/' || doc_id AS path, substr(text, 1, 8000) AS text FROM documents",
    "whole_ocr": "SELECT '/ocr/' || doc_id AS path, text FROM documents",
    "qr": "SELECT '/ocr/' || page_id AS path, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS qr_text FROM pages",
    "included": _values(f"{_P}WhatsApp/Media/.Statuses/click", f"{_P}pictures/screenshots"),
    "excluded": _values(f"{_P}Download", f"{_P}Pictures/Trip/view"),
    "nomedia": _values(f"{_P}Android/data", f"{_P}Pictures/Screenshots/purchase"),
    "protected": _values(f"{_P}DCIM/Camera/click", f"{_P}pictures/screenshots/view"),
    "sharp": """SELECT id, avg(e::double * e) - avg(e::double) * avg(e::double) AS sharpness FROM (
        SELECT id, unnest(flatten([[g[8*y+x] + g[8*y+x+2] + g[8*(y-1)+x+1] + g[8*(y+1)+x+1] - 4*g[8*y+x+1] for x in range(1, 7)] for y in range(1, 7)])) AS e
        FROM (SELECT vec_id AS id, [floor((x::double + 1) * 100)::int for x in embedding] AS g FROM embeddings)) GROUP BY 1""",
    "pinned": _values(f"{_P}Pictures/Trip/click", f"{_P}DCIM/Camera/view"),
    # live, visible rows with their effective capture time
    "clean": """SELECT m.* EXCLUDE (date_taken), coalesce(d.date_taken, nullif(m.date_taken, 0), m.last_modified) AS date_taken FROM media m LEFT JOIN date_takens d USING (full_path)
        WHERE m.deleted_ts = 0 AND m.type <> 0 AND m.size > 0 AND m.filename NOT LIKE '.%'""",
    # the folder overview: the first item by capture time is the cover, the times are those of the first and last
    "rolled": """SELECT parent_path AS path, max(CASE WHEN a = 1 THEN full_path END) AS thumbnail, count(*) AS media_count, sum(size)::bigint AS size, bit_or(type) AS media_types,
        max(CASE WHEN a = 1 OR z = 1 THEN last_modified END) AS last_modified, max(CASE WHEN a = 1 OR z = 1 THEN date_taken END) AS date_taken
        FROM (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY date_taken DESC, id) AS a, row_number() OVER (PARTITION BY parent_path ORDER BY date_taken, id DESC) AS z FROM clean) GROUP BY 1""",
    "dirs": "SELECT parent_path AS path, count(*) AS media_count, sum(size)::bigint AS size, bit_or(type) AS media_types, min(date_taken) AS first_taken, max(date_taken) AS last_taken FROM clean GROUP BY 1",
}


def sql(body: str) -> str:
    """``body`` after a WITH clause of the derived tables that it, or they, name."""
    needed: list[str] = []

    def visit(text: str, within: tuple[str, ...] = ()) -> None:
        for name in TABLES:
            if name not in needed and name not in within and re.search(rf"\b{name}\b", text):
                visit(TABLES[name], (*within, name))
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in needed)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {head}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {head} {body}"
