"""Queries of the folder tree, with SQL that goes from folder to parent by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tree
from ..sources.catalog import ROOT, Catalog
from .catalog_queries import dirs, query

_UP = "regexp_replace({}, '/[^/]*$', '')"


def _filled(pick: str = "max") -> str:
    """SQL of the listed folders and the parents made for them: ``own`` children, then parents above parents."""
    return f"""RECURSIVE l AS (SELECT *, {_UP.format("path")} AS up FROM rolled), c AS (SELECT up AS path FROM l GROUP BY 1 HAVING count(*) > 1 AND lower(up) NOT IN (SELECT lower(path) FROM l)),
    r(child, made) AS (SELECT l.path, c.path FROM l JOIN c ON lower(l.up) = lower(c.path) UNION ALL SELECT r.child, c.path FROM r JOIN c ON lower({_UP.format("r.made")}) = lower(c.path)),
    filled AS (SELECT path, thumbnail, media_count, size, media_types, last_modified, date_taken, true AS has_media FROM l UNION ALL
    SELECT made, arg_min(thumbnail, path) FILTER (lower(l.up) = lower(made)), sum(media_count)::bigint, sum(size)::bigint, bit_or(media_types), {pick}(last_modified), {pick}(date_taken), false FROM r JOIN l ON l.path = r.child GROUP BY 1)"""


# who gives way to a parent, which parents are made (at the first such folder), and what they take in
_COLLAPSED = f"""{_filled()}, f AS (SELECT *, lower(path) AS k, lower({_UP.format("path")}) AS up FROM filled),
    gone AS (SELECT f.path, f.up, EXISTS (SELECT 1 FROM f g WHERE g.k = f.up) AS parent_listed FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.k <> f.k AND (g.k = f.up OR g.up = f.up))),
    m AS (SELECT up AS k, min(path) AS first, {_UP.format("min(path)")} AS path FROM gone WHERE NOT parent_listed GROUP BY up),
    into_(child, made, first) AS (SELECT f.path, m.path, m.first FROM f JOIN m ON m.k = f.up UNION ALL SELECT i.child, m.path, m.first FROM into_ i JOIN m ON m.k = lower({_UP.format("i.made")}) AND i.first < m.first),
    made AS (SELECT made AS path, sum(media_count)::bigint AS media_count, sum(size)::bigint AS size, bit_or(media_types) AS media_types, max(last_modified) AS last_modified, max(date_taken) AS date_taken, false AS has_media FROM into_ JOIN f ON f.path = child GROUP BY 1),
    children AS (SELECT path, media_count, size, media_types, last_modified, date_taken, has_media FROM filled UNION ALL SELECT * FROM made),
    tops AS (SELECT * FROM children WHERE path NOT IN (SELECT path FROM gone))"""

_INSIDE = f"{ROOT}Android/data/com.x/stickers/4"
_IN_PREFIX = f"""{_filled()}, children AS (SELECT * FROM filled), tops AS (SELECT * FROM filled WHERE lower({_UP.format("path")}) = lower('{_INSIDE}'))"""

# each folder's parent in the list is the longest prefix; it counts there if it is that folder, lies in it, or lies in a listed one
_COUNTS = f""", goes AS (SELECT c.*, arg_max(t.path, CASE WHEN t.path = c.path THEN 100000 ELSE length(t.path) END) AS parent FROM children c JOIN tops t ON starts_with(lower(c.path), lower(t.path)) GROUP BY ALL),
    counted AS (SELECT * FROM goes WHERE lower(parent) = lower(path) OR lower(parent) = lower({_UP.format("path")}) OR lower({_UP.format("path")}) IN (SELECT lower(path) FROM children)),
    n AS (SELECT parent AS path, count_if(has_media) AS subfolders, sum(CASE WHEN parent <> path THEN media_count ELSE 0 END)::bigint AS more FROM counted GROUP BY 1)
    SELECT t.path, coalesce(n.subfolders, 0)::bigint AS subfolders, (CASE WHEN t.has_media THEN t.media_count ELSE 0 END + coalesce(n.more, 0))::bigint AS subfolder_media FROM tops t LEFT JOIN n USING (path)"""

_ROW = ("path", "media_count", "size", "media_types", "last_modified", "date_taken", "has_media")


def _kept(c: Catalog, prefix: str = "") -> DataFrame:
    return tree.collapsed(tree.with_parents(dirs(c)), prefix).where("kept")


query("A6_parents", f"WITH {_filled()} SELECT * FROM filled")(lambda c: tree.with_parents(dirs(c)).drop("place"))
query("A6_parents_ascending", f"WITH {_filled('min')} SELECT * FROM filled")(lambda c: tree.with_parents(dirs(c), descending=False).drop("place"))
query("A7_top_folders", f"WITH {_COLLAPSED} SELECT * FROM tops")(lambda c: _kept(c).select(*_ROW))
query("A7_inside_folder", f"WITH {_IN_PREFIX} SELECT {', '.join(_ROW)} FROM tops")(lambda c: _kept(c, _INSIDE.upper()).select(*_ROW))
query("A8_subfolder_counts", f"WITH {_COLLAPSED} {_COUNTS}")(lambda c: tree.shown(dirs(c)).select("path", "subfolders", "subfolder_media"))
query("A8_inside_folder", f"WITH {_IN_PREFIX} {_COUNTS} UNION ALL SELECT path, 1::bigint, media_count FROM rolled WHERE lower(path) = lower('{_INSIDE}')")(
    lambda c: tree.shown(dirs(c), prefix=_INSIDE.upper()).select("path", "subfolders", F.col("subfolder_media").cast("long").alias("subfolder_media"))
)
