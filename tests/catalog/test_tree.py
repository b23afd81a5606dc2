"""The folder tree against a plain version that keeps lists and goes from folder to folder."""

import random

import pytest

from mediacat.operators import tree


def above(path):
    if path == "/" or "/" not in path:
        return None
    return path.rpartition("/")[0] or "/"


def same(a, b):
    return a is not None and b is not None and a.lower() == b.lower()


class Rows:
    """Listed folders; each is a dict."""

    def __init__(self, dirs, descending):
        self.rows, self.pick = [dict(d, has_media=True) for d in dirs], max if descending else min

    def make(self, path):
        inside = [r for r in self.rows if same(above(r["path"]), path)]
        made = {"path": path, "thumbnail": inside[0]["thumbnail"], "has_media": False, "media_types": 0}
        for column in ("media_count", "size"):
            made[column] = sum(r[column] for r in inside)
        for column in ("last_modified", "date_taken"):
            made[column] = self.pick(r[column] for r in inside)
        for r in inside:
            made["media_types"] |= r["media_types"]
        self.rows.append(made)

    def fill(self):
        listed = [r["path"] for r in self.rows]
        lie_in = {}
        for p in listed:
            if above(p) is not None:
                lie_in.setdefault(above(p), []).append(p)
        wanted = [p for p, inside in lie_in.items() if len(inside) > 1 and not any(same(p, q) for q in listed)]
        for p in sorted(wanted, key=len, reverse=True):
            self.make(p)

    def top(self):
        """Round after round while a kept folder lies directly in another."""
        while True:
            listed = sorted(r["path"] for r in self.rows)
            kept, made = [], []
            for p in listed:
                if p in (tree.BIN, tree.FAVORITES):
                    kept.append(p)
                elif any(not same(p, q) and (same(above(p), q) or same(above(p), above(q))) for q in listed):
                    if not any(same(above(p), r["path"]) for r in self.rows):
                        self.make(above(p))
                        made.append(above(p))
                        kept.append(above(p))
                else:
                    kept.append(p)
            shown = [r for r in self.rows if r["path"] in kept]
            again = any(same(above(q), p) and not same(p, q) for p in kept for q in kept if q not in made)
            if len(listed) == len(kept) or not again:
                return shown
            self.rows = shown

    def count(self, shown):
        out = {r["path"]: [0, r["media_count"] if r["has_media"] else 0] for r in shown}
        for c in self.rows:
            fits = [r["path"] for r in shown if c["path"].lower().startswith(r["path"].lower())]
            if not fits:
                continue
            to = c["path"] if c["path"] in fits else max(fits, key=len)
            if same(to, c["path"]) or same(to, above(c["path"])) or any(same(r["path"], above(c["path"])) for r in self.rows):
                out[to][0] += c["has_media"]
                out[to][1] += c["media_count"] if to != c["path"] else 0
        return out


COLUMNS = ("path", "thumbnail", "media_count", "size", "media_types", "last_modified", "date_taken", "has_media")


def brute(dirs, prefix, descending):
    rows = Rows(dirs, descending)
    rows.fill()
    filled = [tuple(r[c] for c in COLUMNS) for r in rows.rows]
    shown = [r for r in rows.rows if same(above(r["path"]), prefix)] if prefix else rows.top()
    counts = rows.count(shown)
    out = [tuple(r[c] for c in COLUMNS) + tuple(counts[r["path"]]) for r in shown]
    own = [d for d in dirs if same(d["path"], prefix)]
    return sorted(filled), sorted(out + [tuple(dict(o, has_media=True)[c] for c in COLUMNS) + (1, o["media_count"]) for o in own[:1]])


def table(spark, dirs):
    rows = [(d["path"], d["thumbnail"], d["media_count"], d["size"], d["media_types"], d["last_modified"], d["date_taken"], i) for i, d in enumerate(dirs)]
    return spark.createDataFrame(rows, "path string, thumbnail string, media_count long, size long, media_types int, last_modified long, date_taken long, ord int")


def made_up(paths, draw):
    return [{"path": p, "thumbnail": f"t{i}", "media_count": draw.randrange(1, 9), "size": draw.randrange(100), "media_types": 1 << draw.randrange(5), "last_modified": draw.randrange(1000), "date_taken": draw.randrange(1000)} for i, p in enumerate(paths)]


def check(spark, dirs, prefix="", descending=True):
    filled, out = brute(dirs, prefix, descending)
    t = table(spark, dirs)
    assert sorted(tuple(r) for r in tree.with_parents(t, descending).select(*COLUMNS).collect()) == filled
    assert sorted(tuple(r) for r in tree.shown(t, prefix=prefix, descending=descending).select(*COLUMNS, "subfolders", "subfolder_media").collect()) == out


CASES = [
    ["/a/b/c1", "/a/b/c2", "/a/x", "/a/y"],
    ["/a/b/c1", "/a/b/c2", "/a/x"],
    ["/s/a/b1", "/s/a/b2", "/s/c/d1", "/s/c/d2", "/t"],
    ["/a", "/a/b", "/a/b/c", "/q/r/s"],
    ["/r/s/t/1", "/r/s/t/2", "/r/s/u/1", "/r/s/u/2", "/r/v/w", "/z", "recycle_bin", "favorites"],
    ["/A/x", "/a/y", "/a/Z", "/A/w", "/a/x"],
    ["/m/P/1", "/m/P/2", "/m/p/3", "/m/p/4", "/m/q", "/m/Q"],
    ["/a/b", "/a/bc", "/a/bc/d", "/a/bcd/e"],
    ["/only"],
    [],
]


@pytest.mark.parametrize("paths", CASES)
def test_trees(spark, paths):
    check(spark, made_up(paths, random.Random(1)))


def test_made_parents_count_for_those_above(spark):
    dirs = [dict(d, media_count=1) for d in made_up(CASES[0], random.Random(1))]
    assert {r.path: r.media_count for r in tree.with_parents(table(spark, dirs)).collect()}["/a"] == 4


@pytest.mark.parametrize("prefix", ["/A/B", "/none", "/s/a"])
def test_inside_a_folder(spark, prefix):
    for paths in (CASES[2], CASES[0] + ["/a/b/k", "/A", "/a"]):
        check(spark, made_up(paths, random.Random(2)), prefix, descending=False)


def test_random_trees(spark):
    draw = random.Random(5)
    for round_ in range(4):
        names = draw.choice([["a", "b", "c"], ["a", "A", "b"], ["x", "xy", "X", "z"]])
        paths = {"/" + "/".join(draw.choice(names) for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(2, 25))}
        paths = list(paths)
        draw.shuffle(paths)
        check(spark, made_up(paths, draw), descending=round_ % 2 == 0)


@pytest.mark.parametrize("prefix", ["", "/a"])
def test_folders_are_rolled_up_once(spark, prefix):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    dirs = table(spark, made_up(CASES[0], random.Random(1)))
    tree.shown(dirs.mapInArrow(count, dirs.schema), prefix=prefix).collect()
    assert looked.value == len(CASES[0])
