import random
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from mediacat.functions import imaging, kinds
from mediacat.operators import folders, people, sequences, suggest
from mediacat.work import setting

# ---------------------------------------------------------------- suggestions


def faces_of(spark, draw, n, dims=8, loose=6):
    centers = draw.normal(size=(loose, dims))
    rows = []
    for i in range(n):
        v = centers[i % loose] + draw.normal(size=dims) * 0.4
        v = None if i % 41 == 7 else [float(x) for x in v / np.linalg.norm(v)]
        rows.append((i, f"/p/{i // 2}", float(draw.random()), 0, int(draw.integers(5, 60)), v))
    return rows, spark.createDataFrame(rows, "id long, media_full_path string, score double, bbox_left int, bbox_right int, embedding array<double>")


def test_suggestions_equal_those_of_each_person(spark):
    draw = np.random.default_rng(5)
    rows, faces = faces_of(spark, draw, 400)
    pairs = [(i, i % 7) for i in range(0, 400, 3)]
    never = [(i, int(draw.integers(0, 7))) for i in range(400) if i % 5 == 1]
    anchors = [(i, i % 8, rows[i][5]) for i in range(20, 40) if rows[i][5]]
    table = lambda data, schema: spark.createDataFrame(data, schema)
    a, c, ig = table(pairs, "face_id long, person_id long"), table(never, "face_id long, person_id long"), table([(5,), (8,)], "face_id long")
    an = table(anchors, "id long, person_id long, embedding array<double>")
    vectors = {}
    for r in suggest.person_vectors(faces, a, an).collect():
        vectors.setdefault(r.person_id, []).append(np.array(r.vector))
    assert set(vectors) == set(range(8))
    good = {r.id for r in people.unlabelled(faces, a, ig).collect()}
    for most, block in ((300, 4096), (4, 4096), (4, 3)):
        want = set()
        for p, own in vectors.items():
            found = sorted((-round(float(max(np.array(r[5]) @ v for v in own)), 5), r[0]) for r in rows if r[0] in good and r[5] and (r[0], p) not in never)
            want |= {(p, i, -s, n) for n, (s, i) in enumerate([x for x in found if -x[0] >= 0.3][:most], 1)}
        got = {tuple(r) for r in suggest.suggestions(faces, a, ig, c, an, least=0.3, most=most, block=block).collect()}
        assert got == want and len(want) > 20
    vectors_of_one = people.reference_vectors(faces, a, an, 3)
    one = people.best_similarity(people.suggestion_candidates(faces, a, ig, c, 3).where("embedding is not null"), vectors_of_one)
    first = {r.id: round(r.similarity, 5) for r in one.collect()}
    mine = {r.id: r.similarity for r in suggest.suggestions(faces, a, ig, c, an, least=-1.0).where("person_id = 3").collect()}
    assert mine == first


def test_the_bound_holds_and_skips():
    draw = np.random.default_rng(1)
    persons = suggest.Persons(np.repeat(np.arange(30), 3), np.repeat(draw.normal(size=(30, 16)), 3, axis=0) + draw.normal(size=(90, 16)) * 0.05)
    faces = draw.normal(size=(50, 16))
    every = faces @ persons.vectors.T
    best = np.stack([every[:, a:b].max(1) for a, b in zip(persons.first, persons.ends, strict=True)], 1)
    bound = faces @ persons.means.T + np.linalg.norm(faces, axis=1)[:, None] * persons.reach[None, :]
    assert (bound >= best - 1e-9).all()
    assert (bound < 5).mean() > 0.5


def test_no_persons_no_faces(spark):
    _, faces = faces_of(spark, np.random.default_rng(1), 3)
    none = lambda schema: spark.createDataFrame([], schema)
    a, an = none("face_id long, person_id long"), none("id long, person_id long, embedding array<double>")
    assert suggest.suggestions(faces, a, none("face_id long"), a, an).count() == 0
    assert suggest.suggestions(faces.limit(0), a, none("face_id long"), a, an).count() == 0


# ---------------------------------------------------------------- alignment


def test_alignment_is_the_least_squares_fit(spark):
    draw = np.random.default_rng(2)
    cases = [(draw.normal(size=10), draw.normal(size=10)) for _ in range(20)]
    turn = lambda p, t, s: s * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ p.reshape(-1, 2).T
    src = draw.normal(size=10)
    cases.append((src, (turn(src, 0.7, 2.0).T + [3.0, -1.0]).ravel()))
    df = spark.createDataFrame([(i, s.tolist(), d.tolist()) for i, (s, d) in enumerate(cases)], "i int, s array<double>, d array<double>")
    got = {r.i: (r.m.a, r.m.b, r.m.tx, r.m.ty) for r in df.select("i", imaging.similarity_matrix("s", "d").alias("m")).collect()}
    for i, (s, d) in enumerate(cases):
        x, y = s[::2], s[1::2]
        rows = np.concatenate([np.stack([x, -y, x * 0 + 1, x * 0], 1), np.stack([y, x, x * 0, x * 0 + 1], 1)])
        want = np.linalg.lstsq(rows, np.concatenate([d[::2], d[1::2]]), rcond=None)[0]
        assert np.allclose(got[i], want, atol=1e-9)
    assert np.allclose(got[20], [2 * np.cos(0.7), 2 * np.sin(0.7), 3, -1])
    odd = spark.createDataFrame([([1.0] * 10, [2.0] * 10), ([1.0, 2.0], [1.0, 2.0]), (None, [1.0] * 10), ([1.0] * 9, [1.0] * 9), ([1.0] * 10, [1.0] * 8), ([], [])], "s array<double>, d array<double>")
    assert [r.m for r in odd.select(imaging.similarity_matrix("s", "d").alias("m")).collect()] == [None] * 6


# ---------------------------------------------------------------- aliases


def rewritten(path, aliases):
    seen, now = set(), path
    for _ in range(folders.MOST_REWRITES):
        fits = [a for a in aliases if now == a or now.startswith(a + "/")]
        if not fits:
            return now
        a = max(fits, key=len)
        now = aliases[a] + now[len(a) :]
        seen.add(now)
    return path


def test_aliases(spark):
    draw = random.Random(3)
    aliases = {"/a": "/b", "/b": "/c/d", "/c/d/x": "/y", "/l": "/m", "/m": "/l", "/g": "/g/g", "/sd": "/storage/0", "/storage/0/Cam": "/storage/0/DCIM/Cam", "/s": "/s"}
    tops = ["/a", "/b", "/c/d", "/l", "/m", "/g", "/sd", "/sdx", "/storage/0/Cam", "/s", "/z", "/ab"]
    paths = sorted({t + "".join("/" + draw.choice(["x", "y", "Cam"]) for _ in range(draw.randrange(3))) for t in tops for _ in range(4)})
    own = {a: t for a, t in aliases.items() if a != t}
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] + [(None, 999)], "path string, ord int")
    al = spark.createDataFrame(list(aliases.items()), "path string, target string")
    got = {r.path: r.real for r in folders.resolved(df, al).collect()}
    assert got == {p: rewritten(p, own) for p in paths} | {None: None}
    assert got["/a"] == "/c/d" and got["/l/x"] == "/l/x" if "/l/x" in got else True
    first = {}
    for i, p in enumerate(paths):
        first.setdefault(rewritten(p, own).lower(), p)
    assert sorted(r.path for r in folders.distinct_real_folders(df.where("path is not null"), al).collect()) == sorted(first.values())


# ---------------------------------------------------------------- days, lists, covers


def test_days_of_a_zone_with_summer_time(spark):
    zone = ZoneInfo("America/New_York")
    ms = lambda *t: int(datetime(*t, tzinfo=zone).timestamp() * 1000)
    for day, hours in (((2024, 11, 3), 25), ((2024, 3, 10), 23), ((2024, 7, 1), 24)):
        first = ms(*day)
        times = [first - 1, first, first + 1800_000, first + 12 * 3_600_000, first + hours * 3_600_000 - 1, first + hours * 3_600_000]
        with setting(spark, "spark.sql.session.timeZone", "America/New_York"):
            df = spark.createDataFrame([(t,) for t in times], "t long")
            got = df.select("t", kinds.in_days(F.col("t"), F.lit(first + 1800_000), F.lit(first + 1800_000)).alias("i"), kinds.day_start(F.col("t")).alias("d")).collect()
        assert [r.i for r in got] == [False, True, True, True, True, False]
        assert [r.d for r in got[1:5]] == [first] * 4 and got[5].d == first + hours * 3_600_000


def test_a_video_takes_the_place_of_an_image_of_its_id(spark):
    rows = spark.createDataFrame([(1, 1, 50), (2, 1, 40), (3, 1, 30), (2, 2, 99), (9, 2, 98), (1, 1, 10)], "id long, type int, last_modified long")
    got = [(r.id, r.type, r.last_modified) for r in sequences.sync_list(rows).orderBy("place").collect()]
    assert got == [(1, 1, 10), (2, 2, 99), (3, 1, 30), (9, 2, 98)]
