import numpy as np

from mediacat.llm import linking, media, registry

from .brute import classes


def picture(seed, side=96):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, (side // 8, side // 8)).astype(float)
    return np.clip(np.kron(coarse, np.ones((8, 8))) + rng.normal(0, 2, (side, side)), 0, 255).astype(np.uint8)


def row(i, p, extra="x"):
    return i, p.shape[1], p.shape[0], bytearray(p.tobytes()), extra


SCHEMA = "image_id long, width int, height int, pixels binary, kept string"


def test_cropped_and_edited_copies(spark):
    rows, groups = [], []
    for g in range(8):
        p = picture(g)
        own = [p, p.copy(), p[10:90, 5:85], np.clip(p * 0.7 + 30, 0, 255).astype(np.uint8), np.clip(p + np.random.default_rng(g).normal(0, 3, p.shape), 0, 255).astype(np.uint8), np.rot90(p).copy(), p[:, 24:]]
        groups.append([100 * g + k + 1 for k in range(len(own))])
        rows += [row(i, x) for i, x in zip(groups[-1], own, strict=True)]
    rows += [(9001, None, None, None, "x"), (9002, 5, 5, bytearray(b"abc"), "x"), (9003, 0, 0, bytearray(b""), "x"), (None, 8, 8, bytearray(64), "x"), row(9004, np.zeros((60, 60), np.uint8)), row(9005, np.zeros((60, 60), np.uint8)), row(1, picture(0))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.image_id: r for r in media.copies(df).collect()}
    assert media.copies(df).count() == len(rows)
    for g in groups:
        comps = [got[i].component_id for i in g]
        assert set(comps) == {g[0]}, comps
    assert [got[i].component_id for i in (9001, 9002, 9003, 9004, 9005, None)] == [9001, 9002, 9003, 9004, 9004, None]
    assert media.copies(df.limit(0)).count() == 0


def test_equals_trying_all_pairs(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 150")
    extra = vectors.where("vec_id < 30").selectExpr("vec_id + 1000 vec_id", "transform(embedding, (x, i) -> cast(x + (i % 3) / 2000 as float)) embedding", "label")
    images = media.rendered(vectors.unionByName(extra))
    shapes = {r.image_id: (np.frombuffer(r.places, np.float32).reshape(-1, 4), np.frombuffer(r.bits, np.uint8).reshape(-1, 32), set(r["keys"])) for r in media.features(images).collect()}
    ids = sorted(shapes)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if shapes[a][2] & shapes[b][2] and media.consistent(*shapes[a][:2], *shapes[b][:2]) >= media.LEAST_MATCHES]
    want = classes(ids, links)
    assert {r.image_id: r.component_id for r in media.copies(images).collect()} == want
    assert all(want[i + 1000] == want[i] for i in range(30))


def test_unlinked_images_of_a_bucket_make_no_rows_of_pairs(spark, monkeypatch):
    """Images that share a part, too little of it for a link, are compared inside tasks."""
    part = picture(900)[:40, :40]
    rows = []
    for i in range(40):
        p = picture(i)
        p[20:60, 20:60] = part
        rows.append(row(i, p))
    images = spark.createDataFrame(rows, SCHEMA)
    shapes = {r.image_id: (np.frombuffer(r.places, np.float32).reshape(-1, 4), np.frombuffer(r.bits, np.uint8).reshape(-1, 32), set(r["keys"])) for r in media.features(images).collect()}
    links = [(a, b) for a in shapes for b in shapes if a < b and shapes[a][2] & shapes[b][2] and media.consistent(*shapes[a][:2], *shapes[b][:2]) >= 25]
    made, write = {}, linking.written

    def record(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(linking, "written", record)
    assert {r.image_id: r.component_id for r in media.copies(images, least=25).collect()} == classes(sorted(shapes), links)
    assert made["media-open-2"].count() > 40
    assert not {"media-pairs-2", "media-pairs-3"} & made.keys()


#: Least share of the copies that the operator links, by edit; all pairs are tried by the geometric check alone.
RECALL = {"noise": 1.0, "crop": 1.0, "turn": 1.0, "0.9": 0.9, "0.8": 0.5, "0.7": 0.9}


def edited(p, kind, seed):
    if kind == "noise":
        return np.clip(p + np.random.default_rng(seed).normal(0, 8, p.shape), 0, 255).astype(np.uint8)
    if kind == "crop":
        return p[14:82, 14:82]
    if kind == "turn":
        return np.rot90(p).copy()
    n = round(len(p) * float(kind))
    return np.clip(media._resized(p[None].astype(np.float32), n, n)[0], 0, 255).astype(np.uint8)


def test_recall_by_edit():
    """By keys and check, and by the check alone; unlike pictures are not linked."""
    shapes = {}
    for g in range(20):
        for kind in ("", *RECALL):
            p = picture(g)
            _, where, bits = media.describe((edited(p, kind, g) if kind else p)[None])
            shapes[g, kind] = where, bits, set(media.block_keys(bits).tolist())
    same = lambda a, b: media.consistent(*a[:2], *b[:2]) >= media.LEAST_MATCHES
    alone, both = {}, {}
    for kind in RECALL:
        pairs = [(shapes[g, ""], shapes[g, kind]) for g in range(20)]
        alone[kind] = sum(same(a, b) for a, b in pairs) / 20
        both[kind] = sum(same(a, b) and bool(a[2] & b[2]) for a, b in pairs) / 20
    print(alone, both)
    assert all(both[k] >= v for k, v in RECALL.items()), (alone, both)
    assert not any(same(shapes[a, ""], shapes[b, ""]) for a in range(20) for b in range(a))


def test_broken_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan")] * 4), (6, [0.1] * 4)], "vec_id long, embedding array<double>")
    assert [r.pixels is None for r in media.rendered(df).orderBy("image_id").collect()] == [True, True, True, True, True, False]


def test_query(spark, sf):
    got = registry.op8_media_copies(spark, sf).collect()
    assert len({r.vec_id for r in got}) == 500 and sum(r.n_corners > 3 for r in got) > 490
