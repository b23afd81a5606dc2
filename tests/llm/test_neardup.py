import random

import numpy as np
import pyarrow as pa

from mediacat.llm import linking, neardup, registry, shared

from .brute import WORD, classes, lower, near_links, shingle_set


def expected(rows, k, percent):
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    comp = classes(sets, near_links(sets, percent))
    return sorted(((d, len(shingle_set(t, k)), comp.get(d), comp.get(d, d) == d) for d, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_edge_rows(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    rows = [(9, "One two three"), (3, "one TWO  three"), (4, "one two three four"), (5, ""), (6, None), (7, " \n\t"), (None, "one two three"), (8, long), (2, long + " tail"), (11, "É one"), (12, "é one"), (3, "one TWO  three"), (13, "a b c"), (14, "a b c")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, kept string, component_id int")
    for k in (4, 5):
        assert got(neardup.near_duplicates(df, k)) == expected(rows, k, 80)
    assert got(neardup.near_duplicates(df.limit(0))) == []


def planted(seed, n_near):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.03, 0.06]))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    base = [word() for _ in range(120)]
    for _ in range(n_near):  # one large group, whose members are not all linked with each other
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = word()
        rows.append(" ".join(own))
    for _ in range(n_near):  # one passage that many unlike documents share
        rows.append(" ".join([word() for _ in range(rng.choice([10, 20, 90]))] + passage))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_large_groups_equal_brute_force(spark):
    rows = planted(2, 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(neardup.near_duplicates(df, 4)) == expected(rows, 4, 80)


def test_links_across_rounds(spark):
    """Links that only later keys show, in a bucket of all ids, are found without trying all pairs."""
    rng = random.Random(4)
    ids = list(range(400))
    keys = {i: [7, *([3] if i < 100 else [rng.randrange(10**9)]), *([5] if i in (50, 201, 203, 350) else []), rng.randrange(10**9)] for i in ids}
    links = {(i, i + 1) for i in range(99)} | {(201, 203), (50, 350)} | {(0, i) for i in range(60)}
    items = spark.createDataFrame([(i, k, i % 2) for i, k in keys.items()], "id long, keys array<long>, odd long")
    good = spark.createDataFrame(sorted(links), "a long, b long")
    tried = []

    def verify(pairs):
        tried.extend(pairs.collect())
        return pairs.join(good, ["a", "b"], "left_semi")

    near = lambda a, b: np.where(np.abs(a[0] - b[0]) <= 1, 1.0, np.inf)
    made, _ = linking.linked_classes([(items, 4 * len(ids))], items.drop("keys"), near, verify, "t")
    assert {r.id: r.component for r in made.collect()} == {i: c for i, c in classes(ids, links).items() if any(i in x for x in links)}
    assert len(tried) == len(set(tried)) < 400 * 399 // 2


def test_links_across_rounds_without_rows_of_pairs(spark, monkeypatch):
    """The same links, found inside groups that are dealt out as pairs of small chunks."""
    monkeypatch.setattr(linking, "CHUNK", 16 * 40)
    rng = random.Random(4)
    keys = {i: [7, *([3] if i < 100 else [rng.randrange(10**9)]), *([5] if i in (50, 201, 203, 350) else []), rng.randrange(10**9)] for i in range(200)}
    links = {(i, i + 1) for i in range(49)} | {(101, 103), (50, 150), (60, 199), (199, 61)} | {(0, i) for i in range(30)}
    pairs = {(min(x), max(x)) for x in links}
    items = spark.createDataFrame([(i, k, i % 2) for i, k in keys.items()], "id long, keys array<long>, odd long")
    good = spark.createDataFrame(sorted(pairs), "a long, b long")
    near = lambda a, b: np.where(np.abs(a[0] - b[0]) <= 1, 1.0, np.inf)
    tried = []

    def verify(some):
        tried.extend(some.collect())
        return some.join(good, ["a", "b"], "left_semi")

    texts = (lambda ids: ids.select("id", ids["id"].cast("string").alias("line")), lambda a, b: (min(int(a), int(b)), max(int(a), int(b))) in pairs)
    made, _ = linking.linked_classes([(items, 800)], items.drop("keys"), near, verify, "t", texts=texts)
    assert {r.id: r.component for r in made.collect()} == {i: c for i, c in classes(range(200), pairs).items() if any(i in x for x in pairs)}
    assert len(tried) < 2000


def test_nearly_similar_documents_make_no_rows_of_pairs(spark, monkeypatch):
    """Documents just below the threshold share buckets and stay unlinked; rows of pairs grow with their number only."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    rows = []
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(200), 20):
            own[6 * at + 3] = f"n{i}x{at}"
        rows.append((i, " ".join(own)))
    tried = []
    confirm = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *more: tried.append(pairs.count()) or confirm(pairs, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(neardup.near_duplicates(df, 4)) == expected(rows, 4, 80)
    assert sum(tried) < 40 * len(rows)


def test_small_buckets_have_no_members():
    """Of up to three ids of a key all pairs are given, so only larger buckets have members; of those all."""
    ids = {5: [1, 2], 6: [1, 2, 3], 7: [1, 2, 3, 4], 8: [3, 1, 1], 9: [4]}
    entries = np.array([(k, i) for k, some in ids.items() for i in some], np.int64)
    for cut in (0, 4, 8):  # what tasks hold is combined, then what they deal out
        made = [linking._ends(part) for part in (entries[:cut], entries[cut:]) if len(part)]
        sides = [np.concatenate([m[kind] for m in made]) for kind in (linking.ENTRIES, linking.PAIRS, linking.MEMBERS, linking.MARKS)]
        out = linking._met(*sides)
        members = set(map(tuple, out[linking.MEMBERS].tolist()))
        assert {(7, i) for i in ids[7]} <= members and not {k for k, _ in members} & {5, 8, 9}
        pairs = set(map(tuple, out[linking.PAIRS].tolist()))
        assert {(1, 2), (1, 3), (2, 3)} <= pairs and all(a < b for a, b in pairs)


def test_one_pair_a_member_of_a_bucket():
    """Whatever tasks hold of a bucket, it makes one pair for each of its members, not two."""
    rng = np.random.default_rng(5)
    ids = rng.choice(1 << 40, 1000, replace=False)
    entries = np.stack([np.full(1000, 7), ids], 1)
    for tasks in (1, 4, 50):
        made = [linking._ends(part) for part in np.array_split(entries, tasks)]
        sides = [np.concatenate([m[kind] for m in made]) for kind in (linking.ENTRIES, linking.PAIRS, linking.MEMBERS, linking.MARKS)]
        out = linking._met(*sides)
        assert set(map(tuple, out[linking.MEMBERS].tolist())) == set(map(tuple, entries.tolist()))
        pairs = out[linking.PAIRS]
        assert len(pairs) < 1000 and (pairs[:, 0] < pairs[:, 1]).all() and set(pairs[:, 1].tolist()) == set(ids.tolist()) - {ids.min()}


def test_filter_keeps_what_is_asked_for(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id as string) text")
    got = {r.id for r in linking.thinned(rows, spark.range(990, 1010), "id").collect()}
    assert set(range(990, 1000)) <= got and len(got) < 100


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op2_near_duplicates(spark, "/root/testdata/sf0.01")) == expected(rows, 4, 80)


def test_word_and_shingle_hashes_follow_the_words():
    texts = ["a b", "", "a  b ", "ab", None, "x a b y", "A\u000bB", " a b"]
    ((first, _, data, offsets),) = shared.string_slices(pa.array(texts))
    hashes, at = shared.word_hashes(data, offsets)
    by_word = {}
    for i, t in enumerate(texts):
        words = WORD.findall(lower(t or ""))
        assert at[i + 1] - at[i] == len(words)
        for w, h in zip(words, hashes[at[i] : at[i + 1]], strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    s, where = shared.shingles(hashes, at, 2)
    for i, t in enumerate(texts):
        assert len(np.unique(s[where[i] : where[i + 1]])) == len(shingle_set(t, 2))
    assert s[where[0]] == s[where[2]] == s[where[6]] and s[where[5] + 1] == s[where[0]]


def test_bands_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(0)
    same, agree = [], []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        bands, sketch = neardup.signatures([np.unique(pool[:900]), np.unique(pool[100:])])
        agree.append(128 - sum(int(x).bit_count() for x in sketch[0] ^ sketch[1]))
        same.append((bands[0] == bands[1]).mean())
    assert abs(np.mean(same) - 0.8**neardup.ROWS) < 0.05
    assert min(agree) >= neardup.least_bits(128, 80) and abs(np.mean(agree) - 115.2) < 2


def test_members_of_buckets_meet_their_classes_by_id(spark, monkeypatch):
    """Near copies share many buckets; members that are looked up are a row an id, not one for each of its keys."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(60)]
    made = {}
    write = linking.written

    def record(df, name):
        made[name] = write(df, name)
        if name == "neardup-members":
            made["ids"], made["rows"] = made[name].select("id").distinct().count(), made[name].count()
        return made[name]

    monkeypatch.setattr(linking, "written", record)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in neardup.near_duplicates(df, 4).collect()} == {0}
    assert made["ids"] == made["rows"] == 60


def test_components_of_one_and_of_many_lots(spark, monkeypatch):
    """Chains, stars and rings, also if tasks see a few edges at a time; short lists make no rounds."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(i, 600 + (i + 1) % 20) for i in range(600, 620)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] * 2
    rng.shuffle(edges)
    expected = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {i: 600 for i in range(600, 620)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    names = []
    write = shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: names.append(name) or write(df, name))
    for lot in (1 << 16, 16):
        monkeypatch.setattr(shared, "CONTRACTED", lot)
        names.clear()
        found = [(r.id, r.component) for r in shared.components(df).collect()]
        assert len(found) == len(expected) and dict(found) == expected
        assert lot == 16 or len(names) == 2
    assert shared.components(df.limit(0)).count() == 0
