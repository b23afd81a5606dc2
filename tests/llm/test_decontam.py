import random

import numpy as np

from mediacat.llm import decontam, registry

from .brute import WORD, lower


def brute_tiles(p, d, least):
    """Greedy string tiling by trying every pair of starts."""
    used_p, used_d, out = set(), set(), []
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(d)):
                n = 0
                while i + n < len(p) and j + n < len(d) and p[i + n] == d[j + n] and i + n not in used_p and j + n not in used_d:
                    n += 1
                if n >= least:
                    best.append((n, i, j))
        if not best:
            return out
        longest = max(best)[0]
        for n, i, j in sorted(best):
            if n == longest and not used_p & set(range(i, i + n)) and not used_d & set(range(j, j + n)):
                used_p |= set(range(i, i + n))
                used_d |= set(range(j, j + n))
                out.append((j, i, n))


def test_tiles_equal_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        p = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        d = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        for least in (2, 3):
            assert decontam.tiles(np.array(p, np.uint64), np.array(d, np.uint64), least) == brute_tiles(p, d, least)


def brute(docs, items, least=5, coverage=0.6):
    out = []
    for doc, text in docs:
        d = WORD.findall(lower(text or ""))
        grams = {tuple(d[i : i + least]) for i in range(len(d) - least + 1)}
        for item, own in items:
            p = WORD.findall(lower(own or ""))
            reach = set()
            for i in range(len(p) - least + 1):
                if tuple(p[i : i + least]) in grams:
                    reach |= set(range(i, i + least))
            if p and len(reach) >= coverage * len(p):
                made = brute_tiles(p, d, least)
                if made and sum(t[2] for t in made) >= coverage * len(p):
                    out.append((doc, item, sum(t[2] for t in made), len(made), sorted(made)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.covered, r.n_tiles, sorted((t.doc_word, t.item_word, t.words) for t in r.tiles)) for r in df.collect()), key=str)


def test_edge_rows_and_blocks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, item), (2, item), (3, None), (4, "too short"), (5, "x " * 30), (6, ""), (7, "one two three four five"), (8, "fünf sechs sieben acht neun zehn")]
    docs = [
        (1, f"before {item.upper()} after"), (2, "zeta eta theta iota kappa and alpha beta gamma delta epsilon"), (3, "alpha beta gamma delta nothing"), (4, None), (5, ""), (6, "x " * 12),
        (None, item), (7, "one two three four five"), (7, "one two three four five"), (8, "alpha beta gamma delta epsilon X zeta eta theta iota"), (9, f"{'word ' * 20000}{item} {item}"), (10, "fünf sechs sieben acht neun"), (11, "one two three four five"),
    ]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc_id string")
    want = brute([x for x in docs if x[0] != 9], items) + [(9, 1, 10, 1, [(20000, 0, 10)]), (9, 2, 10, 1, [(20000, 0, 10)])]
    for block in (decontam.BLOCK_WORDS, 8):
        assert got(decontam.leaks(d, b, block_words=block)) == sorted(want, key=str)
        left = decontam.without_leaks(d, b, block_words=block)
        bad = {x[0] for x in want}
        assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x[0]) for x in docs if x[0] not in bad)
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0 and decontam.without_leaks(d, b.limit(0)).count() == len(docs)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = got(registry.op1_decontaminate(spark, sf))
    assert found and found == brute(docs, items)
