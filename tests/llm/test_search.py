import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mediacat.llm import search

from .brute import lower

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(lower(text or ""))


def brute(docs, items, k):
    """Every document scored for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            n = sum(bag.values())
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in words(text) if t in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -score) for rank, (score, missing, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(3)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in search.ranked(d, b, k, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "a1"]
    text = lambda n: " ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(draw.choice([0, 1, 3, 20, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7 + 10][1]) for i in range(90)]  # copies: ties
    docs += [(5, "again w1 w2"), (5, "again w1 w2"), (5, "other w3"), (None, "w1 W2 w3"), (None, None), (7, None), (8, ""), (9, " ,.;\x00\x7f"), (2000, "w1 " * 30_000)]
    items = [(i, text(12)) for i in range(20)] + [(1, "w1 w1 w1"), (1, "w1 w1 w1"), (None, "É é 日本"), (90, None), (91, ""), (92, "nowhere at all"), (93, docs[12][1])]
    return docs, items


@pytest.mark.parametrize(("k", "shard_words", "block_words"), [(20, 1 << 20, 1 << 20), (1, 50, 1 << 20), (5, 1000, 20), (500, 300, 1 << 20)])
def test_equals_scoring_everything(spark, corpus, k, shard_words, block_words):
    assert found(spark, *corpus, k, shard_words=shard_words, block_words=block_words) == brute(*corpus, k)


def test_prunes_and_is_exact_for_any_batch_of_nodes(corpus):
    docs = [(i, t) for i, t in corpus[0] if words(t) and i is not None]
    bags = [words(t) for _, t in docs]
    vocabulary = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
    known = search.Statistics(len(bags), sum(map(len, bags)))
    made = search.shard([i for i, _ in docs], np.array([vocabulary[t] for b in bags for t in b], np.uint64), np.array([len(b) for b in bags]), known)
    ends = np.frombuffer(made["ends"], "<u4").astype(np.int64)
    tree = search.Tree(ends, np.frombuffer(made["impacts"], "<u4"), made["bits"], made["n_docs"])
    ids = np.frombuffer(made["doc_ids"], "<i8")
    spans = [(int(tree.starts[vocabulary[t]]), int(ends[vocabulary[t]]), 1000) for t in ("w3", "w9", "É".lower() if "É".lower() in vocabulary else "É")]
    results, looked = [], []
    for at_once in (1, 7, 10_000):
        best = search.Best(3)
        looked.append(search.search(tree, spans, ids, best, at_once))
        results.append((best.score.tolist(), best.id.tolist()))
    assert results[0] == results[1] == results[2]
    assert looked[0] < looked[2] and looked[0] < len(docs)


def test_lists_are_sorted_by_impact_in_every_node(corpus):
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 40, 70)
    made = search.shard(list(range(70)), draw.integers(0, 9, sizes.sum()).astype(np.uint64), sizes, search.Statistics(70, int(sizes.sum())))
    ends = np.frombuffer(made["ends"], "<u4").astype(np.int64)
    tree = search.Tree(ends, np.frombuffer(made["impacts"], "<u4"), made["bits"], 70)
    zero = np.zeros(len(ends), np.int64)
    f = search.Frontier(zero[:1], zero[:1], zero[:1], np.array([len(ends)]), tree.starts[:-1], ends, zero + 1)
    for _ in range(tree.depth):
        f = search._children(tree, f)
        for level, lo, hi in zip(np.repeat(f.level, f.size), f.lo, f.hi, strict=True):
            part = tree.impact[level * tree.step + lo : level * tree.step + hi]
            assert (np.diff(part) <= 0).all()
    assert (f.hi - f.lo == 1).all() and (f.prefix < 70).all() and len(f.prefix) == 70


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
