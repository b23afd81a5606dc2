import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediacat.llm import lines, packing

from .brute import WORD, classes, lower, near_links, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over a small table, written and read again as a run does."""
    sf = "/root/testdata/sf0.001"
    extra = [(9001, None, None, None, None), (9002, "123 ...", "en", "s", 7), (None, "the end of this here text", "en", "s", 25), (9003, "", "en", "s", 0), (9004, "\n".join(["the same line of text"] * 3), "en", "s", 65)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(extra, SCHEMA))
    out, base = [], tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(f"{base}/{i}")
        made = spark.read.parquet(f"{base}/{i}")
        out.append((docs, made))
        docs = made
    return out


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()


def test_language(stages):
    before, after = stages[0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone == {9001, 9002, 9003}


def test_lines(stages):
    before, after = stages[1]
    seen = {}
    for doc, text in sorted((r.doc_id, r.text) for r in before.collect() if r.doc_id is not None):
        for n, line in enumerate(text.split("\n")):
            if key := lines.normalised(line):
                seen.setdefault(key, (doc, n))
    kept = {r.doc_id: r for r in after.collect()}
    assert kept[9004].text == "the same line of text" and kept[9004].n_chars == 21 and None in kept
    first = {}
    for doc, r in kept.items():
        assert r.n_chars == len(r.text)
        for line in r.text.split("\n"):
            if doc is not None and (key := lines.normalised(line)):
                assert first.setdefault(key, doc) == doc == seen[key][0]  # the first occurrence, and once


def test_near_duplicates(stages):
    before, after = stages[2]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before.collect() if r.doc_id is not None}
    comp = classes(sets, near_links(sets, 80))
    assert {r.doc_id for r in after.collect()} == {d for d in sets if comp[d] == d} | {None}


def test_decontamination(stages, spark):
    before, after = stages[3]
    items = [WORD.findall(lower(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]

    def leaks(text):
        words = " ".join(WORD.findall(lower(text)))
        return any(len(p) >= 5 and f" {' '.join(p)} " in f" {words} " for p in items)

    kept, given = {r.doc_id for r in after.collect()}, {r.doc_id: r.text for r in before.collect()}
    assert all(doc not in kept for doc, text in given.items() if leaks(text))
    assert len(given) - len(kept) <= 3 * max(1, sum(map(leaks, given.values())))


def test_packing(stages):
    before, after = stages[4]
    encode = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {r.doc_id: len(encode([r.text])[0]) + 1 for r in before.collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == stages[-1][1].columns and got.count() > 0
