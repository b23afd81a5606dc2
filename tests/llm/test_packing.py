import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mediacat.llm import packing

TEXTS = [
    (0, "short"), (1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "no id"),
    (4, "Ünï côde — 日本語 😀\r\n\t  spaces   end  "), (5, "<|endoftext|> is text here"), (6, "a" * 3000), (7, "don't we'll 123,456.78 ___ $$$&&& \x00\x1f"),
]


def test_ids_equal_the_tokenizers_library_and_every_id_is_in_one_piece(spark, sf):
    rows = TEXTS + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string").repartition(3)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    for doc, text in {(d, t) for d, t in rows if d != 3 and d is not None}:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc].sort_values("start")
        assert own.start.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert got[got.doc_id == 3].length.sum() == 2 * got[got.doc_id == 3].doc_tokens.iloc[0]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist()
        assert (own.sequence_tokens == own.length.sum()).all() and own.length.sum() <= 1024
        assert own.length.sum().bit_count() == 1  # a full window, or a power of two: no padding at all


def test_level_choice_equals_brute_force():
    rng = np.random.default_rng(3)
    packer = packing.LevelPacker(32, 0)
    for _ in range(500):
        s = int(rng.integers(1, 32))
        before = packer.level.copy()
        best = {}
        for h in range(0, 32 - s + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            if h + s < 32:
                after[h + s] += 1
            best[h] = int((after[1:32] ** 2).sum())
        packer.place((s, None))
        assert int((packer.level[1:32] ** 2).sum()) == min(best.values())
        assert all(len(packer.open[h]) == packer.level[h] for h in range(1, 32))


def test_open_windows_are_bounded(spark):
    """Pieces of more than half a window never meet; what is held does not grow with their number."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 600) text")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), most_open=64).toPandas()
    tokens = got.drop_duplicates("doc_id").doc_tokens
    assert 512 < tokens.iloc[0] < 1024 and got.length.sum() == tokens.sum()
    sizes = got.groupby("sequence_id").agg(n=("length", "sum"), first=("doc_id", "min"), last=("doc_id", "max"))
    assert (sizes.n == 1024).sum() >= len(sizes) - 10 and all(int(n).bit_count() == 1 for n in sizes.n)
    assert (sizes["last"] - sizes["first"]).max() < 200  # documents leave soon after they came


def test_ids_equal_the_tokenizers_library_over_a_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    fast, named = (packing.byte_bpe(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json"))
    assert fast(texts) == named(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_json_vocabulary_gives_the_same_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    a, b = (packing.pack(docs, public_tokenizers.path(f"byte_bpe_50k.{x}")).collect() for x in ("tiktoken", "json"))
    assert a == b
