import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from mediacat.llm import pieces, registry

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = ["", " ", "▁", "  a  b ", "\n\t", "a\x00b", "<s></s><unk><0x41>", "é é ﬁ①²m²", "日本語🙂�﻿​", "　x\xa0y", "a" * 3000, " " * 3000, "ab▁ " * 500, "x" * 70 + " " + "x" * 70]


def test_encodes_and_decodes_as_the_library(library):
    own = pieces.pieces(MODEL)
    for text in ODD:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text).tolist() == want, text
        assert own.decode(want) == library.decode(want), text
        assert own.encode(text, begin=False, end=False).tolist() == library.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["the", "ing", " ", "  ", "\n", "▁", "==", ".", "²", "ab", "ba"])), max_size=30))
def test_any_text(parts):
    text = "".join(parts)
    want = sentencepiece_model().encode(text, add_bos=True, add_eos=True)
    assert pieces.pieces(MODEL).encode(text).tolist() == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262), st.sampled_from([0, 1, 2, 259, 28705, 264])), max_size=15))
def test_any_ids(ids):
    assert pieces.pieces(MODEL).decode(ids) == sentencepiece_model().decode(ids)


def sentencepiece_model(found=[]):  # noqa: B006
    if not found:
        found.append(sentencepiece.SentencePieceProcessor(model_file=MODEL))
    return found[0]


def test_random_pieces_side_by_side(library):
    own, draw = pieces.pieces(MODEL), random.Random(7)
    texts = ["".join(draw.choice(own.names[259:]) for _ in range(draw.randrange(1, 40))) for _ in range(3000)]
    assert [own.encode(t).tolist() for t in texts] == library.encode(texts, add_bos=True, add_eos=True)


def test_neighbours_of_an_encoding_are_compatible_and_others_are_not(library):
    own = pieces.pieces(MODEL)
    ids = library.encode("internationalisation of unbelievable, reoccurring misunderstandings")
    assert all(own.compatible(a, b) for a, b in zip(ids, ids[1:], strict=False))
    the = own.ids["the"]
    assert not own.compatible(own.ids["t"], own.ids["he"]) and own.merged("the") == ["the"] and the


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KEPT", 3)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 5)
    own = pieces.Pieces(MODEL)
    texts = ["one two three four five six seven one two nine ten"] * 3 + ODD
    assert [own.encode(t).tolist() for t in texts] == library.encode(texts, add_bos=True, add_eos=True)
    assert len(own.kept) <= 3 and len(own.older) <= 3 and len(own.pairs) <= 5


def test_whole_table_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op13_pieces"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d.doc_id] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, [1], "x"), (1, "a b", None, "y"), (None, "", [2], "z"), (2, "a b", [3], None), (2, "a b", [3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens string")
    ids = pieces.encode(docs, MODEL)
    got = sorted(((r.doc_id, r.ids) for r in ids.collect()), key=repr)
    ab = library.encode("a b", add_bos=True, add_eos=True)
    assert got == sorted([(1, [1, 2]), (1, ab), (None, [1, 2]), (2, ab), (2, ab)], key=repr)
    assert sorted(r.text for r in pieces.decode(ids, MODEL).collect()) == ["", "", "a b", "a b", "a b"]
    assert [r.text for r in pieces.decode(ids.selectExpr("doc_id", "cast(null as array<int>) ids").limit(1), MODEL).collect()] == [""]
    assert sorted(r.n_tokens for r in pieces.digests(docs, MODEL).collect()) == sorted([2, 2, len(ab), len(ab), len(ab)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(docs, MODEL).collect() == [] and pieces.decode(pieces.encode(docs, MODEL), MODEL).collect() == []
