import hashlib
import re

import pytest

from mediacat.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", " ", "\t\n  \x0b", "word", " word ", "a b  c\n\nd\x0ce \r\n", "<P>", "x <S> y", "a<M", "a <", "< S> <P", "ends in < <", "é 日本 🙂🙂   　 x",
    "\x1c\x85  x y", "none" * 50_000, " " * 50_000, "w " * 30_000, "same text", "same text", "\\ $1 [a] 'q' \"", "<<P <<S <<M >> P> S> M>",
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "x", i) for t in TEXTS for i in (*range(12), None)]
    return data, spark.createDataFrame(data, "doc_id long, text string, output string, n int")


def test_equals_brute_force(rows):
    data, docs = rows
    got = fim.transform(docs).select("doc_id", "n", "form", "prefix", "middle", "output").collect()
    got = [(r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in got]
    assert sorted(got, key=repr) == sorted((brute(i, t) for i, t, _, _ in data), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_restores_every_text(rows):
    data, docs = rows
    made = fim.transform(docs)
    back = sorted(r.t for r in made.select(fim.restored().alias("t")).collect())
    assert back == sorted(t or "" for _, t, _, _ in data)
    digests = fim.digests(made).collect()
    assert sorted(d.restored_sha256 for d in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in data)
    assert all((d.prefix_chars is None) == (d.form == "plain") for d in digests)


def test_parts_joined_with_sentinels_do_not_form_others(spark):
    texts = ["a< b< c<", "<S <S <S", "<M <P <S x", "P> S> M>"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = fim.transform(docs, rate=100).select("doc_id", "form", fim.restored().alias("t")).collect()
    assert all(r.form != "plain" and r.t == texts[r.doc_id] for r in got)


def test_no_python_and_no_shuffle(spark, sf):
    plan = fim.digests(fim.transform(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.transform(docs)).collect() == []
