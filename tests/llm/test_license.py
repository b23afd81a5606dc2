import re

from mediacat.llm import license

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    words = WORD.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.", None, "", "under the\x00mit\nlicense under the mit license", "CC BY-NC 4.0 cc by nc by nc", "xunder the mit license",
    "Apache License, Version 2.0 apache license version 20", "under the mit licenseé", "ÀPACHE é日本 cc\x7fby`nc", "w " * 100_000 + "cc by nc", "STRASSE K under the MIT license",
]


def test_equals_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "cc by nc"), (3, TEXTS[3])]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.scan(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert license.scan(docs.limit(0)).count() == 0


def test_expressions():
    p = license.parse_expression
    assert p("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0 */") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "WITH", "AND", "OR"]
    assert p("(MIT or isc) and BSD-3-Clause") == ["MIT", "isc", "OR", "BSD-3-Clause", "AND"]
    assert p("MIT AND") is None and p("(MIT") is None and p("") is None and p(") MIT") is None
    assert license.names(p("GPL-2.0 WITH Classpath-exception-2.0 OR MIT")) == {"gpl-2.0", "mit"}
    e = license.evaluate
    assert e(p("MIT OR GPL-3.0"), {"mit"}) and not e(p("MIT AND GPL-3.0"), {"mit"}) and e(p("GPL-2.0 WITH x"), {"gpl-2.0"})
    assert not e(p("(MIT OR ISC) AND Zlib"), {"mit", "isc"})


def test_tags_and_notices():
    s = license.Scanner()
    got = s.scan("// SPDX-License-Identifier: MIT OR Apache-2.0\nunder the GNU General Public License")
    assert got[5] == {"mit", "apache-2.0", "gpl"} and got[6] == ["MIT Apache-2.0 OR"] and got[7] == 1.0 and got[1] == 0
    assert s.scan("nothing")[7] == 0.0
    assert got[8] is False and s.scan("nothing")[8] is None


def test_verdicts(spark):
    """Each text's verdict against trying all ways to choose one side of every or."""
    tag = "SPDX-License-Identifier: "
    texts = {
        f"{tag}MIT OR GPL-3.0-only": True, f"{tag}MIT AND GPL-3.0-only": False, f"{tag}(MIT OR ISC) AND Zlib": True, f"{tag}GPL-2.0-only WITH Classpath-exception-2.0": False, f"{tag}MIT WITH x": True,
        f"{tag}MIT AND": None, f"{tag}MIT\nall rights reserved": False, f"{tag}MIT\n{tag}AGPL-3.0-only": False, "under the MIT license": True, "cc by nc": False, "under the MIT license cc by nc": False, "": None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.permitted for r in license.scan(df).orderBy("doc_id").collect()] == list(texts.values())
    assert [r.permitted for r in license.scan(df, allowed=frozenset({"gpl-3.0-only"})).orderBy("doc_id").collect()][:2] == [True, False]


def test_evaluation_equals_all_choices():
    import itertools
    import random

    rng = random.Random(2)
    names = ["a", "b", "c", "d"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            n = rng.choice(names)
            return n, lambda ok: n in ok
        (x, f), (y, g), op = tree(depth - 1), tree(depth - 1), rng.choice(["AND", "OR"])
        return f"({x} {op} {y})", (lambda ok: f(ok) and g(ok)) if op == "AND" else (lambda ok: f(ok) or g(ok))

    for _ in range(200):
        text, holds = tree(4)
        for n in range(5):
            for ok in itertools.combinations(names, n):
                assert license.evaluate(license.parse_expression(text), set(ok)) == holds(set(ok))


def test_many_places_take_linear_time():
    import time

    s = license.Scanner()
    took = []
    for n in (4000, 16000):
        began = time.thread_time()
        got = s.scan("cc by nc w " * n)
        took.append(time.thread_time() - began)
        assert got[:4] == (4 * n, n, 0, 4 * n - 4)
    assert took[1] < 10 * took[0]
