"""License scans: Aho-Corasick over normalised words, and licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase -> label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases -> label.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Labels and identifiers that a corpus may contain, in lower case; an argument of :func:`scan`.
ALLOWED = frozenset({"mit", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "0bsd", "cc0-1.0", "zlib"})
#: Identifier tags; what follows on the line is a licence expression.
TAGS = ("spdx license identifier",)
_TAG = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n*]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Binding strengths in a licence expression; ``with`` binds closest.
BINDING = {"OR": 1, "AND": 2, "WITH": 3}


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in postfix order, by the shunting-yard method; None if it is malformed.

    Operators are and, or, with in any case; names and brackets are the operands. Text after a complete expression (a
    comment's end, say) is left out: parsing stops at the first token that cannot follow.
    """
    out: list[str] = []
    ops: list[str] = []
    wants_name = True
    for token in _TOKEN.findall(text):
        upper = token.upper()
        if wants_name:
            if token == "(":
                ops.append(token)
            elif token == ")" or upper in BINDING:
                return None
            else:
                out.append(token)
                wants_name = False
        elif upper in BINDING:
            while ops and ops[-1] != "(" and BINDING[ops[-1]] >= BINDING[upper]:
                out.append(ops.pop())
            ops.append(upper)
            wants_name = True
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break
    if wants_name or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str], allowed: set[str]) -> bool:
    """Whether the licences in ``allowed`` (lower case) satisfy the expression; an exception (with) only adds rights."""
    stack: list = []
    for token in postfix:
        if token in BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "WITH" else (left and right) if token == "AND" else (left or right))
        else:
            stack.append(token.lower() in allowed)
    return stack[0]


def names(postfix: list[str]) -> set[str]:
    """The licences (exceptions left out) that an expression names, in lower case."""
    stack: list[tuple[set, bool]] = []
    for token in postfix:
        if token in BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "WITH" else left | right)
        else:
            stack.append({token.lower()})
    return stack[0]


class Scanner:
    """An Aho-Corasick automaton over all phrases; words are matched whole, places may overlap."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple = TAGS, allowed: frozenset[str] = ALLOWED):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {t: "" for t in tags})):
            for phrase, label in phrases.items():
                kinds.setdefault(f" {phrase} ", []).append((kind, label))
        for phrase, what in kinds.items():
            self.found.add_word(phrase, (phrase.count(" ") - 1, what))
        self.found.make_automaton()
        self.allowed = allowed

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, expressions, score and permitted of a whole text."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        places: list[int] = []
        base, labels, expressions, tagged = set(), set(), [], False
        tags: set[str] = set()
        permitted: bool | None = None
        spaces = last = 0  # blanks before the last match's end
        for end, (length, what) in self.found.iter(joined):
            spaces, last = spaces + joined.count(" ", last, end), end
            for kind, label in what:
                if kind == "base":
                    places.append(spaces - length)
                    base.add(label)
                elif kind == "notice":
                    labels.add(label)
                else:
                    tagged = True
        if tagged:
            for m in _TAG.finditer(text):
                if postfix := parse_expression(m[1]):
                    expressions.append(" ".join(postfix))
                    tags |= names(postfix)
                    permitted = permitted is not False and evaluate(postfix, self.allowed)
        # a notice binds like an expression of one name
        if base or labels:
            permitted = permitted is not False and base | labels <= self.allowed
        labels |= tags
        # a tag states a licence, a notice nearly so
        score = 1.0 if expressions else 0.95 if base else 0.8 if labels else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), base, base | labels, expressions, score, permitted


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double, permitted boolean"
_types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.bool_()]
_names = [x.split()[0] for x in SCHEMA.split(", ")]


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple = TAGS, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """Scans every whole text: one row per document, no shuffle.

    A word is a run of a-z (A-Z lower-cased), 0-9 or non-ASCII characters. ``n_base`` counts every place where the words of
    a base phrase stand consecutively, overlapping ones too; ``first_word`` and ``last_word`` are their smallest and largest
    start. Labels are distinct, sorted and comma-joined; none is the empty string. ``permitted`` tells whether the licences in
    ``allowed`` satisfy every expression and include every notice's label; it is null where there is neither. Null text counts as empty. Null and
    repeated doc_ids are carried through; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags, allowed)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, places, lo, hi, own, labels, expressions, score, permitted = scanner.scan(text or "")
                    rows.append((doc, n, places, lo, hi, ",".join(sorted(own)), ",".join(sorted(labels)), expressions, score, permitted))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _types, strict=True)], names=_names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
