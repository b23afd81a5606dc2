"""SentencePiece encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The sign that stands for a space inside pieces.
SPACE = "▁"
#: Chunks whose ids a task keeps (twice as many for a time, some 100 MB); longer chunks are encoded each time.
MOST_KEPT, LONGEST_KEPT = 300_000, 64
#: Pairs of tokens whose compatibility a task keeps.
MOST_PAIRS = 2_000_000


class Pieces:
    """A BPE model with byte fallback, without normalisation, as the sentencepiece library applies it.

    The library merges, again and again, the adjacent pair whose concatenation is the piece of the highest score, the leftmost of equal
    ones. Then tokens are a text's encoding if and only if each two neighbours are the encoding of their own concatenation: the first
    merge across one of their borders would also be the first in those two alone. So each prefix of a text has one last token: of the
    pieces that end there (matches of an automaton) the one that is compatible with the last token of the prefix before it. One look at
    each match fills the table; the ids are then read from the end.
    """

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        self.bos, self.eos, self.unk = library.bos_id(), library.eos_id(), library.unk_id()
        self.names = [library.id_to_piece(i) for i in range(n)]
        self.score = [library.get_score(i) for i in range(n)]
        self.control = {i for i in range(n) if library.is_control(i)}
        self.byte = {int(self.names[i][3:-1], 16): i for i in range(n) if library.is_byte(i)}
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i) or library.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if self.merged(name) == [name]:  # others are no encoding of themselves and never stand in one
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.known = {c for name in self.ids for c in name if c in self.ids}
        self.parts = re.compile(f"[{re.escape(''.join(sorted(self.known)))}]+|[^{re.escape(''.join(sorted(self.known)))}]+", re.DOTALL)
        # a space sign follows no other sign inside a piece, so no token crosses a border before a word; nor, in most models, one
        # between a letter and another sign
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("pieces that cross a space are not supported")
        letters = {c for c in self.known if c.isalpha()}
        crossed = any((a in letters) != (b in letters) and SPACE not in (a, b) for name in self.ids for a, b in zip(name, name[1:], strict=False))
        run = "" if crossed else f"[{re.escape(''.join(sorted(letters)))}]+|{SPACE}*[^{SPACE}{re.escape(''.join(sorted(letters)))}]+|{SPACE}*"
        self.chunks = re.compile(f"{SPACE}*{run}[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        shown = [self.names[i].encode() for i in range(n)]
        for value, i in self.byte.items():
            shown[i] = bytes([value])
        for i in self.control:
            shown[i] = b""
        shown[self.unk] = " ⁇ ".encode()
        self.shown = [x.replace(SPACE.encode(), b" ") for x in shown]
        self.shown_of = self.shown.__getitem__
        for probe in ("", " ", "Some text,  with\tspaces é\U0001f642 ①\x00 <s>" + SPACE):
            ids = library.encode(probe, add_bos=True, add_eos=True)
            if self.encode(probe).tolist() != ids or self.decode(ids) != library.decode(ids):
                raise ValueError("the model is not a byte-fallback BPE without normalisation")

    def merged(self, text: str) -> list[str]:
        """The merge process itself, for pieces and pairs of pieces, which are short."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their concatenation."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            x, y = self.names[a], self.names[b]
            found = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return found

    def tokens(self, text: str) -> list[int]:
        """Ids of a text of known characters: the table of last tokens, then back from the end."""
        last = [-1] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if end == length:
                last[end] = token
            elif before >= 0:
                fits = pairs.get((before, token))
                if compatible(before, token) if fits is None else fits:
                    last[end] = token
        out = []
        at = len(text)
        while at:
            out.append(last[at])
            at -= len(self.names[last[at]])
        out.reverse()
        return out

    def chunk(self, text: str) -> bytes:
        """Little-endian ids of a run of spaces with the word behind it; characters of no piece give their bytes."""
        if text in self.older:
            self.keep(text, self.older[text])
            return self.kept[text]
        ids: list[int] = []
        for part in self.parts.findall(text):
            ids += self.tokens(part) if part[0] in self.known else [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        made = np.array(ids, "<u4").tobytes()
        if len(text) <= LONGEST_KEPT:
            self.keep(text, made)
        return made

    def keep(self, text: str, made: bytes) -> None:
        if len(self.kept) >= MOST_KEPT:
            self.older, self.kept = self.kept, {}
        self.kept[text] = made

    def encode(self, text: str, begin: bool = True, end: bool = True) -> np.ndarray:
        """Ids of a text, a space being put before it unless it is empty."""
        kept, chunk = self.kept.get, self.chunk
        found = self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []
        body = b"".join([kept(c) or chunk(c) for c in found])
        ids = np.frombuffer(body, "<u4")
        return np.concatenate([np.full(int(begin), self.bos, "<u4"), ids, np.full(int(end), self.eos, "<u4")])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: without the space put before it, runs of byte tokens read as UTF-8, a byte that is part of no
        character as U+FFFD."""
        if not self.control.isdisjoint(ids[1:-1]):  # a control token also ends a run of byte tokens
            parts, at = [], 0
            for i, token in enumerate(ids):
                if token in self.control:
                    parts.append(ids[at:i])
                    at = i + 1
            parts = [p for p in (*parts, ids[at:]) if p]
        else:
            parts = [[t for t in ids[:1] if t not in self.control] + ids[1:-1] + [t for t in ids[1:][-1:] if t not in self.control]]
        text = "".join([_text(b"".join(map(self.shown_of, p))) for p in parts])
        return text[1:] if parts and parts[0] and self.names[parts[0][0]].startswith(SPACE) else text


_CHARACTER = re.compile(
    rb"([\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})|(.)",
    re.DOTALL,
)


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "".join(good.decode() if good else "\ufffd" for good, _ in _CHARACTER.findall(data))


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The model of a file that every executor has, loaded once a worker."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _by_row(rows: DataFrame, names: list[str], kinds: list[pa.DataType], make, sql: str) -> DataFrame:
    """``make`` of the second column for each row, some at a time, behind the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                made = list(zip(*[make(x) for x in part.column(1)], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)]], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id long, {sql}")


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, ids) of every whole text.

    Texts are cut before each run of spaces, which no token crosses, and a task keeps the ids of short chunks that it has met. Time grows
    with the length of a text, one word of any length included. No shuffle. Null text counts as empty and gets the begin and end ids alone;
    null and repeated keys are carried through, a row each; an empty table gives no rows; other columns are not read.
    """
    return _by_row(_texts(docs, text, key), ["ids"], [pa.list_(pa.int32())], lambda t: (pieces(model).encode(t.as_py() or "", begin, end).astype(np.int32),), "ids array<int>")


def decode(rows: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of arrays of ids; null counts as empty."""
    source = rows.select(rows[key].cast("long").alias("doc_id"), rows[ids].cast("array<int>").alias("ids"))
    return _by_row(source, ["text"], [pa.string()], lambda x: (pieces(model).decode(x.as_py() or []),), "text string")


def digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): :func:`encode` and :func:`decode` in one pass, without moving ids and texts."""

    def both(x: pa.Scalar) -> tuple[int, str, str]:
        ids = pieces(model).encode(x.as_py() or "")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(pieces(model).decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest()

    return _by_row(_texts(docs, text, key), ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], both, "n_tokens long, ids_sha256 string, decoded_sha256 string")
