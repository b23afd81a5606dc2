"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
#: Open windows of one task at most. Beyond, the fuller half of them are joined end to end.
OPEN = 1024
#: Sequence ids of one task: its partition's number times this, and up.
PER_TASK = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, joined boolean"


def byte_bpe(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a byte-level BPE vocabulary, given as ``.tiktoken`` ranks or as the tokenizers library's ``.json``.

    Ranks of the same vocabulary give the same ids in a fifth of the CPU time (tests/llm holds the two against each other).
    The strings of special tokens are ordinary text.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [model.encode_ordinary(t) for t in texts]


class LevelPacker:
    """Online packing by sum of squares.

    ``level[h]`` counts the open windows that hold ``h`` tokens. A piece of ``s`` tokens goes to the level ``h`` (0: a new
    window) for which the sum of the squared counts is smallest afterwards; moving a window from ``h`` to ``h + s`` changes
    that sum by ``2 (level[h+s] - level[h] + 1)``, a new one by ``2 level[s] + 1``, and one that becomes full by
    ``1 - 2 level[h]``. Ties go to the fullest level.
    """

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def full(self, piece: tuple) -> list[tuple]:
        return [(self._new_id(), [piece])]

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, piece: tuple) -> list[tuple]:
        """Windows that this piece fills, as (sequence id, pieces); a piece is (length, row...)."""
        s, room = piece[0], self.window - piece[0]
        here = self.level[: room + 1]
        change = 2 * (self.level[s:] - here) + 2
        change[room] -= 2 * self.level[self.window] + 1
        change[0] = 2 * self.level[s] + 1
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        h = room - int(np.argmin(change[::-1]))
        if h == 0:
            pieces = [piece]
        else:
            pieces = self.take(h)
            pieces.append(piece)
        if h + s == self.window:
            return [(self._new_id(), pieces)]
        self.put(h + s, pieces)
        return []

    def take(self, h: int, oldest: bool = False) -> list:
        self.level[h] -= 1
        self.n_open -= 1
        return self.open[h].pop(0 if oldest else -1)

    def put(self, h: int, pieces: list) -> None:
        self.open[h].append(pieces)
        self.level[h] += 1
        self.n_open += 1

    def fullest(self, many: int) -> Iterator[list]:
        """So many open windows, the fullest and of these the oldest first; they are open no more."""
        for h in range(self.window - 1, 0, -1):
            while many and self.open[h]:
                many -= 1
                yield self.take(h, oldest=True)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, text: str = "text", key: str = "doc_id", most_open: int = OPEN) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens, one row a piece.

    Each task packs the documents of its partition online, one look at each, no shuffle: whole windows are cut off long
    documents, and the remainder goes to the level that :class:`LevelPacker` names. A task holds at most ``most_open`` open
    windows: beyond, the fuller half are joined end to end into full ones, and what is left over is open again. So are all at a
    task's end, where the last tokens are cut into runs of powers of two, which need no padding. ``joined`` marks the pieces
    of windows that were filled so. Finished rows leave with each batch.

    Null text counts as empty: its document is the end id alone. Null or repeated keys are carried through, each row being
    a document of its own. Columns other than ``key`` and ``text`` are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        packer = LevelPacker(window, TaskContext.get().partitionId() * PER_TASK)
        out: list[tuple] = []

        def close(done: list[tuple], joined: bool = False) -> None:
            for sequence, pieces in done:
                total, at = sum(p[0] for p in pieces), 0
                for length, doc, start, ids, tokens in pieces:
                    out.append((doc, start, length, zlib.crc32(ids), tokens, sequence, at, total, joined))
                    at += length

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(_names)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), pa.bool_() if n == "joined" else pa.int64()) for n, c in zip(_names, columns, strict=True)], names=_names)
            out.clear()
            return made

        def cut(pieces: list, size: int) -> tuple[list, list]:
            """The first ``size`` tokens of the pieces, and the others."""
            head: list = []
            while size:
                length, doc, start, ids, tokens = pieces.pop(0)
                n = min(size, length)
                head.append((n, doc, start, ids[: 4 * n], tokens))
                if n < length:
                    pieces.insert(0, (length - n, doc, start + n, ids[4 * n :], tokens))
                size -= n
            return head, pieces

        def join(many: int) -> list:
            """Joins so many open windows into full ones; returns the pieces left over, less than a window."""
            pending: list = []
            size = 0
            for pieces in packer.fullest(many):
                pending += pieces
                size += sum(p[0] for p in pieces)
                while size >= window:
                    head, pending = cut(pending, window)
                    close([(packer._new_id(), head)], True)
                    size -= window
            return pending

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first in range(0, len(keys), 64):
                texts = [t or "" for t in batch.column(1).slice(first, 64).to_pylist()]
                for doc, ids in zip(keys[first : first + 64], encode(texts), strict=True):
                    ids.append(end_id)
                    n, raw = len(ids), np.array(ids, "<u4").tobytes()
                    whole = n - n % window
                    for start in range(0, whole, window):
                        close(packer.full((window, doc, start, raw[4 * start : 4 * (start + window)], n)))
                    if n > whole:
                        close(packer.place((n - whole, doc, whole, raw[4 * whole :], n)))
                        if packer.n_open > most_open:
                            if left := join(most_open // 2):
                                packer.put(sum(p[0] for p in left), left)
            yield flush()
        pending = join(packer.n_open)
        while size := sum(p[0] for p in pending):
            head, pending = cut(pending, 1 << (size.bit_length() - 1))
            close([(packer._new_id(), head)], True)
        yield flush()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


_names = [x.split()[0] for x in SCHEMA.split(", ")]
