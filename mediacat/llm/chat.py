"""Chat formatting by columnar byte assembly, and its reading back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import work_dir, written
from .storage import Reader, Writer

#: The strings by which templates steer a model. None of them stands in a formatted text but as a mark.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes of formatted text from which a conversation is handed on in pieces.
PIECE = 4 << 20

_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
_UNDO = re.compile(r"\\(.)", re.S)


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Null is empty; a backslash is doubled, and one is put after the first character of each control string."""
    found = "(?=" + "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", c) for c in control) + ")(.)"
    return F.regexp_replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), found, "$1\\\\")


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1", text) if "\\" in text else text


def unescaped_role(role: str) -> str:
    return _UNDO.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formats a run of turns: all bytes, the turns' offsets, and the offsets at which contents start.

    Segment lengths (head, content, tail of each turn) give cumulative offsets; those give, by one repeat and one range a
    kind of segment, the index to which each source byte goes in a buffer allocated once.
    """
    coded = roles.dictionary_encode()
    heads = [OPEN + r.encode("utf-8", "surrogatepass") + b"\n" for r in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    head_len = np.array([len(h) for h in heads], np.int64)
    head_at = np.concatenate([[0], np.cumsum(head_len)])[:-1]
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    data, offsets = _bytes(texts)
    length = np.diff(offsets)
    n = len(length)
    lengths = np.stack([head_len[code], length, np.full(n, len(CLOSE), np.int64)], 1).ravel()
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(at[-1], np.uint8)

    def spread(to: np.ndarray, source: np.ndarray, many: np.ndarray, values: np.ndarray) -> None:
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(to, many) + step] = values[np.repeat(source, many) + step]

    spread(at[0:-1:3], head_at[code], head_len[code], head_bytes)
    spread(at[1:-1:3], offsets[:-1], length, data)
    spread(at[2:-1:3], np.zeros(n, np.int64), lengths[2::3], np.frombuffer(CLOSE, np.uint8))
    return out, at[0::3], at[1::3]


FORMATTED = "conv_id long, piece long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
_formatted = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(turns: DataFrame, learn: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Formats all turns (conv_id, turn, role, text): rows of FORMATTED.

    Turns are dealt and sorted by range of (conv_id, turn, a hash of role and text), so a conversation of any length is
    spread over tasks. It comes as one row (``whole``) unless it meets the edge of a task's range or outgrows PIECE; then
    its rows, in the order of ``piece``, join to the whole. ``loss`` lists the spans, in code points of the row's
    text, of the contents whose role is in ``learn``. Null role and text are empty; null conv_id is one conversation;
    rows that tie on conv_id and turn are ordered by their hash. Other columns are not read. No rows give no rows.
    """
    assert all(c[1:2] != "n" and "\\" not in c for c in control)
    role = F.replace(escaped(F.col("role"), control), F.lit("\n"), F.lit("\\n"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), escaped(F.col("text"), control).alias("text"), F.xxhash64("role", "text").alias("tie"))
    rows = rows.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie", "role", "text").select("conv_id", "role", "text")
    learnt = set(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        first_done = False

        def emit(part: pa.Table, last_open: bool) -> pa.RecordBatch:
            """Formats whole runs of one conv_id; the first of the task, and the last if it may go on, are not whole."""
            nonlocal piece, first_done
            part = part.combine_chunks()
            ids, roles, texts = (part.column(i).chunk(0) for i in range(3))
            out, at, content = assemble(roles, texts)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (known[1:] != known[:-1])]))
            ends = np.concatenate([new[1:], [len(number)]])
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            text = pa.StringArray.from_buffers(len(new), pa.py_buffer(np.concatenate([at[new], at[-1:]]).astype(np.int32)), pa.py_buffer(out))
            mine = np.array([r in learnt for r in roles.to_pylist()])
            loss, whole = [], []
            for k, (a, b) in enumerate(zip(new, ends, strict=True)):
                base = points[at[a]]
                loss.append([{"start": int(points[content[i]] - base), "end": int(points[at[i + 1] - len(CLOSE)] - base)} for i in range(a, b) if mine[i]])
                whole.append(first_done and not (last_open and k == len(new) - 1))
                first_done = True
            got = pa.RecordBatch.from_arrays([ids.take(pa.array(new)), pa.array(np.arange(piece, piece + len(new))), pa.array(whole), pa.array(ends - new), text, pa.array(loss, _formatted.field("loss").type)], schema=_formatted)
            piece += len(new)
            return got

        def split(table: pa.Table, cut: int) -> Iterator[pa.RecordBatch]:
            """Rows before ``cut``, some MB at a time; conversations are cut only if they outgrow PIECE."""
            size = np.cumsum(np.concatenate([[0], pa.compute.binary_length(table.column(2)).to_numpy()]) + 64)
            number = table.column(0).combine_chunks()
            change = np.concatenate([np.flatnonzero(pa.compute.not_equal(number[1:].fill_null(-(1 << 62)), number[:-1].fill_null(-(1 << 62))).to_numpy(zero_copy_only=False)) + 1, [cut]]) if len(number) > 1 else np.array([cut])
            a = 0
            while a < cut:
                fits = int(np.searchsorted(size, size[a] + PIECE, "right")) - 1
                b = change[(change > a) & (change <= max(fits, a + 1))]
                closed = len(b) > 0
                b = int(b[-1]) if closed else min(max(fits, a + 1), cut)
                yield emit(table.slice(a, b - a), not closed)
                if not closed:
                    mark_open()
                a = b

        def mark_open() -> None:
            nonlocal first_done
            first_done = False

        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            held = []
            if not table.num_rows:
                continue
            number = table.column(0).combine_chunks()
            same = pa.compute.equal(number.fill_null(-(1 << 62)), pa.scalar(number[-1].as_py() if number[-1].is_valid else -(1 << 62))).to_numpy(zero_copy_only=False)
            begins = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            tail = table.slice(begins)
            if tail.nbytes > PIECE:  # it goes on, or may
                yield from split(table, table.num_rows)
                mark_open()
                continue
            yield from split(table, begins)
            held = tail.combine_chunks().to_batches()
        if held:
            yield emit(pa.Table.from_batches(held), True)

    return rows.mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        found.append((unescaped_role(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside turns")
    return found


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: one row of DIGESTS each.

    A whole conversation is digested where it lies. Pieces of others leave their unescaped bytes in the shared folder; rows
    with their places are grouped by conversation, and the files are streamed in order, so no group is gathered in memory.
    """
    formatted = written(formatted, "formatted")
    folder = work_dir(formatted.sparkSession, "pieces")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        task, out = TaskContext.get(), None
        for batch in batches:
            rows = []
            for first in range(0, batch.num_rows, 256):
                for conv, piece, whole, n_turns, text, loss in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    turns = parse(text)
                    assert len(turns) == n_turns
                    told = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")
                    under = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
                    lost = under.encode("utf-8", "surrogatepass")
                    row = [conv, n_turns, None, len(under), None, len(text), piece, None, 0, 0, 0, 0]
                    if whole:
                        row[2], row[4] = hashlib.sha256(told).hexdigest(), hashlib.sha256(lost).hexdigest()
                    else:
                        out = out or Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}")
                        row[7:] = [out.name, *out.write(told), *out.write(lost)]
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 12, _read_types, strict=True)], names=_read_names)
        if out is not None:
            out.close()

    def join(key, pieces: pd.DataFrame) -> pd.DataFrame:
        reader, told, lost = Reader(folder), hashlib.sha256(), hashlib.sha256()
        pieces = pieces.sort_values("piece")
        for r in pieces.itertuples():
            for digest, start, size in ((told, r.told_at, r.told_size), (lost, r.lost_at, r.lost_size)):
                for at in range(start, start + size, 1 << 20):
                    digest.update(reader.read(r.file, at, min(1 << 20, start + size - at)))
        conv = pieces.conv_id.iloc[0]
        return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"), "n_turns": [pieces.n_turns.sum()], "turns_sha256": [told.hexdigest()], "loss_chars": [pieces.loss_chars.sum()], "loss_sha256": [lost.hexdigest()], "formatted_chars": [pieces.formatted_chars.sum()]})

    got = written(formatted.mapInArrow(read, _read_schema), "digests")
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return got.where("file is null").select(names).unionByName(got.where("file is not null").groupBy("conv_id").applyInPandas(join, DIGESTS))


_read_schema = DIGESTS + ", piece long, file string, told_at long, told_size long, lost_at long, lost_size long"
_read_names = [x.split()[0] for x in _read_schema.split(", ")]
_read_types = [pa.string() if x.endswith("string") else pa.int64() for x in _read_schema.split(", ")]
