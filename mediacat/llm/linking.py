"""Candidate links from bucket keys, without all pairs of a bucket, and the classes they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, discard, mix64, written

#: Entries (key, id, ...) that a task holds before it deals them out, and entries that a part should have.
HELD, PART = 1 << 18, 1 << 20
#: Members of an open bucket that are compared with each other in one group; larger buckets are dealt out as pairs of chunks.
CHUNK = 1 << 14
#: Distances that are computed at a time, and rows with texts that a part should have.
AT_ONCE, TEXTS = 1 << 20, 1 << 14
#: Members of buckets that are dealt out by their smallest id, not by key; an id has few keys, so that such parts are bounded.
TOGETHER = 64

#: From the columns (w, ...) of two sides to their distance, infinite where no link can be.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: A table whose rows Python makes: given what maps their batches on in the same worker, and the schema of what that makes.
Made = Callable[[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str], DataFrame]



def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the words of two sides differ, all words together."""
    return sum((np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int32) for x, y in zip(a, b, strict=True)), np.int32(0))


# --------------------------------------------------------------------------- packed entries


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


#: Kinds of packed rows: entries (key, id, ...) whose key decides the part, pairs of ids, members (key, id) of buckets, and
#: marks (key, 0) of buckets some of whose members were dealt elsewhere, which go where the key does.
ENTRIES, PAIRS, MEMBERS, MARKS = 0, 1, 2, 3


#: Of a key that carries a measure of its id in the low 16 bits: the bits that name the bucket.
BUCKET = -1 << 16


def _close(a: np.ndarray, b: np.ndarray, reach: int | None) -> np.ndarray | slice:
    """Where the measures that two columns of keys carry differ by ``reach`` at most; everywhere, if they carry none."""
    return slice(None) if reach is None else np.abs((a & ~BUCKET) - (b & ~BUCKET)) <= reach


def _planes(rows: np.ndarray) -> np.ndarray:
    """The bytes of some rows of longs, all first bytes before all second ones: those of sorted keys are much alike, and compress."""
    return np.ascontiguousarray(rows).view(np.uint8).T.ravel()


def _unplaned(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8 * width, -1).T).view(np.int64)


def _dealt(rows: DataFrame | Made, parts: int, combine: Callable[[np.ndarray], dict[int, np.ndarray]], measured: bool = False) -> DataFrame:
    """The entries of ``rows`` (keys array<long>, then longs), packed by part: (part, kind, block of longs).

    All entries of one key go to one part. What a task holds is combined first: ``combine`` maps entries (a matrix whose first
    column is the key) to rows of each kind; pairs and members go to the part of their hash, so no key is in their way.
    If ``measured``, the last column is a measure below 1 << 16, which replaces the low bits of the keys.
    """
    width = 2 if callable(rows) else len(rows.columns) - measured

    def blocks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, block in combine(np.concatenate(held)).items():
            if not len(block):
                continue
            spot = block[:, 0].view(np.uint64)
            if kind in (PAIRS, MEMBERS):
                spot = mix64(mix64(spot) ^ block[:, 1].view(np.uint64))
            # parts are ranges of the (evenly spread) keys, in whose order entries are already
            part = ((spot >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            if (np.diff(part) < 0).any():
                order = np.argsort(part, kind="stable")
                part, block = part[order], block[order]
            at = _runs(part)
            data = np.concatenate([_planes(block[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            offsets = (at * (8 * block.shape[1])).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), pa.array(np.full(len(at) - 1, kind, np.int32)), binary], names=["part", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            lists = batch.column(0)
            counts = np.diff(lists.offsets.to_numpy())
            entries = np.empty((int(counts.sum()), width), np.int64)
            entries[:, 0] = lists.flatten().to_numpy(zero_copy_only=False)
            for j in range(1, width):
                entries[:, j] = np.repeat(batch.column(j).to_numpy(zero_copy_only=False), counts)
            if measured:
                entries[:, 0] &= BUCKET
                entries[:, 0] |= np.repeat(batch.column(width).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            held.append(entries)
            many += len(entries)
            if many >= HELD:
                yield from blocks(held)
                held, many = [], 0
        if many:
            yield from blocks(held)

    schema = "part int, kind int, block binary"
    return rows(run, schema) if callable(rows) else rows.where(F.col(rows.columns[0]).isNotNull()).mapInArrow(run, schema)


def _parts_of(spark: SparkSession, entries: int) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), entries // PART)


def _by_part(packed: DataFrame, width: int, then: Callable[..., dict[int, np.ndarray]]) -> DataFrame:
    """(kind, x, y): ``then`` of each part's entries, pairs, members and marks."""
    widths = {ENTRIES: width, PAIRS: 2, MEMBERS: 2, MARKS: 2}

    def run(table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
        sides = [np.concatenate([np.zeros((0, w), np.int64), *(_unplaned(b, w) for b, k in zip(blocks, kinds, strict=True) if k == kind)]) for kind, w in widths.items()]
        out = then(*sides)
        kind = np.concatenate([np.full(len(v), k, np.int32) for k, v in out.items()])
        both = np.concatenate(list(out.values()))
        return pa.Table.from_arrays([pa.array(kind), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["kind", "x", "y"])

    return packed.groupBy("part").applyInArrow(run, "kind int, x long, y long")


# --------------------------------------------------------------------------- what is done with a key's entries


def _by_key(entries: np.ndarray, bucket: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The entries in the order of their keys, and which of them share a key (its bits ``bucket``) with another."""
    entries = entries[np.argsort(entries[:, 0].view(np.uint64))]
    same = np.diff(entries[:, 0] & bucket) == 0
    shared = np.zeros(len(entries), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return entries, shared


def _distinct(rows: np.ndarray, bucket: int = -1) -> np.ndarray:
    """Distinct rows of two columns, in their order (of the first, by its bits ``bucket``)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0] & bucket))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def _in_buckets(rows: np.ndarray, bucket: int) -> np.ndarray:
    """The rows (key, id), the keys without measures."""
    return np.stack([rows[:, 0] & bucket, rows[:, 1]], 1)


def _ends(entries: np.ndarray, reach: int | None = None) -> dict[int, np.ndarray]:
    """Distinct entries (key, id), of each key only the smallest and the largest id; of three or more ids of a key, the pairs of
    the smallest and the ids between (of three, all pairs), these ids as members, and a mark. Pairs whose measures are more
    than ``reach`` apart are left out."""
    bucket = -1 if reach is None else BUCKET
    entries, shared = _by_key(entries, bucket)
    some = _distinct(entries[shared], bucket)
    at = _runs(some[:, 0] & bucket)
    first, last, size = at[:-1], at[1:] - 1, np.diff(at)
    inner = np.ones(len(some), bool)
    inner[first] = inner[last] = False
    wide = size > 2
    three = first[size == 3]
    x, y = some[np.concatenate([np.repeat(first, size)[inner], three + 1])], some[np.concatenate([np.flatnonzero(inner), three + 2])]
    pairs = np.stack([x[:, 1], y[:, 1]], 1)[_close(x[:, 0], y[:, 0], reach)]
    left = np.concatenate([entries[~shared], some[~inner]])
    marks = np.stack([some[first[wide], 0] & bucket, np.zeros(wide.sum(), np.int64)], 1)
    return {ENTRIES: left[np.argsort(left[:, 0].view(np.uint64))], PAIRS: _distinct(pairs), MEMBERS: _in_buckets(some[inner], bucket), MARKS: marks}


def _met(entries: np.ndarray, pairs: np.ndarray, members: np.ndarray, marks: np.ndarray, reach: int | None = None) -> dict[int, np.ndarray]:
    """Pairs (a, b), a < b, of each key's members with a smaller one, and all members of keys with more than three, or with a
    mark; of up to three members without one the pairs are all there are. Pairs whose measures are more than ``reach`` apart are left out."""
    bucket = -1 if reach is None else BUCKET
    entries, shared = _by_key(entries, bucket)
    own = _ends(entries[shared], reach)
    left, again = _by_key(own[ENTRIES], bucket)
    left = _distinct(left[again], bucket)
    x, y = left[::2], left[1::2]
    pairs = np.concatenate([pairs, own[PAIRS], np.stack([x[:, 1], y[:, 1]], 1)[_close(x[:, 0], y[:, 0], reach)]])
    own = np.concatenate([own[MEMBERS], _in_buckets(left, bucket)])
    keys, many = np.unique(own[:, 0], return_counts=True)
    large = keys[(many > 3) | np.isin(keys, marks[:, 0])]
    return {PAIRS: _distinct(pairs), MEMBERS: np.concatenate([members, own[np.isin(own[:, 0], large)]])}


def _across(near: Near, best: bool) -> Callable[..., dict[int, np.ndarray]]:
    """Of the entries (key, id, component, chunk, columns of near): pairs of different components that can be linked.

    With ``best`` each id outside of its bucket's largest component gets its nearest id, else all such pairs are given. If
    there are two chunks of a key, only pairs of both are looked at.
    """

    def of_bucket(e: np.ndarray) -> Iterator[np.ndarray]:
        _, component, size = np.unique(e[:, 2], return_inverse=True, return_counts=True)
        rest = np.flatnonzero(component != size.argmax())
        split = (e[:, 3] != e[0, 3]).any()
        columns = np.ascontiguousarray(e[:, 4:].T)
        step = max(1, AT_ONCE // (len(e) * max(1, len(columns))))
        for i in range(0, len(rest), step):
            own = rest[i : i + step]
            apart = near(columns[:, own, None], columns[:, None, :]).astype(np.float32)
            apart[component[own][:, None] == component[None]] = np.inf
            if split:
                apart[e[own, 3][:, None] == e[None, :, 3]] = np.inf
            if best:
                to = apart.argmin(1)
                ok = np.isfinite(apart[np.arange(len(own)), to])
                x, y = own[ok], to[ok]
            else:
                x, y = np.nonzero(np.isfinite(apart))
                x = own[x]
            yield np.sort(np.stack([e[x, 1], e[y, 1]], 1), axis=1)

    def run(entries: np.ndarray, *_: np.ndarray) -> dict[int, np.ndarray]:
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        at = _runs(entries[:, 0])
        found = [p for a, b in zip(at[:-1], at[1:], strict=True) for p in of_bucket(entries[a:b])]
        return {PAIRS: _distinct(np.concatenate([np.zeros((0, 2), np.int64), *found]))}

    return run


def _likely(near: Near, reach: int | None) -> Callable[..., dict[int, np.ndarray]]:
    """Of the entries (cell, id, component, chunk, key, columns of near): members (key, id) that can be linked with one of
    another component in the cell, and of the other chunk if there are two. With ``reach`` there is a measure after the key,
    and only members whose measures differ by so much at most are compared."""

    def of_cell(e: np.ndarray) -> np.ndarray:
        if reach is not None:
            e = e[np.argsort(e[:, 5])]
        _, component, size = np.unique(e[:, 2], return_inverse=True, return_counts=True)
        rest = np.flatnonzero(component != size.argmax())
        split = (e[:, 3] != e[0, 3]).any()
        columns = np.ascontiguousarray(e[:, 5 + (reach is not None) :].T)
        some = np.zeros(len(e), bool)
        step = max(1, AT_ONCE // (len(e) * max(1, len(columns))))
        step = step if reach is None else min(step, 64)
        for i in range(0, len(rest), step):
            own, to = rest[i : i + step], slice(0, len(e))
            if reach is not None:
                to = slice(*np.searchsorted(e[:, 5], [e[own[0], 5] - reach, e[own[-1], 5] + reach + 1]))
            ok = np.isfinite(near(columns[:, own, None], columns[:, None, to])) & (component[own][:, None] != component[None, to])
            if split:
                ok &= e[own, 3][:, None] != e[None, to, 3]
            some[own] |= ok.any(1)
            some[to] |= ok.any(0)
        return e[some][:, [4, 1]]

    def run(entries: np.ndarray, *_: np.ndarray) -> dict[int, np.ndarray]:
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        at = _runs(entries[:, 0])
        return {MEMBERS: np.concatenate([np.zeros((0, 2), np.int64), *(of_cell(entries[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))])}

    return run


#: Candidates that a task holds before it compares them, and those that it compares at a time.
TRIED, LOT = 1 << 17, 1 << 12


def _linked_within(near: Near, alike: Callable, prepared: Callable, width: int, lots: Callable[[list, list], np.ndarray] | None = None) -> Callable[[pa.Table], pa.Table]:
    """Of the rows (part, id, component, cells: (cell, key, chunk), ``width`` columns of near, text, all keys of the id that are
    open) of whole cells: links that join components.

    Candidates of a cell are tried nearest first; what links have joined meanwhile is not tried again, and two ids that share
    several open keys are tried under the smallest of them only. Nothing but links leaves the task. With ``lots``, which tells of
    two lists which pairs are linked, the candidates of all cells are tried together, LOT at a time.
    """

    def candidates(e: np.ndarray, component: np.ndarray, outside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows x, y of candidates across components, and their distances, a block of x at a time."""
        rest = np.flatnonzero(outside)
        split = (e[:, 3] != e[0, 3]).any()
        columns = np.ascontiguousarray(e[:, 4:].T)
        step = max(1, AT_ONCE // (len(e) * max(1, width)))
        for i in range(0, len(rest), step):
            own = rest[i : i + step]
            apart = near(columns[:, own, None], columns[:, None, :]).astype(np.float32)
            no = (component[own][:, None] == component[None]) | (outside[None] & (own[:, None] > np.arange(len(e))[None]))
            if split:
                no |= e[own, 3][:, None] == e[None, :, 3]
            apart[no] = np.inf
            x, y = np.nonzero(np.isfinite(apart))
            yield own[x], y, apart[x, y]

    def of_cell(e: np.ndarray, key: int, keys: list[frozenset[int]], lines: Callable[[], list]) -> Iterator[tuple[int, int]]:
        _, component, size = np.unique(e[:, 2], return_inverse=True, return_counts=True)
        if len(size) < 2:
            return
        held = None
        root = list(range(len(size)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for x, y, apart in candidates(e, component, component != size.argmax()):
            for k in np.argsort(apart, kind="stable").tolist():
                a, b = int(x[k]), int(y[k])
                p, q = find(component[a]), find(component[b])
                if p == q or min(keys[a] & keys[b]) != key:
                    continue
                held = lines() if held is None else held
                if alike(held[a], held[b]):
                    root[p] = q
                    yield min(e[a, 1], e[b, 1]), max(e[a, 1], e[b, 1])

    def in_lots(cells: Iterator[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, component: np.ndarray, keys: list[frozenset[int]], lines: list) -> Iterator[tuple[int, int]]:
        """Links among the candidates of ``cells`` (entries, their rows in the lists, key)."""
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = root[i]
            return i

        def linked(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
            x, y, apart = (np.concatenate([h[j] for h in held]) for j in range(3))
            order = np.argsort(apart, kind="stable")
            for i in range(0, len(order), LOT):
                some = order[i : i + LOT]
                pairs = [(p, q) for p, q in zip(x[some].tolist(), y[some].tolist(), strict=True) if find(component[p]) != find(component[q])]
                for (p, q), ok in zip(pairs, lots([lines[p] for p, _ in pairs], [lines[q] for _, q in pairs]).tolist(), strict=True):
                    if ok and (a := find(component[p])) != (b := find(component[q])):
                        root[a] = b
                        yield min(ids[p], ids[q]), max(ids[p], ids[q])

        held, many = [], 0
        for e, rows, key in cells:
            _, own, size = np.unique(e[:, 2], return_inverse=True, return_counts=True)
            if len(size) < 2:
                continue
            for x, y, apart in candidates(e, own, own != size.argmax()):
                x, y = rows[x], rows[y]
                first = np.fromiter((min(keys[p] & keys[q]) == key for p, q in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                held.append((x[first], y[first], apart[first]))
                many += int(first.sum())
                if many >= TRIED:
                    yield from linked(held)
                    held, many = [], 0
        if many:
            yield from linked(held)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component = (table.column(j).to_numpy() for j in (1, 2))
        lists = table.column(3).chunk(0) if table.num_rows else pa.array([], table.schema.field(3).type)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        cell, key, chunk = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        near_of = [table.column(4 + j).to_numpy() for j in range(width)]
        texts, opened = table.column(4 + width), table.column(5 + width)
        entries = np.stack([cell, ids[row], component[row], chunk, *(c[row] for c in near_of)], 1)
        order = np.argsort(cell, kind="stable")
        at = _runs(cell[order])
        keys = [frozenset(k) for k in opened.to_pylist()]
        cells = ((own := order[a:b], row[own], int(key[own[0]])) for a, b in zip(at[:-1], at[1:], strict=True))
        if lots:
            links = list(in_lots(((entries[own], rows, key) for own, rows, key in cells), ids, component.tolist(), keys, prepared(texts)))
        else:
            links = [x for own, rows, key in cells for x in of_cell(entries[own], key, [keys[r] for r in rows], lambda rows=rows: prepared(texts.take(pa.array(rows))))]
        return pa.Table.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


_as_they_are = lambda entries: {ENTRIES: entries}


# --------------------------------------------------------------------------- classes


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components p and q; what is in no class is one of its own."""
    for x, c in (("a", "p"), ("b", "q")):
        pairs = pairs.join(classes.select(F.col("id").alias(x), F.col("component").alias(c)), x, "left").withColumn(c, F.coalesce(c, x))
    return pairs.where("p <> q")


def linked_classes(
    keys: list[tuple[DataFrame | Made, int]], items: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], name: str, refine: Callable[[DataFrame], DataFrame] | None = None, texts: tuple[Callable[[DataFrame], DataFrame], Callable[..., bool]] | None = None, prepared: Callable[[pa.Array | pa.ChunkedArray], list] | None = None, group: int | None = None, among: Callable[[DataFrame], None] | None = None,
    sift: bool = False, lots: Callable[[list, list], np.ndarray] | None = None, reach: int | None = None, measure: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Classes of the ids that verified links join, and those links that were needed to find them.

    ``keys`` has tables (keys array<long>, id long), or what makes them in Python, and about how many keys each has in all; each is
    read once, and dealt out one after the other. ``items`` has (id long, and longs that ``near`` reads) and is read several times, so it had better
    come from a written table. An id may have several rows if they are equal.
    Two items are candidates if they share a key and their distance by ``near`` is finite, as it is for all that are linked.
    ``verify`` takes distinct candidates (a, b), a < b, and returns the linked ones. ``among`` gets, before that, the table of
    candidates among which they are; it is the same one for several calls of ``verify``.

    1. Each item of a bucket is paired with the smallest id of the bucket, or of what a task holds of it: one pair an item and key.
       Tasks do this for what they hold before they deal keys out, so of a hot key two entries a task are gathered. Each
       item's pair with the smallest id is verified first, the others only where they still are of different components.
    2. Buckets whose items are of one component are closed: nothing in them can add to the classes. In the others each item
       outside of the largest component is paired with its nearest one of another component: one pair an item and key.
    3. In the buckets that still are open, all candidates across components are verified. So every pair of candidates has
       been verified or lies in one component, and no link between components is lost. Candidates are found by comparing
       columns in numpy, in blocks; pairs that are no candidates are never rows. A bucket of more than CHUNK members is dealt
       out as pairs of chunks.

    If ``texts`` is given, (id, line) of some ids, and whether two lines are linked, step 2 is left out and step 3 makes no rows of
    pairs: the members of an open bucket, with their lines, are dealt to its cells and compared there. Buckets of up to TOGETHER
    members that have the smallest id in common are dealt to one part, so that a line is copied once for all of them; else it is
    copied once for each of its open buckets, and for each further chunk of a bucket of more than ``group`` (CHUNK / 4) members. ``prepared`` makes
    of a cell's lines, once, what is compared. With ``sift``, members without a candidate in an open bucket, which are most where
    unlike lines share keys, are told by ``near`` before any line is fetched, and left out. ``lots`` is the comparison for two lists.
    For the ids in open buckets ``refine`` may give finer columns (by id), which ``near`` gets after the others.
    Entries are packed by the key's part before they are shuffled, so a key costs 16 bytes and no row of its own. With ``reach`` the
    tables of keys have a third column, a measure below 1 << 16 that takes the place of a key's low bits: ids whose measures differ by
    more cannot be linked, and are no pair. ``measure`` makes it of the first column of ``items``.
    Returns (id, component) of the linked ids, and the links (a, b).
    """
    spark = items.sparkSession
    columns = [c for c in items.columns if c != "id"]

    def candidates(pairs: DataFrame) -> DataFrame:
        """The pairs whose distance is finite."""
        for x in "ab":
            pairs = pairs.join(info.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]), x)
        pairs = pairs.select("a", "b", *[f"{x}_{c}" for x in "ab" for c in columns])
        w = len(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = np.stack([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(2 * w)])
                yield batch.select([0, 1]).filter(pa.array(np.isfinite(near(side[:w], side[w:]))))

        return pairs.mapInArrow(run, "a long, b long")

    def linked(pairs: DataFrame, step: int | str, table: DataFrame) -> DataFrame | None:
        """The links among the pairs, which are some of the ``table``; None if there are no pairs or links."""
        if pairs.isEmpty():
            return None
        if among:
            among(table)
        found = written(verify(pairs), f"{name}-links-{step}")
        return None if found.isEmpty() else found

    def merged(classes: DataFrame, found: DataFrame, step: int | str) -> DataFrame:
        """The classes after more links: components of the classes that the links join."""
        joined = written(components(_between(found, classes).select(F.col("p").alias("a"), F.col("q").alias("b")), f"{name}-{step}"), f"{name}-joined-{step}")
        old = classes.select("id", F.col("component").alias("_p")).join(joined.select(F.col("id").alias("_p"), F.col("component").alias("_q")), "_p", "left")
        new = joined.join(classes.select("id"), "id", "left_anti")
        return written(old.select("id", F.coalesce("_q", "_p").alias("component")).unionByName(new), f"{name}-classes-{step}")

    # 1
    asked = ["keys", "id"] if reach is None else ["keys", "id", "measure"]
    ends, meet = (lambda e: _ends(e, reach)), (lambda *sides: _met(*sides, reach))
    met = [written(_by_part(_dealt(table if callable(table) else table.select(asked), _parts_of(spark, many), ends, reach is not None), 2, meet), f"{name}-met") for table, many in keys]
    rows = reduce(DataFrame.unionByName, met)
    pairs_rows = rows.where(F.col("kind") == PAIRS)
    pairs = pairs_rows.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    members = rows.where(F.col("kind") == MEMBERS).select(F.col("x").alias("key"), F.col("y").alias("id"))
    # a row an id, so that its class is looked up once, not for each of its keys
    gathered = written(members.groupBy("id").agg(F.collect_set("key").alias("keys")), f"{name}-members")
    # what met nothing is in no bucket with another; each member is in a pair, unless that was beyond reach
    ids = pairs_rows.select(F.col("x").alias("id")).union(pairs_rows.select("y"))
    ids = written((ids if reach is None else ids.union(gathered.select("id"))).distinct(), f"{name}-ids")
    info = written(thinned(items, ids, "id").join(ids, "id").dropDuplicates(["id"]), f"{name}-info")
    tried = written(candidates(pairs), f"{name}-pairs-1")
    classes = spark.createDataFrame([], "id long, component long")
    links = tried.limit(0)
    # each id with the smallest one it met first: most of the other pairs are then of one component
    first = written(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"{name}-first")
    for step, some in (("1a", first), ("1b", tried.join(first, ["a", "b"], "left_anti"))):
        found = linked(written(_between(some, classes).select("a", "b"), f"{name}-pairs-{step}"), step, tried)
        if found is not None:
            links = links.unionByName(found)
            classes = merged(classes, found, step)

    def still_open(classes: DataFrame, step: int) -> DataFrame:
        """(key, id, component) of the open buckets, with the number n of their members and their smallest id; of up to three, all pairs were tried."""
        placed = gathered.join(classes, "id", "left").select(F.explode("keys").alias("key"), "id", F.coalesce("component", "id").alias("component"))
        spans = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n"), F.min("id").alias("low"))
        spans = written(spans.where("p <> q and n > 3").select("key", "n", "low"), f"{name}-keys-{step}")
        return written(placed.join(spans, "key"), f"{name}-open-{step}")

    def chunked(rows: DataFrame, key: str, most: int) -> DataFrame:
        """Rows (id, ``key``, n: rows of the key) with their chunk, dealt to each cell (pair of chunks) that needs them."""
        chunks = F.ceil(F.col("n") / most).cast("int")
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("long")).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long"))))
        return rows.withColumn("cell", F.when(F.col("n") <= most, F.col(key)).otherwise(F.xxhash64(key, F.least("chunk", "to"), F.greatest("chunk", "to"))))

    def across(left: DataFrame, fine: DataFrame, best: bool) -> DataFrame:
        cells = chunked(left, "key", CHUNK)
        own = [f"near_{c}" for c in fine.columns if c != "id"]
        rows = cells.join(fine.select("id", *[F.col(c.removeprefix("near_")).alias(c) for c in own]), "id")
        rows = rows.select(F.array("cell").alias("keys"), "id", "component", "chunk", *own)
        found = _by_part(_dealt(rows, _parts_of(spark, left.count()), _as_they_are), len(rows.columns), _across(near, best))
        return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")

    def sifted(left: DataFrame, fine: DataFrame) -> DataFrame:
        """The members of open buckets that have a candidate of another component there, with the buckets' new sizes."""
        own = [c for c in fine.columns if c != "id"]
        rows = chunked(left, "key", CHUNK).join(fine.select("id", *[F.col(c).alias(f"near_{c}") for c in own]), "id")
        rows = rows.select(F.array("cell").alias("keys"), "id", "component", "chunk", "key", *([] if reach is None else [measure(F.col(f"near_{own[0]}")).cast("long").alias("measure")]), *[f"near_{c}" for c in own])
        some = _by_part(_dealt(rows, _parts_of(spark, 2 * left.count()), _as_they_are), len(rows.columns), _likely(near, reach))
        some = written(some.select(F.col("x").alias("key"), F.col("y").alias("id")).distinct(), f"{name}-likely")
        placed = some.join(classes, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        return written(placed.join(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")), "key"), f"{name}-sifted")

    def compared(left: DataFrame, fine: DataFrame) -> DataFrame:
        """Links across the components of open buckets."""
        lines_of, alike = texts
        own = [c for c in fine.columns if c != "id"]
        opened = left.groupBy("id").agg(F.collect_set("key").alias("opened"))
        ids = left.select("id").distinct() if sift else fine.select("id")
        about = fine.select("id", *[F.col(c).alias(f"near_{c}") for c in own]).join(written(lines_of(ids), f"{name}-within"), "id").join(opened, "id")
        parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), left.count() // TEXTS)
        cells = chunked(left.select("id", "component", "key", "n", "low"), "key", group or CHUNK // 4)
        part = F.pmod(F.xxhash64(F.when(F.col("n") <= TOGETHER, F.col("low")).otherwise(F.col("cell"))), F.lit(parts)).cast("int")
        cells = cells.groupBy(part.alias("part"), "id", "component").agg(F.collect_list(F.struct("cell", "key", "chunk")).alias("cells")).join(about, "id")
        cells = cells.select("part", "id", "component", "cells", *[f"near_{c}" for c in own], "line", "opened")
        return cells.groupBy("part").applyInArrow(_linked_within(near, alike, prepared or (lambda lines: lines.to_pylist()), len(own), lots), "a long, b long").distinct()

    left = still_open(classes, 2)
    fine = None
    for step, best in ((2, True), (3, False)):
        if best and texts:
            continue
        if left.isEmpty():
            break
        if fine is None:
            own = left.select("id").distinct()
            fine = info.join(own, "id")
            fine = written(fine.join(refine(own), "id") if refine else fine, f"{name}-fine")
        if texts:
            found = written(compared(sifted(left, fine) if sift else left, fine), f"{name}-links-{step}")
        else:
            more = written(across(left, fine, best), f"{name}-pairs-{step}")
            tried = tried.unionByName(more)
            found = linked(more, step, more)
        if found is not None and not found.isEmpty():
            links = links.unionByName(found)
            classes = merged(classes, found, step)
            left = still_open(classes, 3) if best else left
    discard(*met, gathered, info)
    return classes, links


#: Bits, as a power of two, of the largest filter by which rows are thinned out before they are shuffled: 8 MB.
FILTER_BITS = 26


def bits_of(ids: DataFrame, spot: Column) -> Broadcast:
    """A one-hash Bloom filter of ``ids``, whose hash is ``spot``: words of 64 bits, sent to all workers.

    It has 64 bits an id up to a fixed size, so it may be broadcast; beyond that, as ids fill it, more of what is not there passes.
    """
    words = ids.select(spot.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("spot")).groupBy(F.shiftright("spot", 6).alias("w"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    size = min(1 << (FILTER_BITS - 6), 1 << max(6, got.num_rows.bit_length()))
    bits = np.zeros(size, np.int64)
    np.bitwise_or.at(bits, got.column("w").to_numpy() & (size - 1), got.column("bits").to_numpy())
    return ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def may_be(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether the filter of :func:`bits_of` has each hash."""
    spots = spots.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[spots >> np.uint64(6) & np.uint64(len(bits) - 1)] >> (spots & np.uint64(63)) & np.uint64(1)).astype(bool)


def thinned(rows: DataFrame, ids: DataFrame, key: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` may be among ``ids`` (one column): all that are, and few others.

    ``then`` maps the batches that are left to batches of ``schema`` in the same Python worker.
    """
    shared = bits_of(ids, F.xxhash64(ids.columns[0]))
    names = rows.columns

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names).filter(pa.array(may_be(shared.value, batch.column(len(names)).to_numpy(zero_copy_only=False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(left(batches)) if then else left(batches)

    marked = rows.withColumn("_spot", F.xxhash64(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    return marked.mapInArrow(run, schema or rows.schema)
