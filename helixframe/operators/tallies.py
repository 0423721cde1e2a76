"""Windows of many reads at once, as arrays: what a task makes of an Arrow batch of reads.

The characters of a batch lie in one array, an identifier of every place is put together from pieces of
1, 2, 4, 8 and 16 bases, and places at which no window starts are left out by running sums. A task
counts its windows before they are dealt out: short ones in a table of all identifiers, longer ones by sorting
up to ``CHUNK`` of them at a time. Spark groups what the tasks have counted: up to ``PACKED`` bases as blocks of
identifiers that begin alike, else row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that are sorted at a time, and rows of a batch that a task hands on.
CHUNK, ROWS = 1 << 23, 1 << 16
#: Reads of a batch that are taken at a time where they are cut in the same worker.
TOGETHER = 1 << 13
#: Identifiers up to which a task has a table of all.
TABLE = 1 << 20
#: Bases up to which counts are dealt out as blocks, and leading bits that the identifiers of a block share.
PACKED, LEADING = 14, 10

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of texts, a byte for each character; null ones are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pc.sum(pc.binary_length(texts)).as_py() != pc.sum(pc.utf8_length(texts)).as_py():
        texts = pa.array([t.encode("latin-1", "replace") for t in texts.to_pylist()], pa.binary())
    else:
        texts = texts.cast(pa.binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0]:ends[-1]], np.diff(ends).astype(np.int64)


def rolled(codes: np.ndarray, length: int) -> np.ndarray:
    """Packed identifiers of ``length`` bases from every place that has as many."""
    piece, width = codes.astype(np.uint32 if length <= 16 else np.uint64), 1
    out, have, size = None, 0, len(codes) - length + 1
    while True:
        if length & width:
            new = piece[have:have + size]
            out = new if out is None else out << piece.dtype.type(2 * width) | new
            have += width
        if 2 * width > length:
            return out
        piece = piece[:-width] << piece.dtype.type(2 * width) | piece[width:]
        width *= 2


def _within(flags: np.ndarray, length: int) -> np.ndarray:
    """How many flags are set in the ``length`` places from every place that has as many."""
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total[length:] - total[:-length]


def windows_of(bases: pa.Array, quals: pa.Array | None, length: int, params=None, unjudged: bool = False):
    """(ids, at, good, first): windows by the rule on starts, their places in all characters, where reads begin.

    ``good``: whether at most ``max_bad`` qualities lie below ``quality_threshold``; None without params. Missing
    qualities are good ones. Null reads, and with params null qualities, give no window; ``unjudged``: windows of
    null qualities are there and not good.
    """
    data, n = characters(bases)
    first = np.cumsum(n) - n
    starts = np.maximum(n - length + 1, 0)
    if params is not None and quals.null_count and not unjudged:
        starts[quals.is_null().to_numpy(zero_copy_only=False)] = 0
    size = len(data) - length + 1
    if size <= 0 or not starts.any():
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), None if params is None else np.zeros(0, bool), first
    ok = np.repeat(np.tile([True, False], len(n)), np.column_stack((starts, n - starts)).ravel())[:size]
    codes = _CODE[data]
    unclear = codes > 3
    if unclear.any():
        ok &= _within(unclear, length) == 0
        codes &= 3
    # a read in which no window starts before the last place has none
    seen = np.zeros(size + 1, np.int32)
    np.cumsum(ok, out=seen[1:])
    has = np.flatnonzero(starts)
    last = first[has] + starts[has] - 1
    ok[last[seen[last] == seen[first[has]]]] = False
    at = np.flatnonzero(ok)
    good = None
    if params is not None:
        marks, m = characters(quals)
        low = (marks >= 33) & (marks < min(params.quality_threshold, 127))
        if not np.array_equal(m, n):
            both = np.minimum(m, n)
            step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
            spread = np.zeros(len(data), bool)
            spread[np.repeat(first, both) + step] = low[np.repeat(np.cumsum(m) - m, both) + step]
            low = spread
        good = (_within(low, length) <= params.max_bad)[at]
        if quals.null_count:
            good &= ~quals.is_null().to_numpy(zero_copy_only=False)[np.searchsorted(first, at, "right") - 1]
    return rolled(codes, length)[at], at, good, first


class Tally:
    """Counts of identifiers, handed on as (id, n) arrays; an identifier may come in several of them."""

    def __init__(self, length: int):
        self.table = np.zeros(1 << 2 * length, np.int64) if 1 << 2 * length <= TABLE else None
        self.held = np.empty(CHUNK if self.table is None else 0, np.uint32 if length <= 16 else np.uint64)
        self.n = 0

    def add(self, ids: np.ndarray):
        if self.table is not None:
            self.table += np.bincount(ids, minlength=len(self.table))
            return
        while len(ids):
            some = ids[:len(self.held) - self.n]
            self.held[self.n:self.n + len(some)] = some
            self.n += len(some)
            ids = ids[len(some):]
            if self.n == len(self.held):
                yield self._sorted()

    def rest(self):
        if self.table is not None:
            ids = np.flatnonzero(self.table)
            yield ids, self.table[ids]
        elif self.n:
            yield self._sorted()

    def _sorted(self):
        ids = self.held[:self.n]
        ids.sort()
        new = np.ones(len(ids), bool)
        np.not_equal(ids[1:], ids[:-1], out=new[1:])
        at = np.flatnonzero(new)
        self.n = 0
        return ids[at].astype(np.uint64).view(np.int64), np.diff(at, append=len(ids))


def _batches(names, *columns):
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + ROWS]) for c in columns], names=names)


def _rows(ids, n, good):
    """Batches of (id, n[, good]); good: None, or whether all of these windows are."""
    return _batches(["id", "n"], ids, n) if good is None else _batches(["id", "n", "good"], ids, n, n * good)


def _blocks(span: int):
    """What makes batches of (part, ids, n, good): a row for each ``span`` identifiers that occur, with their places in it and their counts."""

    def blocks(ids, n, good):
        part = ids // span
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(at, len(ids)).astype(np.int32)
        n = n.astype(np.uint8) if n.max(initial=0) < 256 else n.astype(np.int64)
        packed = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)])
        columns = [pa.array(part[at].astype(np.int32)), packed((ids % span).astype(np.uint32)), packed(n), pa.array(np.full(len(at), good is not False))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "ids", "n", "good"])

    return blocks


def _add_up(span: int):
    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((2, span), np.int64)
        for b in t.to_batches():
            for ids, n, good in zip(b["ids"], b["n"], b["good"].to_pylist()):
                ids, n = np.frombuffer(ids.as_buffer(), np.uint32), n.as_buffer()
                # the identifiers of a block are distinct
                total[int(good)][ids] += np.frombuffer(n, np.uint8 if n.size == len(ids) else np.int64)
        n = total.sum(axis=0)
        at = np.flatnonzero(n)
        return pa.table({"id": at + t["part"][0].as_py() * span, "n": n[at], "good": total[1][at]})

    return add


def window_totals(reads: DataFrame, length: int, params=None, quality: bool = True, unjudged: bool = False) -> DataFrame:
    """(id, n), with ``good`` as of ``window_counts``: one row for each identifier of all reads."""
    split = params is not None and not quality
    names = ["n", "good"] if split else ["n"]
    if length > PACKED:
        # what a task hands on is counted already, so it is dealt out without another partial step
        each = window_counts(reads, length, params, quality, unjudged).repartition("id")
        return each.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    span = 1 << max(0, 2 * length - LEADING)
    blocks = _counted(reads, length, params, quality, unjudged, _blocks(span), "part int, ids binary, n binary, good boolean")
    return blocks.groupBy("part").applyInArrow(_add_up(span), "id long, n long, good long").select("id", *names)


def window_counts(reads: DataFrame, length: int, params=None, quality: bool = True, unjudged: bool = False) -> DataFrame:
    """(id, n) of windows as tasks count them, an identifier as often as tasks or chunks have it; with params only good windows.

    Without ``quality`` all windows, and a column ``good``, how many of them are; with ``unjudged`` also windows of null qualities.
    """
    return _counted(reads, length, params, quality, unjudged, _rows, "id long, n long" + ", good long" * (params is not None and not quality))


def _counted(reads: DataFrame, length: int, params, quality: bool, unjudged: bool, give, schema: str) -> DataFrame:
    """What ``give`` makes of the identifiers, in order, and counts of a task or chunk."""
    if not 1 <= length <= 32:
        raise ValueError("windows hold 1 to 32 bases")
    split = params is not None and not quality

    def run(batches):
        tallies = [Tally(length) for _ in range(2 if split else 1)]
        out = lambda i, ids, n: give(ids, n, i == 1 if split else None)
        for b in batches:
            ids, _, good, _ = windows_of(b.column(0), b.column(1) if params is not None else None, length, params, unjudged and split)
            parts = [ids] if good is None else [ids[~good], ids[good]] if split else [ids[good]]
            for i, part in enumerate(parts):
                for some in tallies[i].add(part):
                    yield from out(i, *some)
        for i, t in enumerate(tallies):
            for some in t.rest():
                yield from out(i, *some)

    columns = ["bases", "quals"] if params is not None else ["bases"]
    return reads.select(*columns).mapInArrow(run, schema)


READS = "read_id long, bases string, quals string"


def in_turn(batches, cut, size: int):
    """Batches of at most ``size`` reads; ``cut``: what makes batches of ``READS`` of those that come, in the same worker."""
    for b in batches if cut is None else cut(batches):
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def tables(reads: DataFrame, params, cut=None) -> DataFrame:
    """(length, piece, counts) of both spectra of reads, from one pass: counts of all identifiers of a piece, a byte each.

    A count is at most 255, and 0 where the identifier doesn't occur or is below the threshold; pieces without any are left out.
    """
    lengths = (params.k, params.tile)
    spans = {n: 1 << max(0, 2 * n - LEADING) for n in lengths}
    each = [(n, None if n == params.k else params, _blocks(spans[n])) for n in lengths]
    least = params.min_count

    def run(batches):
        tallies = [Tally(n) for n in lengths]

        def give(n, blocks, ids, counts):
            for b in blocks(ids, counts, None):
                yield b.drop_columns("good").append_column("length", pa.array(np.full(b.num_rows, n, np.int32)))

        for b in in_turn(batches, cut, TOGETHER):
            for (n, p, blocks), t in zip(each, tallies):
                ids, _, good, _ = windows_of(b.column("bases"), None if p is None else b.column("quals"), n, p)
                for some in t.add(ids if good is None else ids[good]):
                    yield from give(n, blocks, *some)
        for (n, _, blocks), t in zip(each, tallies):
            for some in t.rest():
                yield from give(n, blocks, *some)

    def add(t: pa.Table) -> pa.Table:
        n = t["length"][0].as_py()
        total = np.zeros(spans[n], np.int64)
        for b in t.to_batches():
            for ids, some in zip(b["ids"], b["n"]):
                ids, some = np.frombuffer(ids.as_buffer(), np.uint32), some.as_buffer()
                total[ids] += np.frombuffer(some, np.uint8 if some.size == len(ids) else np.int64)
        out = np.minimum(total, 255)
        out[out < least] = 0
        row = pa.table({"length": pa.array([n], pa.int32()), "piece": [t["part"][0].as_py()], "counts": pa.array([out.astype(np.uint8).tobytes()], pa.binary())})
        return row.slice(0, int(out.any()))

    rows = reads.select("bases", "quals") if cut is None else reads
    blocks = rows.mapInArrow(run, "part int, ids binary, n binary, length int")
    return blocks.groupBy("length", "part").applyInArrow(add, "length int, piece long, counts binary")


def window_table(reads: DataFrame, length: int, params=None) -> DataFrame:
    """(read_id, pos, id) of all windows, with params of good ones."""
    if not 1 <= length <= 32:
        raise ValueError("windows hold 1 to 32 bases")

    def run(batches):
        for b in batches:
            ids, at, good, first = windows_of(b.column(1), b.column(2) if params is not None else None, length, params)
            if good is not None:
                ids, at = ids[good], at[good]
            read = np.searchsorted(first, at, "right") - 1
            for i in range(0, len(at), ROWS):
                r = read[i:i + ROWS]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array((at[i:i + ROWS] - first[r]).astype(np.int32)), pa.array(ids[i:i + ROWS].astype(np.uint64).view(np.int64))], names=["read_id", "pos", "id"])

    columns = ["read_id", "bases", "quals"] if params is not None else ["read_id", "bases"]
    return reads.select(*columns).mapInArrow(run, f"read_id {reads.schema['read_id'].dataType.simpleString()}, pos int, id long")
