"""Correction of substitution errors, read by read, against the k-mer and tile spectra.

Reads never meet each other here, so they stay where they are: no shuffle, one pass with
Arrow batches. All reads of a batch take their next step together, so a step is a few
array operations and two searches in the spectra, whatever the number of reads. Spectra of
up to BROADCAST_ROWS rows go to every worker as sorted arrays in a broadcast. Larger ones of
short tiles become tables of all identifiers, whose size doesn't depend on the input: tasks write them to the
shared folder in pieces, and every task that needs them reads them once. Those of longer tiles stay where they are
and the questions go to them: see ``routed``.
"""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spectrum, tallies

#: Rows of both spectra together up to which they are broadcast: 9 bytes a row in each worker.
BROADCAST_ROWS = 4_000_000
#: Bases of a tile up to which larger spectra become tables of all identifiers: a byte each, 256 MiB in each worker at 14.
TABLE_BASES = 14
#: Identifiers of a piece of such a table.
PIECE = 1 << 20
#: Reads that take their steps together.
TOGETHER = 4096

ERRORS = "array<struct<pos:int,from:int,to:int,qual:int>>"
_U = np.uint64
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _reverse(x: np.ndarray, length: int) -> np.ndarray:
    """Reverse complements of packed identifiers."""
    for by, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = (x >> _U(by)) & _U(mask) | (x & _U(mask)) << _U(by)
    return ~(x >> _U(32) | x << _U(32)) >> _U(64 - 2 * length)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Settler:
    """Decides many tiles at once.

    ``lookup.known``: k-mers to booleans; ``lookup.count``: tiles to counts, -1 if absent; both are
    also told for which of the tiles to be decided each question is. A lookup that can't answer yet marks those in
    ``lookup.held``: they are left undecided, and nothing that is returned for them counts. One with ``whole`` always
    answers, and nobody counts its questions.
    """

    def __init__(self, params, lookup):
        p = self.p = params
        self.lookup = lookup
        self.of = np.zeros(0, np.int64)  # of each row at work, its place among the tiles to be decided
        self.step_bits = _U(2 * p.step)
        self.tile_mask = _U((1 << 2 * p.step) - 1)
        self.kmer_mask = _U((1 << 2 * p.k) - 1)
        self.overlap_mask = _U((1 << 2 * (p.k - p.step)) - 1)
        self.flip_at = np.repeat(np.arange(p.k), 3)
        self.flips = np.array([f << 2 * at for at in range(p.k) for f in (1, 2, 3)], _U)
        # bases of a tail outside the overlap: places, changes of the tile, of its reverse complement, and both bits
        self.tail_at = np.repeat(np.arange(p.step), 3)
        self.tail_flips = self.flips[:3 * p.step]
        self.back_flips = np.array([f << 2 * (p.tile - 1 - at) for at in range(p.step) for f in (1, 2, 3)], _U)
        self.tail_pairs = np.array([3 << 2 * at for at in self.tail_at.tolist()], _U)

    # a list of k-mers for each row is (row, id, own): own is the k-mer as read, if known
    def _start(self, ids):
        row = np.flatnonzero(self.lookup.known(ids, self.of))
        return row, ids[row], np.ones(len(row), bool)

    def _widen(self, lists, rows, lowest):
        """The lists of ``rows`` with the known one-base neighbours of their members appended."""
        row, ids, _ = lists
        take = rows[row] & (lowest[row] < self.p.k)
        if not take.any():
            return lists
        r, x = row[take], ids[take]
        near = x[:, None] ^ self.flips
        ok = self.flip_at >= lowest[r][:, None]
        r, near = np.broadcast_to(r[:, None], near.shape)[ok], near[ok]
        hit = self.lookup.known(near, self.of[r]) & (near != 0)
        r, near = r[hit], near[hit]
        order = np.lexsort((near, r))
        r, near = r[order], near[order]
        if len(r):
            first = _runs(r, near)
            r, near = r[first], near[first]
        return np.concatenate((row, r)), np.concatenate((ids, near)), np.concatenate((lists[2], np.zeros(len(r), bool)))

    def _pairs(self, heads, tails):
        """Places in both lists of all overlapping heads and tails of one row."""
        (hr, h), (tr, t) = heads[:2], tails[:2]
        if not len(h) or not len(t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = 2 * (self.p.k - self.p.step)
        hk, tk = hr << bits | (h & self.overlap_mask).view(np.int64), tr << bits | (t >> self.step_bits).view(np.int64)
        order = np.argsort(tk, kind="stable")
        tk = tk[order]
        a, b = np.searchsorted(tk, hk, "left"), np.searchsorted(tk, hk, "right")
        n = b - a
        i = np.repeat(np.arange(len(h)), n)
        return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]

    def _tiles(self, heads, tails):
        """(row, tile, count, own) of overlapping pairs; the tile as read is there even if uncounted."""
        (hr, h, ho), (_, t, to) = heads, tails
        i, j = self._pairs(heads, tails)
        tile, own = h[i] << self.step_bits | t[j] & self.tile_mask, ho[i] & to[j]
        count = self.lookup.count(tile, self.of[hr[i]])
        keep = (count >= 0) | own
        return hr[i][keep], tile[keep], np.maximum(count[keep], 0), own[keep]

    def near(self, tile, rounds):
        """(row, strand, tile, count, own, stage) of every counted tile within ``rounds`` of heads and of tails, forward.

        An occurrence each, with the first stage of the search that has it; the tile as read is there even if it isn't counted.
        """
        p, size = self.p, len(tile)
        self.lookup.begin(size)
        self.of = np.arange(size)
        head, tail = tile >> self.step_bits, tile & self.kmer_mask
        lists, levels = [], []
        for i, ids in enumerate((head, tail, _reverse(tail, p.k), _reverse(head, p.k))):
            far = i in (0, 3)
            now = self._start(ids)
            level = np.zeros(len(now[0]), np.int64)
            for r in range(1, rounds[0 if far else 1] + 1):
                now = self._widen(now, np.ones(size, bool), np.full(size, 0 if far else p.k - p.step))
                level = np.concatenate((level, np.full(len(now[0]) - len(level), r)))
            lists.append(now)
            levels.append(level)
        out = []
        for strand, (h, t) in enumerate(((0, 1), (2, 3))):
            i, j = self._pairs(lists[h], lists[t])
            made = lists[h][1][i] << self.step_bits | lists[t][1][j] & self.tile_mask
            row, hl, tl = lists[h][0][i], levels[h][i], levels[t][j]
            count, own = self.lookup.count(made, row), (hl == 0) & (tl == 0)
            # the lists that grow first are tails, and heads on the other strand
            early, late = (hl, tl) if strand else (tl, hl)
            stage = np.maximum(early, np.where(late > 0, late + p.max_distance, 0))
            keep = (count >= 0) | own
            made = _reverse(made, p.tile) if strand else made
            out.append((row[keep], np.full(int(keep.sum()), strand), made[keep], np.maximum(count[keep], 0), own[keep], stage[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _both(self, lists, size):
        """Tiles of both strands; counts add up in rows where both strands have tiles."""
        fr, ft, fn, fo = self._tiles(lists[0], lists[1])
        rr, rt, rn, ro = self._tiles(lists[2], lists[3])
        rt = _reverse(rt, self.p.tile)
        has = np.zeros((2, size), bool)
        has[0, fr] = has[1, rr] = True
        row, tile, n, own = (np.concatenate(x) for x in ((fr, rr), (ft, rt), (fn, rn), (fo, ro)))
        two = (has[0] & has[1])[row]
        if not two.any():
            return row, tile, n, own
        order = np.lexsort((tile[two], row[two]))
        r, t, c, o = (x[two][order] for x in (row, tile, n, own))
        at = _runs(r, t)
        merged = r[at], t[at], np.add.reduceat(c, at), np.logical_or.reduceat(o, at)
        return tuple(np.concatenate((x[~two], y)) for x, y in zip((row, tile, n, own), merged))

    def merged(self, tile, rounds):
        """(row, tile, count) of the tiles within ``rounds``, counts of all occurrences on both strands added up."""
        row, _, near, n, _, _ = self.near(tile, rounds)
        if not len(row):
            return row, near, n
        order = np.lexsort((near, row))
        row, near, n = row[order], near[order], n[order]
        at = _runs(row, near)
        return row[at], near[at], np.add.reduceat(n, at)

    def settle(self, tile, reach, lowest, low):
        """(settled, chosen) of tiles as read: see ``search``."""
        stage, chosen = self.search(tile, reach, lowest, low)
        return stage >= 0, chosen

    def search(self, tile, reach, lowest, low):
        """(stage, chosen) of tiles as read: the first stage that settles each one, -1 if none does.

        reach and lowest: for heads and tails, one array each; low: both bits of each base
        of low quality. Tails are widened first, then heads; the first stage that decides
        counts, and one more stands for a tile that none decides and none is more frequent than.
        A chosen tile that differs from the one read stands for corrections.
        """
        if not self.lookup.whole:
            return self._search_lists(tile, reach, lowest, low)
        size = len(tile)
        settled, chosen = np.full(size, -1), tile.copy()
        few = (reach[0] == 0) & (reach[1] <= 1)
        for some, way in ((few, self._search_tails), (~few, self._search_lists)):
            rows = np.flatnonzero(some)
            if len(rows):
                settled[rows], chosen[rows] = way(tile[rows], [x[rows] for x in reach], [x[rows] for x in lowest], low[rows])
        self.lookup.begin(size)
        return settled, chosen

    def _search_tails(self, tile, reach, lowest, low):
        """``search`` where heads stay and at most one base of a tail is changed: each such change is a column.

        It must leave the overlap alone, so both strands have the same columns.
        """
        p, (s, mask) = self.p, (self.step_bits, self.kmer_mask)
        known, count = self.lookup.known, self.lookup.count
        back = _reverse(tile, p.tile)
        strands = [(x, known(x >> s) & known(x & mask)) for x in (tile, back)]
        any_ = strands[0][1] | strands[1][1]
        have = np.where(any_, sum(np.where(there, np.maximum(count(x), 0), 0) for x, there in strands), -1)
        rare = have < p.min_count
        ok = any_ & ((have >= p.trusted_count) | ~rare & (low == 0))
        settled, chosen = np.where(ok, 0, np.where((reach[1] == 0) & any_ & ~rare, 1, -1)), tile.copy()
        go = np.flatnonzero(~ok & any_ & (reach[1] > 0))
        n, there = np.zeros((len(go), len(self.tail_at)), np.int64), np.zeros((len(go), len(self.tail_at)), bool)
        least = lowest[1][go, None]
        for (x, own), flips, at in zip(strands, (self.tail_flips, self.back_flips), (self.tail_at, p.k - 1 - self.tail_at)):
            row, col = np.nonzero(own[go, None] & (at >= least))
            near = x[go[row]] ^ flips[col]
            changed = near & mask if x is tile else near >> s
            hit = np.flatnonzero(known(changed) & (changed != 0))
            row, col, found = row[hit], col[hit], count(near[hit])
            hit = found >= 0
            row, col = row[hit], col[hit]
            n[row, col] += found[hit]
            there[row, col] = True
        have, rare, low = have[go], rare[go], low[go]
        doubtful = (n >= (have / p.ratio).astype(np.int64)[:, None]) & (low[:, None] & self.tail_pairs != 0)
        pick = there & (n >= p.min_count) & (rare[:, None] | doubtful)
        options, alone = np.count_nonzero(pick, axis=1), ~there.any(1)
        ok = ~alone & ((options == 1) | ~rare & (options == 0))
        stands = ~rare & (n.max(axis=1, initial=0) <= have)
        settled[go] = np.where(ok, 1, np.where(stands, 2, -1))
        one = np.flatnonzero(ok & (options == 1))
        chosen[go[one]] ^= self.tail_flips[pick[one].argmax(axis=1)]
        return settled, chosen

    def _search_lists(self, tile, reach, lowest, low):
        """``search`` by lists of k-mers, for any reach."""
        p, size = self.p, len(tile)
        settled, chosen = np.full(size, -1), tile.copy()
        self.lookup.begin(size)
        self.of = np.arange(size)
        head, tail = tile >> self.step_bits, tile & self.kmer_mask
        lists = [self._start(x) for x in (head, tail, _reverse(tail, p.k), _reverse(head, p.k))]
        back, low_now = np.arange(size), low
        reach, lowest = [x.copy() for x in reach], list(lowest)
        done = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
        while len(back):
            m = len(back)
            ok, to, stands = self._decide(self._both(lists, m), tile[back], low_now)
            held = self.lookup.held[back]
            ok &= ~held
            tails = ~ok & ~held & (done[1] < reach[1])
            heads = ~ok & ~held & ~tails & (done[0] < reach[0])
            last = ~ok & ~held & ~tails & ~heads
            late = last & stands  # nothing settled it: the tile stands if no other is more frequent
            ok |= late
            settled[back[ok]], chosen[back[ok]] = (done[0] + done[1] + late)[ok], to[ok]
            for i in (1, 2):
                lists[i] = self._widen(lists[i], tails, lowest[1])
            for i in (0, 3):
                lists[i] = self._widen(lists[i], heads, lowest[0])
            done[1] += tails
            done[0] += heads
            go = tails | heads
            place = np.cumsum(go) - 1
            lists = [(place[r[go[r]]], x[go[r]], o[go[r]]) for r, x, o in lists]
            back, low_now = back[go], low_now[go]
            self.of = back
            reach, lowest, done = ([x[go] for x in v] for v in (reach, lowest, done))
        return settled, chosen

    def _decide(self, tiles, read, low):
        """(settled, chosen, whether the tile as read is the most frequent and frequent enough)."""
        p, size = self.p, len(read)
        row, tile, n, own = tiles
        have = np.full(size, -1, np.int64)
        have[row[own]] = n[own]
        number = np.bincount(row, minlength=size)
        most = np.zeros(size, np.int64)
        np.maximum.at(most, row, n)
        other = ~own & (n >= p.min_count)
        row, tile, n = row[other], tile[other], n[other]
        rare = have < p.min_count
        level = (have / p.ratio).astype(np.int64)
        doubtful = (n >= level[row]) & (self._differs(tile ^ read[row]) & low[row] != 0)
        pick = np.where(rare[row], True, doubtful)
        options = np.bincount(row[pick], minlength=size)
        to = read.copy()
        to[row[pick]] = tile[pick]
        any_, alone, trusted = number > 0, number == 1, have >= p.trusted_count
        settled = any_ & (trusted | np.where(alone, ~rare & (low == 0), np.where(rare, options == 1, options <= 1)))
        to = np.where(trusted | alone | (options != 1), read, to)
        return settled, to, any_ & ~rare & (most <= have)

    def _differs(self, x):
        """Both bits of each base that differs."""
        pairs = (x | x >> _U(1)) & _U(0x5555555555555555)
        return pairs | pairs << _U(1)


def _rolled(codes: np.ndarray, length: int) -> np.ndarray:
    """Of every place in rows of codes from 0 to 3 the packed window; the last ``length`` - 1 of a row have none."""
    out = np.zeros(codes.shape, np.uint32 if length <= 16 else _U)
    out.reshape(-1)[:max(0, codes.size - length + 1)] = tallies.rolled(codes.reshape(-1), length) if codes.size >= length else 0
    return out


class Walk:
    """Reads on their way, all at their own place. Codes (4 where ambiguous) are changed in place.

    ``found`` has (read, pos, from, to, qual) of the errors so far, in the order in which they were found.
    """

    STATE = ("codes", "quals", "length", "alive", "pos", "last", "turn", "crawling", "reach", "lowest", "found")

    def __init__(self, params, codes: np.ndarray, quals: np.ndarray, length: np.ndarray):
        p, size = params, len(codes)
        self.p, self.codes, self.quals, self.length = p, codes, quals, length
        self.pos, self.last, self.turn = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        self.crawling, self.alive = np.zeros(size, bool), length >= p.tile
        self.reach = np.full((2, size), p.max_distance)
        self.lowest = np.stack((np.zeros(size, np.int64), np.full(size, p.k - p.step)))
        self.found = np.zeros((5, 0), np.int64)

    def run(self, settler: Settler) -> None:
        """Takes all living reads to their ends, or as far as the lookup has answers."""
        p, tile = self.p, self.p.tile
        codes, quals, length, pos, last, turn, crawling, reach, lowest = self.codes, self.quals, self.length, self.pos, self.last, self.turn, self.crawling, self.reach, self.lowest
        places = np.arange(tile)
        shifts = (2 * (tile - 1 - places)).astype(_U)
        live = np.flatnonzero(self.alive)
        if not len(live):
            return
        # of every place its window's identifier, both bits of its bases of low quality, and whether a base is ambiguous
        ids, lows = _rolled(codes & 3, tile), _rolled(np.where(quals < p.low_quality, np.uint8(3), np.uint8(0)), tile)
        unclear = codes > 3
        unclear = _rolled(unclear.astype(np.uint8), tile) > 0 if unclear[live].any() else None
        found = [self.found]
        while len(live):
            if unclear is not None:
                clean = ~unclear[live, pos[live]]
                self.alive[live[~clean]] = False
                live = live[clean]
            mine, low = ids[live, pos[live]].astype(_U), lows[live, pos[live]].astype(_U)
            ok, to = settler.settle(mine, [x[live] for x in reach], [x[live] for x in lowest], low)
            go = ~settler.lookup.held
            live, mine, ok, to = (x[go] for x in (live, mine, ok, to))
            changed = np.flatnonzero(ok & (to != mine))
            if len(changed):
                at = live[changed]
                base, part = ((x[changed, None] >> shifts & _U(3)).astype(np.uint8) for x in (to, mine))
                r, c = np.nonzero((base != part)[:, ::-1])  # right to left
                c = tile - 1 - c
                i, j = at[r], pos[at[r]] + c
                found.append(np.stack((i, j, base[r, c], part[r, c], quals[i, j])))
                codes[i, j] = base[r, c]
                ids[at] = _rolled(codes[at] & 3, tile)
            n = length[live]
            start = pos[live]
            over = ok & (start + tile == n)
            last[live[ok]] = start[ok]
            free = ok & ~over & ~crawling[live]
            r, s = live[free], start[free]
            whole = s + p.step <= n[free] - tile
            lowest[0][r], lowest[1][r] = p.k, np.where(whole, 0, s + tile + p.step - n[free])
            reach[0][r], reach[1][r] = 0, p.max_distance
            pos[r] = np.where(whole, s + p.step, n[free] - tile)
            begin = live[~ok & ~crawling[live]]
            crawling[begin], turn[begin] = True, pos[begin]
            crawl = crawling[live] & ~over
            stop = crawl & ((last[live] == -1) | (pos[live] == last[live] + 1))
            r = live[crawl & ~stop]
            pos[r] = last[r] + 1
            crawling[r] = pos[r] != turn[r]
            reach[0][r], reach[1][r], lowest[0][r], lowest[1][r] = 0, 1, p.k, p.k - 3
            settler.lookup.ahead(self, live[changed], begin)
            self.alive[live[over | stop]] = False
            live = live[~over & ~stop]
            fits = pos[live] + tile <= length[live]
            self.alive[live[~fits]] = False
            live = live[fits]
        self.found = np.concatenate(found, axis=1)


def walk(settler: Settler, codes: np.ndarray, quals: np.ndarray, length: np.ndarray):
    """(read, pos, from, to, qual) of all errors, by read in the order in which they are found.

    codes: reads by positions, 4 where ambiguous; changed in place.
    """
    w = Walk(settler.p, codes, quals, length)
    w.run(settler)
    return w.found[:, np.argsort(w.found[0], kind="stable")]


# lookups ---------------------------------------------------------------------------------
def _search(ids, x):
    """Place of each x in sorted ids, -1 if it isn't there."""
    if not len(ids):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where(ids[at] == x, at, -1)


class Arrays:
    """Spectra as sorted arrays: every question is answered at once."""

    whole = True

    def __init__(self, kmers, tiles, counts):
        self.kmers, self.tiles, self.counts = kmers, tiles, counts
        self.held = np.zeros(0, bool)

    def begin(self, size):
        self.held = np.zeros(size, bool)

    def known(self, x, rows=None):
        return _search(self.kmers, x) >= 0

    def count(self, x, rows=None):
        at = _search(self.tiles, x)
        return np.where(at >= 0, self.counts[at].astype(np.int64), -1) if len(self.counts) else at

    def ahead(self, walk, changed, crawling):
        """Nothing to be asked in advance."""


class Tables:
    """Spectra as tables of all identifiers, a byte each: the count, 0 if absent; for k-mers whether they occur."""

    whole = True

    def __init__(self, kmers, tiles):
        self.kmers, self.tiles = kmers, tiles
        self.held = np.zeros(0, bool)

    def begin(self, size):
        self.held = np.zeros(size, bool)

    def known(self, x, rows=None):
        return self.kmers[x.view(np.int64)] > 0

    def count(self, x, rows=None):
        n = self.tiles[x.view(np.int64)].astype(np.int64)
        n[n == 0] = -1
        return n

    def ahead(self, walk, changed, crawling):
        """Nothing to be asked in advance."""


def _pieces(column: str, marks: Column, spectrum: DataFrame, length: int, path: str) -> None:
    """Writes the table of a spectrum as rows (piece, counts), PIECE identifiers each; pieces without any are left out."""
    span = min(PIECE, 1 << 2 * length)

    def fill(batches):
        made = {}  # all pieces of a spectrum together are one table, so those of a task are no more
        for b in batches:
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            pieces = ids // span
            for i in np.unique(pieces).tolist():
                mine = pieces == i
                made.setdefault(i, np.zeros(span, np.uint8))[ids[mine] % span] = marks[mine]
        for i, out in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out.tobytes()], pa.binary())], names=["piece", "counts"])

    rows = spectrum.select(F.col(column).cast("long").alias("id"), marks.cast("int").alias("mark"))
    rows.repartition(F.floor(F.col("id") / span)).mapInArrow(fill, "piece long, counts binary").write.parquet(path)


def _table(path: str, length: int) -> np.ndarray:
    """The table that was written as pieces."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    local = path.startswith(("/", "file:"))
    files, inner = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
    out = np.zeros(1 << 2 * length, np.uint8)
    for f in files.get_file_info(fs.FileSelector(inner, allow_not_found=True)):  # an empty spectrum has no pieces
        if f.base_name.startswith("part-"):
            for batch in pq.ParquetFile(f.path, filesystem=files).iter_batches(batch_size=4):
                for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    some = np.frombuffer(counts.as_buffer(), np.uint8)
                    out[piece * len(some):(piece + 1) * len(some)] = some
    return out


class Counting:
    """A lookup that counts its questions and those that the spectra have no answer for."""

    whole = False

    def __init__(self, lookup):
        self.lookup, self.asked, self.missed = lookup, [0, 0], [0, 0]

    def begin(self, size):
        self.lookup.begin(size)

    @property
    def held(self):
        return self.lookup.held

    def _count(self, kind, n, missed):
        self.asked[kind] += n
        self.missed[kind] += int(missed)

    def known(self, x, rows=None):
        hit = self.lookup.known(x, rows)
        self._count(0, len(x), len(x) - hit.sum())
        return hit

    def count(self, x, rows=None):
        n = self.lookup.count(x, rows)
        self._count(1, len(x), (n < 0).sum())
        return n

    def ahead(self, walk, changed, crawling):
        self.lookup.ahead(walk, changed, crawling)


#: What a task tells of itself: its number, reads, reads with errors, lookups and misses, and seconds of its own.
TASK_STATS = [("task", pa.int32()), *((n, pa.int64()) for n in ("reads", "corrected", "kmer_lookups", "kmer_misses", "tile_lookups", "tile_misses")), ("seconds", pa.float64())]


def _worker_lookup(key, make):
    kept = sys.modules.setdefault("_helixframe_spectra", types.ModuleType("_helixframe_spectra"))
    if getattr(kept, "key", None) != key:
        kept.key = kept.lookup = None  # the last one goes before the next is made
        kept.lookup, kept.key = make(), key
    return kept.lookup


def _arrays(kmers: DataFrame, tiles: DataFrame):
    """Sorted arrays on the driver; called behind a check of the number of rows."""
    ids = kmers.select("kmer_id").toArrow()["kmer_id"].to_numpy().view(_U)
    t = tiles.select("tile_id", "cnt").toArrow()
    tid, cnt = t["tile_id"].to_numpy().view(_U), t["cnt"].to_numpy()
    order = np.argsort(tid)
    return np.sort(ids), tid[order], cnt[order].astype(np.uint8 if not len(cnt) or cnt.max() < 256 else np.int64)


def _matrix(texts: list, length: np.ndarray) -> np.ndarray:
    """Bytes of the texts of a positive length, one row each, filled up with 0."""
    out = np.zeros((len(texts), int(length.max(initial=0))), np.uint8)
    for i in np.flatnonzero(length).tolist():
        out[i, :length[i]] = np.frombuffer(texts[i].encode("latin-1", "replace"), np.uint8)
    return out


def _rows_of(data: np.ndarray, n: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Bytes of texts of ``n`` bytes each as rows filled up with 0; those not to be used are empty."""
    size = np.where(use, n, 0)
    width = int(size.max(initial=0))
    if len(n) and (size == width).all():
        return data.reshape(len(n), width).copy() if width else np.zeros((len(n), 0), np.uint8)
    out = np.zeros((len(n), width), np.uint8)
    out[np.arange(width) < size[:, None]] = data if use.all() else data[np.repeat(use, n)]
    return out


def _errors_of(settler, bases, quals) -> np.ndarray:
    """Errors of one piece of a batch as of ``walk``; reads of unequal lengths of bases and qualities have none."""
    (b, n), (q, m) = tallies.characters(bases), tallies.characters(quals)
    use = (n == m) & (n > 0)
    return walk(settler, _CODE[_rows_of(b, n, use)], _rows_of(q, m, use), np.where(use, n, 0))


def _walk_batch(settler, ids, bases, quals):
    """Identifiers and errors of one piece of a batch."""
    found = _errors_of(settler, bases, quals)
    ends = np.concatenate(([0], np.cumsum(np.bincount(found[0].astype(np.int64), minlength=len(ids)))))
    fields = [pa.array(found[i].astype(np.int32)) for i in range(1, 5)]
    errors = pa.StructArray.from_arrays(fields, names=["pos", "from", "to", "qual"])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), errors)], names=["read_id", "errs"])


def _put_in(bases: pa.Array, found: np.ndarray) -> pa.Array:
    """Bases with the replacements of ``found`` put in, as of ``apply_errors``."""
    if not found.shape[1]:
        return bases
    new = np.frombuffer(b"acgt", np.uint8)[found[2]]
    if pc.sum(pc.binary_length(bases)).as_py() != pc.sum(pc.utf8_length(bases)).as_py():
        texts = bases.to_pylist()
        for i, pos, x in zip(found[0].tolist(), found[1].tolist(), new.tolist()):
            texts[i] = texts[i][:pos] + chr(x) + texts[i][pos + 1:]
        return pa.array(texts, pa.string())
    ends = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset:bases.offset + len(bases) + 1]
    data = np.frombuffer(bases.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy()
    ends = ends - ends[0]
    data[ends[found[0]] + found[1]] = new  # of several for one place the last stays
    out = pa.StringArray.from_buffers(len(bases), pa.py_buffer(ends), pa.py_buffer(data))
    return pc.if_else(bases.is_valid(), out, pa.scalar(None, pa.string())) if bases.null_count else out


def _made(reads: DataFrame, cut) -> DataFrame:
    return reads if cut is None else reads.mapInArrow(cut, tallies.READS)


class Corrector:
    """Both spectra made ready once, for any number of read tables.

    Up to ``broadcast_rows`` rows are broadcast; larger spectra of tiles of up to ``table_bases`` bases and counts from 1 to 255
    become tables in the shared folder; others are stored in buckets, and reads are corrected in supersteps. In any case the spectra are computed once, and tables that the caller keeps
    persisted stay so. ``shared``: folder for the tables of supersteps, by default
    ``spark.checkpoint.dir``. ``close`` frees what was made.
    """

    def __init__(self, kmers: DataFrame, tiles: DataFrame, params, broadcast_rows: int = BROADCAST_ROWS, shared: str | None = None, table_bases: int = TABLE_BASES):
        self.params, self.key, self.routed, self.sent, self.folder = params, uuid.uuid4().hex, None, None, None
        self.inner = {params.k: "kmers", params.tile: "tiles"}
        spark = self.spark = kmers.sparkSession
        shared = shared or spark.conf.get("spark.checkpoint.dir", None)
        own = [df.persist() for df in (kmers, tiles) if df.storageLevel == StorageLevel.NONE]
        try:
            n, low, high = tiles.agg(F.count(F.lit(1)), F.min("cnt"), F.max("cnt")).first()
            if kmers.count() + n <= broadcast_rows:
                self.sent = spark.sparkContext.broadcast(_arrays(kmers, tiles))
            elif shared and params.tile <= table_bases and n and 1 <= low and high <= 255:
                self.folder = f"{shared.rstrip('/')}/helixframe/tables-{self.key}"
                _pieces("kmer_id", F.lit(1), kmers, params.k, f"{self.folder}/kmers")
                _pieces("tile_id", F.col("cnt"), tiles, params.tile, f"{self.folder}/tiles")
            else:
                from .routed import Routed

                self.routed = Routed(kmers, tiles, params, shared)
        finally:
            for df in own:
                df.unpersist()

    @classmethod
    def of_reads(cls, reads: DataFrame, params, shared: str | None = None, cut=None) -> "Corrector":
        """For reads against their own spectra. Tables are written from what one pass over the reads counts; no identifier becomes a row.

        ``cut``, here and below: ``reads`` are what it makes reads of, as of ``tallies.in_turn``, without a worker between.
        """
        shared = shared or reads.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared or params.tile > TABLE_BASES:
            reads = _made(reads, cut)
            return cls(spectrum.kmer_spectrum(reads, params), spectrum.tile_spectrum(reads, params), params, shared=shared)
        out = cls.__new__(cls)
        out.params, out.key, out.routed, out.sent, out.spark = params, uuid.uuid4().hex, None, None, reads.sparkSession
        out.folder = f"{shared.rstrip('/')}/helixframe/tables-{out.key}"
        out.inner = {n: f"length={n}" for n in (params.k, params.tile)}
        tallies.tables(reads, params, cut).write.partitionBy("length").parquet(out.folder)
        return out

    def _make(self):
        """What gives a task its lookup.

        Arrays stay in the worker for later tasks. Tables go with their task: a worker that waits, or cuts reads for
        another one, would hold them for nothing.
        """
        sent, folder, k, tile, inner, key = self.sent, self.folder, self.params.k, self.params.tile, self.inner, self.key
        if sent:
            return lambda: _worker_lookup(key, lambda: Arrays(*sent.value))
        return lambda: Tables(*(_table(f"{folder}/{inner[n]}", n) for n in (k, tile)))

    def correct(self, reads: DataFrame, cut=None) -> DataFrame:
        """(read_id, errs) of every read, errs empty where nothing is corrected."""
        if self.routed:
            return self.routed.correct(_made(reads, cut))
        params, make = self.params, self._make()

        def run(batches):
            settler = Settler(params, make())
            for b in tallies.in_turn(batches, cut, TOGETHER):
                yield _walk_batch(settler, *b.columns)

        rows = reads.select("read_id", "bases", "quals") if cut is None else reads
        return rows.mapInArrow(run, f"read_id long, errs {ERRORS}")

    def corrected(self, reads: DataFrame, cut=None) -> DataFrame:
        """(read_id, bases, quals) with corrections put in; where the spectra are in the workers, reads stay where they are."""
        if self.routed:
            reads = _made(reads, cut)
            return corrected_reads(reads, self.correct(reads))
        params, make = self.params, self._make()

        def run(batches):
            settler = Settler(params, make())
            for b in tallies.in_turn(batches, cut, TOGETHER):
                ids, bases, quals = b.columns
                yield pa.RecordBatch.from_arrays([ids, _put_in(bases, _errors_of(settler, bases, quals)), quals], names=["read_id", "bases", "quals"])

        rows = reads.select("read_id", "bases", "quals") if cut is None else reads
        return rows.mapInArrow(run, rows.schema if cut is None else tallies.READS)

    def near_tiles(self, pairs: DataFrame, rounds: tuple[int, int]) -> DataFrame:
        """(h0, t0, strand, tile_id, cnt, own, stage) of the tiles near those of ``pairs``; for spectra in the workers."""

        def one(settler, tile, h0, t0):
            row, strand, near, count, own, stage = settler.near(tile, rounds)
            take = pa.array(row)
            return [h0.take(take), t0.take(take), pa.array(strand.astype(np.int32)), pa.array(near.view(np.int64)), pa.array(count), pa.array(own), pa.array(stage.astype(np.int32))]

        return self._by_tile(pairs.select("h0", "t0"), one, "h0 long, t0 long, strand int, tile_id long, cnt long, own boolean, stage int")

    def merged_tiles(self, pairs: DataFrame, rounds: tuple[int, int]) -> DataFrame:
        """(h0, t0, tile_id, good_cnt) of the tiles near those of distinct ``pairs``, counts of both strands added up; for spectra in the workers."""

        def one(settler, tile, h0, t0):
            row, near, n = settler.merged(tile, rounds)
            take = pa.array(row)
            return [h0.take(take), t0.take(take), pa.array(near.view(np.int64)), pa.array(n)]

        return self._by_tile(pairs.select("h0", "t0"), one, "h0 long, t0 long, tile_id long, good_cnt long")

    def search_tiles(self, first: DataFrame) -> DataFrame:
        """(read_id, stage, chosen, own) of first tiles (read_id, h0, t0, low), as of ``search.search``; for spectra in the workers."""
        p = self.params

        def one(settler, tile, h0, t0, ids, low):
            size = len(tile)
            reach, lowest = [np.full(size, p.max_distance)] * 2, [np.zeros(size, np.int64), np.full(size, p.k - p.step)]
            stage, chosen = settler.search(tile, reach, lowest, low.to_numpy(zero_copy_only=False).view(_U))
            return [ids, pa.array(stage.astype(np.int32)), pa.array(np.where(stage < 0, -1, chosen.view(np.int64))), pa.array(tile.view(np.int64))]

        return self._by_tile(first.select("h0", "t0", "read_id", "low"), one, "read_id long, stage int, chosen long, own long")

    def _by_tile(self, rows: DataFrame, one, schema: str) -> DataFrame:
        """What ``one`` makes of a few rows (h0, t0, ...) at a time, with the spectra in the workers."""
        if self.routed:
            raise ValueError("supersteps don't keep spectra in the workers")
        params, make = self.params, self._make()
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            settler = Settler(params, make())
            for b in batches:
                for at in range(0, b.num_rows, TOGETHER // 4):
                    h0, t0, *more = (c.slice(at, TOGETHER // 4) for c in b.columns)
                    head, tail = (x.to_numpy(zero_copy_only=False).view(_U) for x in (h0, t0))
                    yield pa.RecordBatch.from_arrays(one(settler, head << settler.step_bits | tail & settler.tile_mask, h0, t0, *more), names=names)

        return rows.mapInArrow(run, schema)

    def correct_counted(self, reads: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
        """Corrections as of ``correct``, and a row of statistics for each task, both from one pass written to ``path``.

        A task's statistics are its last row and are committed with its corrections, so an attempt that is
        lost or repeated counts once. For spectra in the workers; supersteps have a report of their own.
        """
        if self.routed:
            raise ValueError("supersteps report their own work")
        params, make = self.params, self._make()
        kind = pa.struct(TASK_STATS)

        def run(batches):
            import time

            from pyspark import TaskContext

            began, n, corrected = time.perf_counter(), 0, 0
            lookup = Counting(make())
            settler = Settler(params, lookup)
            for b in batches:
                for at in range(0, b.num_rows, TOGETHER):
                    out = _walk_batch(settler, *(b.column(i).slice(at, TOGETHER) for i in range(3)))
                    n += out.num_rows
                    corrected += int((np.diff(out.column(1).offsets.to_numpy()) > 0).sum())
                    yield out.append_column("stats", pa.nulls(out.num_rows, kind))
            each = [TaskContext.get().partitionId(), n, corrected, lookup.asked[0], lookup.missed[0], lookup.asked[1], lookup.missed[1], time.perf_counter() - began]
            row = dict(zip((x for x, _ in TASK_STATS), each))
            errors = pa.array([None], pa.list_(pa.struct([(x, pa.int32()) for x in ("pos", "from", "to", "qual")])))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), errors, pa.array([row], kind)], names=["read_id", "errs", "stats"])

        names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
        schema = f"read_id long, errs {ERRORS}, stats struct<{', '.join(f'{x}: {names[t]}' for x, t in TASK_STATS)}>"
        rows = reads.select(F.col("read_id").cast("long").alias("read_id"), "bases", "quals").mapInArrow(run, schema)
        rows.write.mode("overwrite").parquet(path)
        table = reads.sparkSession.read.schema(rows.schema).parquet(path)
        return table.where("stats IS NULL").select("read_id", "errs"), table.where("stats IS NOT NULL").select("stats.*")

    def close(self) -> None:
        if self.routed:
            self.routed.close()
        elif self.sent:
            self.sent.destroy()
        else:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def correct(reads: DataFrame, kmers: DataFrame, tiles: DataFrame, params, broadcast_rows: int = BROADCAST_ROWS, shared: str | None = None) -> DataFrame:
    """(read_id, errs) of every read, errs empty where nothing is corrected.

    ``from`` is the replacement, ``to`` the base in the read, qual the quality's code. A
    null read, or one shorter than a tile, has no errors. The result does not depend on
    how reads are split or ordered. Both spectra are computed once.
    """
    ready = Corrector(kmers, tiles, params, broadcast_rows, shared)
    out = ready.correct(reads)
    if ready.routed:
        ready.close()  # its result lies in the shared folder
    return out


def apply_errors(bases: Column, errs: Column) -> Column:
    """Bases with the replacements put in; replaced bases are in lower case."""
    one = lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["pos"]), F.substr(F.lit("acgt"), e["from"] + 1, F.lit(1)), F.substr(acc, e["pos"] + 2))
    return F.aggregate(errs, bases, one)


def corrected_reads(reads: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reads with corrections applied; reads without any stay as they are."""
    some = corrections.where(F.size("errs") > 0).select("read_id", "errs")
    joined = reads.join(some, "read_id", "left")
    return joined.select("read_id", F.when(F.col("errs").isNull(), F.col("bases")).otherwise(apply_errors(F.col("bases"), F.col("errs"))).alias("bases"), "quals")
