"""Correction against spectra of any size, in supersteps: questions go to the spectra, answers come back.

Reads travel in blocks of ``BLOCK``. A superstep takes every read of a block as far as the answers that the
block has allow; a read that needs an identifier of which nothing is known yet stays at its place. The
block's new questions, each identifier once, are then dealt out to the buckets of the stored
spectra, which don't move, found counts come back to the block, and the next superstep goes on. Reads
that have reached their end leave with their errors, and blocks without reads leave too. No worker
ever holds more of a spectrum than what its blocks have asked for.

To save supersteps a read asks ahead: at the start for all the windows that it visits if nothing is wrong with it,
after a correction for the windows that have changed, and where it crawls for those on the way.

Every superstep's table lies in the shared folder, so a lost executor costs the work of one step.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import StoredSpectrum
from . import correct as kernel

#: Reads of a block, and supersteps after which an unfinished run is an error.
BLOCK, MOST_STEPS = 512, 100_000
_U = np.uint64
_ERRORS = f"array<{kernel.ERRORS}>"
_TABLE = f"block long, state binary, ask_kmers array<long>, ask_tiles array<long>, ids array<long>, errs {_ERRORS}, living long"


class Answers:
    """What a block knows so far; anything else is held and asked for."""

    NAMES = ("kmers", "is_kmer", "tiles", "counts")
    whole = False

    def __init__(self, kmers, is_kmer, tiles, counts):
        self.kmers, self.is_kmer, self.tiles, self.counts = kmers, is_kmer, tiles, counts
        self.asks: dict[str, list] = {"kmers": [], "tiles": []}
        self.held = np.zeros(0, bool)

    @classmethod
    def none(cls):
        return cls(np.zeros(0, _U), np.zeros(0, bool), np.zeros(0, _U), np.zeros(0, np.int64))

    def begin(self, size):
        self.held = np.zeros(size, bool)

    def _missing(self, name, at, x, rows):
        gone = at < 0
        if gone.any():
            self.asks[name].append(x[gone])
            if rows is not None:
                self.held[rows[gone]] = True

    def known(self, x, rows=None):
        at = kernel._search(self.kmers, x)
        self._missing("kmers", at, x, rows)
        return (at >= 0) & self.is_kmer[at] if len(self.is_kmer) else np.zeros(len(x), bool)

    def count(self, x, rows=None):
        at = kernel._search(self.tiles, x)
        self._missing("tiles", at, x, rows)
        return np.where(at >= 0, self.counts[at], -1) if len(self.counts) else at

    def ahead(self, walk, changed, crawling):
        """Windows that reads will come to: after a correction the rest of their way, else where they crawl."""
        p = walk.p
        if len(changed):
            self.ask_windows(walk, changed, walk.pos[changed], walk.length[changed] - p.tile, p.step)
        if len(crawling):
            self.ask_windows(walk, crawling, walk.last[crawling] + 1, walk.turn[crawling], 1)

    def ask_windows(self, walk, reads, first, end, by):
        """Both strands of the tiles of ``reads`` that start at first, first + by, ... and at end."""
        p, tile = walk.p, walk.p.tile
        most = int((np.maximum(end - first, 0) // by).max(initial=-1)) + 1
        at = np.minimum(first[:, None] + by * np.arange(most + 1), np.maximum(end, 0)[:, None])
        at = np.minimum(at, np.maximum(walk.length[reads] - tile, 0)[:, None])
        for i in range(0, len(reads), 64):
            part = walk.codes[reads[i:i + 64, None, None], at[i:i + 64, :, None] + np.arange(tile)]
            part = part[(part < 4).all(2)]
            shifts = (2 * (tile - 1 - np.arange(tile))).astype(_U)
            ids = np.unique(np.bitwise_or.reduce(part.astype(_U) << shifts, axis=1)) if len(part) else np.zeros(0, _U)
            both = np.concatenate((ids, kernel._reverse(ids, tile)))
            self.count(both)
            self.known(np.concatenate((both >> _U(2 * p.step), both & _U((1 << 2 * p.k) - 1))))

    def taken(self, name) -> np.ndarray:
        """The new questions, each once."""
        return np.unique(np.concatenate(self.asks[name])) if self.asks[name] else np.zeros(0, _U)

    def add(self, asked_kmers, found_kmers, asked_tiles, found_tiles, found_counts):
        """The answers to all questions of the last superstep; what wasn't found isn't there."""
        k = np.concatenate((self.kmers, asked_kmers))
        order = np.argsort(k)
        self.kmers, self.is_kmer = k[order], np.concatenate((self.is_kmer, np.isin(asked_kmers, found_kmers)))[order]
        counts = np.full(len(asked_tiles), -1, np.int64)
        if len(found_tiles):
            counts[np.searchsorted(asked_tiles, found_tiles)] = found_counts
        t = np.concatenate((self.tiles, asked_tiles))
        order = np.argsort(t)
        self.tiles, self.counts = t[order], np.concatenate((self.counts, counts))[order]


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _step(params, block: int, walk: kernel.Walk, ids: np.ndarray, answers: Answers):
    """One superstep of a block: its row of the next table."""
    walk.run(kernel.Settler(params, answers))
    done = ~walk.alive
    order = np.argsort(walk.found[0], kind="stable")
    found = walk.found[:, order]
    mine = done[found[0]] if found.size else np.zeros(0, bool)
    each = {int(i): [] for i in np.flatnonzero(done)}
    for i, pos, new, old, qual in found[:, mine].T.tolist():
        each[i].append({"pos": pos, "from": new, "to": old, "qual": qual})
    left = np.flatnonzero(~done)
    place = np.cumsum(~done) - 1
    keep = found[:, ~mine].copy()
    if keep.size:
        keep[0] = place[keep[0]]
    arrays = {n: getattr(walk, n) for n in kernel.Walk.STATE}
    arrays = {n: a[:, left] if n in ("reach", "lowest") else a[left] for n, a in arrays.items() if n != "found"}
    ask = {n: answers.taken(n) for n in ("kmers", "tiles")} if len(left) else {n: np.zeros(0, _U) for n in ("kmers", "tiles")}
    state = _pack(**arrays, found=keep, ids=ids[left], **{"a_" + n: getattr(answers, n) for n in Answers.NAMES}) if len(left) else b""
    return {"block": block, "state": state, "ask_kmers": ask["kmers"].view(np.int64), "ask_tiles": ask["tiles"].view(np.int64),
            "ids": [None if x == _NULL else x for x in ids[done].tolist()], "errs": list(each.values()), "living": len(left)}


#: Stands for a null read_id inside a state; no other id may have it.
_NULL = -(1 << 63)


def _row(r: dict) -> pa.RecordBatch:
    errors = pa.list_(pa.list_(pa.struct([(n, pa.int32()) for n in ("pos", "from", "to", "qual")])))
    longs = pa.list_(pa.int64())
    kinds = {"block": pa.int64(), "state": pa.binary(), "ask_kmers": longs, "ask_tiles": longs, "ids": longs, "errs": errors, "living": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[n]], kind) for n, kind in kinds.items()], names=list(kinds))


def _begin(params, block: int):
    """Blocks of reads with their first questions; reads of unequal lengths of bases and qualities end at once."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, block):
                ids, bases, quals = (b.column(i).slice(at, block) for i in range(3))
                texts, q = bases.to_pylist(), quals.to_pylist()
                n = np.array([len(x) if x and y and len(x) == len(y) else 0 for x, y in zip(texts, q)], np.int64)
                walk = kernel.Walk(params, kernel._CODE[kernel._matrix(texts, n)], kernel._matrix(q, n), n)
                answers = Answers.none()
                start = np.flatnonzero(walk.alive)
                if len(start):
                    answers.ask_windows(walk, start, walk.pos[start], n[start] - params.tile, params.step)
                yield _row(_step(params, number, walk, ids.fill_null(_NULL).to_numpy(zero_copy_only=False), answers))
                number += 1

    return run


def _go_on(params):
    """The next superstep of blocks (block, state, asked and found identifiers)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                with np.load(io.BytesIO(r["state"])) as s:
                    state = {n: s[n] for n in s.files}
                walk = kernel.Walk.__new__(kernel.Walk)
                walk.p = params
                for n in kernel.Walk.STATE:
                    setattr(walk, n, state[n])
                answers = Answers(*(state["a_" + n] for n in Answers.NAMES))
                ids = lambda name: np.array(r[name] or [], np.int64).view(_U)
                answers.add(ids("ask_kmers"), ids("found_kmers"), ids("ask_tiles"), ids("found_tiles"), np.array(r["found_counts"] or [], np.int64))
                yield _row(_step(params, r["block"], walk, state["ids"], answers))

    return run


class Routed:
    """Both spectra in buckets, and the supersteps of a table of reads.

    ``report``: of the last run, a row for each superstep: reads under way before it, identifiers asked for
    (each once a block), and bytes of identifiers and block numbers that were dealt out for them.
    """

    def __init__(self, kmers: DataFrame, tiles: DataFrame, params, shared: str | None = None, buckets: int | None = None):
        self.spark, self.params = kmers.sparkSession, params
        shared = shared or self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("supersteps need a folder that driver and executors share: spark.checkpoint.dir")
        self.folder = f"{shared.rstrip('/')}/helixframe/routed-{uuid.uuid4().hex}"
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"hf_{uuid.uuid4().hex}"
        self.stored = {c: StoredSpectrum(self.spark, f"{name}_{c}", c, buckets) for c in ("kmer_id", "tile_id")}
        for c, df in (("kmer_id", kmers), ("tile_id", tiles)):
            self.stored[c].merge(df)
        self.report: list[dict] = []

    def close(self) -> None:
        for s in self.stored.values():
            s.drop()

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _delete(self, names: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(conf).delete(path, True)

    def _found(self, now: DataFrame, ask: str, column: str) -> DataFrame:
        """(block, ids, counts) of the identifiers that a block has asked for and the spectrum holds."""
        asked = now.select("block", F.explode(ask).alias("x"))
        hit = self.stored[column].lookup(asked, "x").where("found IS NOT NULL")
        return hit.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("x", "found"))).alias("f"))

    def correct(self, reads: DataFrame, block: int = BLOCK) -> DataFrame:
        """(read_id, errs) of every read; runs at once and leaves the result in the shared folder."""
        run = uuid.uuid4().hex
        rows = reads.select(F.col("read_id").cast("long").alias("read_id"), "bases", "quals")
        now = self._save(rows.mapInArrow(_begin(self.params, block), _TABLE), f"{run}-0")
        names, self.report = [f"{run}-0"], []
        for n in range(1, MOST_STEPS):
            size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
            living, kmers, tiles = now.agg(F.coalesce(F.sum("living"), F.lit(0)), size("ask_kmers"), size("ask_tiles")).first()
            if not living:
                break
            open_ = now.where("living > 0").select("block", "state", "ask_kmers", "ask_tiles")
            k = self._found(open_, "ask_kmers", "kmer_id").select(F.col("block").alias("b1"), F.col("f.x").alias("found_kmers"))
            t = self._found(open_, "ask_tiles", "tile_id").select(F.col("block").alias("b2"), F.col("f.x").alias("found_tiles"), F.col("f.found").alias("found_counts"))
            both = open_.join(k, F.col("block") == F.col("b1"), "left").join(t, F.col("block") == F.col("b2"), "left").drop("b1", "b2")
            now = self._save(both.mapInArrow(_go_on(self.params), _TABLE), f"{run}-{n}")
            names.append(f"{run}-{n}")
            self.report.append({"superstep": n, "reads": living, "asked_kmers": kmers, "asked_tiles": tiles, "key_bytes": 16 * (kmers + tiles)})
        else:
            raise RuntimeError("reads didn't reach their ends")
        # finished reads are spread over the tables of all supersteps; one read skips the states
        done = self.spark.read.schema(now.select("ids", "errs").schema).parquet(*[f"{self.folder}/{n}" for n in names])
        pairs = done.select(F.explode(F.arrays_zip("ids", "errs")).alias("r")).select(F.col("r.ids").alias("read_id"), F.col("r.errs").alias("errs"))
        out = self._save(pairs, f"{run}-errors")
        self._delete(names)
        return out
