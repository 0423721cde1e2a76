"""Vector code compression: each vector as one short code for each of its parts.

Vectors, as integers, are cut into equal parts; every part position has a codebook, found by
rounds of nearest-entry assignment and replacement by means. Assignment is exact, ties to the
lower index, and mostly needs no distance: each part of each vector keeps, for every entry
``j``, the distance ``b`` measured last and the round ``t`` of that measurement. All codebooks
since the start are kept, so a later bound is ``b`` less the length of entry ``j``'s net
displacement between rounds ``t`` and now. The norm of the sum of the moves is at most the sum
of their norms, and far less where entries move to and fro. The same holds from above for the
entry a part is assigned to. Only where the bounds leave a doubt are distances measured: first
to the entry assigned, then to those entries that still can be as near.

All arithmetic decides on integers: distances are rounded down and displacements up, so a
bound never claims too much, and squared distances are exact.

The state (codes, bounds, stamps: 41 bytes a part) lies beside the vectors in a table in the
shared folder; a round reads one such table and writes the next, and the one before goes. Sums
for the means are formed in each task and added up by Spark.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Largest distance that a bound holds. A bound at this value says "at least so far".
FAR = 65535
#: Vectors that are worked on together.
TOGETHER = 2048
#: Components up to this size have squared distances within 64 bits for up to 2^18 components;
#: rows with larger ones are worked out in Python's integers.
PLAIN = 1 << 21
#: Distinct labels up to which their counted table is broadcast, else dealt out with salts.
BROADCAST_LABELS, SALTS = 100_000, 64


@dataclass(frozen=True)
class CodeParams:
    """parts: equal pieces of a vector; entries: of a codebook, 256 at most; rounds of replacement; scale: of components."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def usable(vector: Column) -> Column:
    """Vectors without null and non-finite components; a null vector isn't usable."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array()), bad)


# distances ------------------------------------------------------------------------------------
def _isqrt(d: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down; exact for int64 and for Python's integers."""
    if d.dtype == object:
        from math import isqrt

        return np.array([isqrt(x) for x in d.ravel().tolist()], object).reshape(d.shape)
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    r += (r + 1) * (r + 1) <= d
    return r


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = x - y
    return (d * d).sum(-1)


def _drift(history: list[np.ndarray]) -> np.ndarray:
    """(round, entry): length of each entry's net displacement from a round to the last one, rounded up."""
    now = history[-1]
    d = np.array([_squared(now, old) for old in history])
    return np.minimum(_isqrt(d) + (d > 0), 2 * FAR).astype(np.int64)


class Assigner:
    """Nearest entries of one part position, round by round. history: its codebooks (entry, component) up to now."""

    def __init__(self, history: list[np.ndarray]):
        self.now, self.round, self.drift = history[-1], len(history) - 1, _drift(history)
        self.index = np.arange(len(self.now))
        self.measured = 0

    def first(self, x: np.ndarray):
        """(code, squared distance, bounds, stamps) with everything measured."""
        d = np.stack([_squared(x, e) for e in self.now], 1)
        self.measured += d.size
        code = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64).reshape(len(d))
        bound = np.minimum(_isqrt(d), FAR).astype(np.int64)
        return code, bound, np.full(bound.shape, self.round, np.int64)

    def again(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        """The same from an earlier round's state; arrays of bounds and stamps change in place."""
        moved = self.drift[stamp, self.index]
        low = bound - moved
        rows = np.arange(len(x))
        own = bound[rows, code]
        # a bound of FAR has no upper side
        high = np.where(own >= FAR, np.iinfo(np.int64).max, own + 1 + moved[rows, code])
        low[rows, code] = np.iinfo(np.int64).max
        doubt = np.flatnonzero(low.min(1) <= high)
        if not len(doubt):
            return code
        best = _squared(x[doubt], self.now[code[doubt]])
        self.measured += len(doubt)
        root = _isqrt(best)
        self._keep(bound, stamp, doubt, code[doubt], root)
        # entries that can still be as near, each measured once; root + 1 is above the distance
        r, j = np.nonzero(low[doubt] <= (root + 1)[:, None])
        if len(r):
            d = _squared(x[doubt[r]], self.now[j])
            self.measured += len(r)
            self._keep(bound, stamp, doubt[r], j, _isqrt(d))
            pick = code.copy()
            for e in range(len(self.now)):  # ascending, so the lower index wins a tie
                at = np.flatnonzero(j == e)
                rr, dd = r[at], d[at]
                better = (dd < best[rr]) | ((dd == best[rr]) & (e < pick[doubt[rr]]))
                rr, dd = rr[better], dd[better]
                best[rr], pick[doubt[rr]] = dd, e
            code = pick
        return code

    def _keep(self, bound, stamp, rows, entries, roots):
        bound[rows, entries] = np.minimum(roots, FAR).astype(np.int64)
        stamp[rows, entries] = self.round


# state ------------------------------------------------------------------------------------------
def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component x as a double, rows by components.

    int64 where all fit PLAIN, else Python's integers: a double of any size is exact there.
    """
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if not len(flat) or np.abs(flat).max() <= PLAIN:
        return flat.astype(np.int64).reshape(-1, width)
    return np.array([int(x) for x in flat.tolist()], object).reshape(-1, width)


def _books(history: list, part: int) -> list[np.ndarray]:
    """Codebooks of one part position, one a round, in the smallest kind of number that is exact."""
    big = any(abs(x) > PLAIN for book in history for e in book[part] for x in e)
    return [np.array(book[part], object if big else np.int64) for book in history]


def _unpacked(blob: pa.Array, n: int, p: CodeParams, entries: int):
    """(codes, bounds, stamps) of packed states, parts first."""
    each = p.parts * (1 + 3 * entries)
    raw = np.frombuffer(b"".join(blob.to_pylist()), np.uint8).reshape(n, p.parts, -1) if n else np.zeros((0, p.parts, each // p.parts), np.uint8)
    code = raw[:, :, 0].astype(np.int64)
    bound = raw[:, :, 1:1 + 2 * entries].copy().view("<u2").astype(np.int64)
    return code, bound, raw[:, :, 1 + 2 * entries:].astype(np.int64)


def _packed(code, bound, stamp) -> list[bytes]:
    n, parts, entries = bound.shape
    raw = np.empty((n, parts, 1 + 3 * entries), np.uint8)
    raw[:, :, 0], raw[:, :, 1 + 2 * entries:] = code, stamp
    raw[:, :, 1:1 + 2 * entries] = bound.astype("<u2").view(np.uint8).reshape(n, parts, -1)
    return [r.tobytes() for r in raw.reshape(n, -1)]


def _assign(history: list, p: CodeParams, width: int, last: bool):
    """One round over (id columns, v, state): new states, or with ``last`` codes and errors."""
    entries, step = len(history[-1][0]), width // p.parts

    def run(batches):
        makers = [Assigner(_books(history, i)) for i in range(p.parts)]
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                yield _assign_piece(b.slice(at, TOGETHER), makers, p, width, step, entries, last)

    return run


def _assign_piece(b: pa.RecordBatch, makers, p, width, step, entries, last):
    n, v = b.num_rows, b.column(b.schema.get_field_index("v"))
    x = _matrix(v, width, p.scale)
    state = b.column(b.schema.get_field_index("state")) if "state" in b.schema.names else None
    code, bound, stamp = _unpacked(state, n, p, entries) if state is not None else (np.zeros((n, p.parts), np.int64), np.zeros((n, p.parts, entries), np.int64), np.zeros((n, p.parts, entries), np.int64))
    error = np.zeros(n, object if x.dtype == object or any(m.now.dtype == object for m in makers) else np.int64)
    for i, m in enumerate(makers):
        mine = x[:, i * step:(i + 1) * step]
        if state is None:
            code[:, i], bound[:, i], stamp[:, i] = m.first(mine)
        else:
            code[:, i] = m.again(mine, code[:, i].copy(), bound[:, i], stamp[:, i])
        if last:
            error = error + _squared(mine, m.now[code[:, i]])
    keep = [f.name for f in b.schema if f.name not in ("v", "state")] if last else [f.name for f in b.schema if f.name != "state"]
    cols = [b.column(b.schema.get_field_index(c)) for c in keep]
    if last:
        text = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
        most = max(error.tolist(), default=0)
        if most >= 1 << 63:
            raise OverflowError(f"an error of {most} is beyond 64 bits")
        return pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64())], names=[*keep, "code", "error"])
    return pa.RecordBatch.from_arrays([*cols, pa.array(_packed(code, bound, stamp), pa.binary())], names=[*keep, "state"])


def _sums(p: CodeParams, width: int, entries: int):
    """(part, entry, place, total, n) of each task: one row for each number of each entry at most."""
    step = width // p.parts

    def run(batches):
        total = np.zeros((p.parts, entries, step), object)
        count = np.zeros((p.parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column(0), width, p.scale)
            code, _, _ = _unpacked(b.column(1), b.num_rows, p, entries)
            for i in range(p.parts):
                mine = x[:, i * step:(i + 1) * step]
                for e in np.unique(code[:, i]).tolist():
                    rows = code[:, i] == e
                    total[i, e] += mine[rows].sum(0).astype(object)
                    count[i, e] += int(rows.sum())
        part, entry = np.nonzero(count)
        if len(part):
            from decimal import Decimal

            each = total[part, entry]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part, step).astype(np.int32)), pa.array(np.repeat(entry, step).astype(np.int32)), pa.array(np.tile(np.arange(step), len(part)).astype(np.int32)),
                pa.array([Decimal(x) for x in each.ravel().tolist()], pa.decimal128(38, 0)), pa.array(np.repeat(count[part, entry], step)),
            ], names=["part", "entry", "place", "total", "n"])

    return run


def _replaced(state: DataFrame, book: list, p: CodeParams, width: int) -> list:
    """The next codebooks: means rounded down, entries without parts as they were. As many numbers as a codebook has reach the driver."""
    sums = state.select("v", "state").mapInArrow(_sums(p, width, len(book[0])), "part int, entry int, place int, total decimal(38,0), n long")
    new = [[list(e) for e in part] for part in book]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r.part][r.entry][r.place] = int(r.total) // r.n
    return new


def fit(vectors: DataFrame, p: CodeParams, scratch: Scratch) -> tuple[DataFrame | None, list, int]:
    """(rows with their last state, codebooks of all rounds, vector length) of ``vectors`` (vec_id, v, more), v floating.

    The length is that of the first vector by vec_id; only vectors of this length are coded.
    Without vectors, or where it isn't a positive multiple of ``parts``, the table is None.
    """
    order = F.struct("vec_id", F.col("v"))
    named = vectors.where("vec_id IS NOT NULL").select("vec_id", "v")
    lead = named.orderBy(order).select("v").first()
    width = len(lead.v) if lead else 0
    if not width or width % p.parts:
        return None, [], width
    rows = vectors.where(F.size("v") == width)
    # repeated rows of one vec_id and vector start one entry
    start = [[floor(float(x) * p.scale) for x in r.v] for r in named.where(F.size("v") == width).distinct().orderBy(order).limit(p.entries).collect()]
    step = width // p.parts
    history = [[[v[i * step:(i + 1) * step] for v in start] for i in range(p.parts)]]
    state, old = rows, None
    for _ in range(p.rounds):
        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", state binary"
        state = scratch.save(state.mapInArrow(_assign(list(history), p, width, False), schema), "round")
        if old is not None:
            scratch.drop(old)
        old = state
        history.append(_replaced(state, history[-1], p, width))
    return state, history, width


def codebook_digest(book: list) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, label: str | None = "label", p: CodeParams = CodeParams()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label).

    Rows whose embedding is null or holds null or non-finite components are left out. A
    codebook starts with the vectors of the smallest vec_ids, equal rows once, ties by components; fewer vectors
    than entries make it smaller. Rows of a null vec_id are coded and start none. Vectors whose length differs from the
    first one's, or all if that isn't a multiple of the parts, have null codes and errors.
    Labels are compared as they are, nulls are one label; without ``label`` all rows are one.
    Repeated rows stay; an empty table gives an empty result. Other columns are left out,
    whatever their names. Components of any
    finite size are exact, as long as sums of one component have 38 digits at most and errors
    64 bits; anything beyond fails.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vcodes")
    tag = F.col(label).cast("string") if label else F.lit(None).cast("string")
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), tag.alias("label"), v.alias("v"))
    state, history, width = fit(rows, p, scratch)
    digest = codebook_digest(history[-1]) if history else codebook_digest([])
    schema = "vec_id long, label string, code string, error long"
    uncoded = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if state is None:
        coded = uncoded
    else:
        coded = scratch.save(state.mapInArrow(_assign(history, p, width, True), schema), "codes")
        coded = coded.unionAll(uncoded.where(F.size(rows["v"]) != width))
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l")
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l")))
    else:
        salted = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = dealt.join(salted, F.col("label").eqNullSafe(F.col("l")) & (dealt["s"] == salted["s"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
