"""Estimates of what delta coding of sorted identifiers would take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from .spectrum import ranked


def node_bytes(counts: DataFrame, name: str, node: int, length: int | None = None) -> DataFrame:
    """(node, rows, bytes): bytes of each run of ``node`` identifiers in order.

    The first is stored whole, the second as its distance from the first, the others as
    their distances from the second, each in the fewest bytes.
    """
    placed = ranked(counts, name, length=length).withColumn("node", F.floor((F.col("rank") - 1) / node).cast("long"))
    w = Window.partitionBy("node").orderBy(name)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(w)
    near = F.when(at == 1, F.col(name)).when(at == 2, F.col(name) - F.first(name).over(whole)).otherwise(F.col(name) - F.nth_value(name, 2).over(whole))
    each = placed.select("node", codec.bytes_needed(near).alias("b"))
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum("b").cast("long").alias("bytes"))


def node_summary(counts: DataFrame, name: str, node: int, length: int | None = None) -> DataFrame:
    """One row: mean, least and greatest bytes of a node."""
    return node_bytes(counts, name, node, length).agg(F.avg("bytes").alias("mean"), F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))


#: Steps in the span of all identifiers up to which references are looked up one by one.
FEW_STEPS = 64
#: Ranges that one task strings together at each level of the tree.
FAN = 16
_RANGE = "piece long, at binary, refs binary, last binary"


class Chain:
    """What a sorted range of identifiers makes of the last reference before it: a step function.

    Its value changes where the first identifier that may be a reference does. ``at[i]`` is the
    largest first allowed identifier (last reference + step) of stretch ``i``, ``refs[i]`` the references
    that the range then has, ``last[i]`` the last of them. Beyond the last stretch there are none.
    Neighbouring stretches of equal values are one, so chains that run together are kept once.
    """

    def __init__(self, at: np.ndarray, refs: np.ndarray, last: np.ndarray):
        same = np.zeros(len(at), bool)
        same[:-1] = (refs[1:] == refs[:-1]) & (last[1:] == last[:-1])
        self.at, self.refs, self.last = at[~same], refs[~same], last[~same]

    @classmethod
    def of(cls, ids: np.ndarray, step: int) -> "Chain":
        n = len(ids)
        jump = _place(ids, ids, step)
        count, last = np.ones(n, np.int64), np.arange(n)
        # doubling: where a chain that starts at each identifier ends in this range
        while (live := np.flatnonzero(jump < n)).size:
            to = jump[live]
            more, end, far = count[to], last[to], jump[to]
            count[live] += more
            last[live] = end
            jump[live] = far
        return cls(ids, count, ids[last])

    def then(self, other: "Chain", step: int) -> "Chain":
        """This range followed by another one."""
        i = _place(other.at, self.last, step)
        hit = i < len(other.at)
        j = np.minimum(i, max(len(other.at) - 1, 0))
        refs = self.refs + np.where(hit, other.refs[j], 0) if len(other.at) else self.refs
        last = np.where(hit, other.last[j], self.last) if len(other.at) else self.last
        return Chain(np.concatenate((self.at, other.at)), np.concatenate((refs, other.refs)), np.concatenate((last, other.last)))

    def bounded(self, step: int) -> "Chain":
        """Without stretches that no reference before the range can reach."""
        n = int(_place(self.at, self.at[:1], step)[0]) + 1 if len(self.at) else 0
        return Chain(self.at[:n], self.refs[:n], self.last[:n])


def _place(ids: np.ndarray, last: np.ndarray, step: int) -> np.ndarray:
    """Place in sorted ``ids`` of the first one that lies ``step`` or more above each of ``last``, without overflow."""
    top = (1 << 63) - 1
    far = last > top - step
    return np.where(far, len(ids), np.searchsorted(ids, np.where(far, 0, last) + step, "left"))


def _batch(piece: int, c: Chain) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece]), *(pa.array([x.tobytes()], pa.binary()) for x in (c.at, c.refs, c.last))], names=["piece", "at", "refs", "last"])


def _leaves(step: int):
    def run(batches):
        from pyspark import TaskContext

        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if sum(map(len, got)):
            yield _batch(TaskContext.get().partitionId(), Chain.of(np.concatenate(got), step).bounded(step))

    return run


def _strung(step: int):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["piece"])
        whole = None
        for r in rows:
            c = Chain(*(np.frombuffer(r[x], np.int64) for x in ("at", "refs", "last")))
            whole = c if whole is None else whole.then(c, step).bounded(step)
        return pa.Table.from_batches([_batch(rows[0]["piece"] // FAN, whole)])

    return run


def _one_by_one(ids: DataFrame, ref: int | None, step: int) -> int:
    """References for few of them: each is the least identifier a step above the one before.

    Each question has a bound from below, so a stored spectrum's statistics pass over the rest.
    """
    refs = 0
    while ref is not None:
        refs += 1
        ref = ids.where(F.col("id") >= ref + step).agg(F.min("id")).first()[0] if ref + step < 1 << 63 else None
    return refs


def restarts(counts: DataFrame, name: str, width: int) -> tuple[int, int]:
    """(references, deltas) if identifiers below 2^63 are coded against the last reference in ``width`` bytes.

    Whether an identifier is a new reference depends on the one before. Each range of
    identifiers becomes a step function of the last reference before it, with a stretch for
    each identifier within one step of its first at most; functions of neighbouring ranges are
    composed, FAN at a time, in a tree of tasks. One row reaches the driver. Where the whole span
    is FEW_STEPS steps at most, so that a step may hold all rows, there are as few references,
    and they are looked up one after another.
    """
    spark, step = counts.sparkSession, 1 << (8 * width)
    ids = counts.select(F.col(name).cast("long").alias("id"))
    low, high, rows = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if low is None:
        return 0, 0
    if (high - low) // step < FEW_STEPS:
        refs = _one_by_one(ids, low, step)
        return refs, rows - refs
    tree = ids.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_leaves(step), _RANGE)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    while parts > 1:
        tree = tree.groupBy(F.floor(F.col("piece") / FAN).alias("up")).applyInArrow(_strung(step), _RANGE)
        parts = -(-parts // FAN)
    # the first range of all is entered at its first identifier
    top = tree.select(F.expr("substring(refs, 1, 8)").alias("refs")).collect()
    refs = int(np.frombuffer(bytes(top[0].refs), np.int64)[0])
    return refs, rows - refs


def restart_table(counts: DataFrame, name: str, widths) -> DataFrame:
    """(width, references, deltas) for each width in bytes."""
    got = [(w, *restarts(counts, name, w)) for w in widths]
    return counts.sparkSession.createDataFrame(got, "width int, references long, deltas long")
