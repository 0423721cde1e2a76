"""Hamming neighbours of identifiers, membership in a spectrum, and joins of near identifiers."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def unit_neighbors(ids: DataFrame, column: str, k: int, lowest: int = 0) -> DataFrame:
    """Rows of ``ids`` with ``neighbor``: each identifier with one base changed.

    Bit positions from ``lowest`` (0: the last base) to k - 1 are varied; each neighbour
    comes once for an input row, the identifier itself never.
    """
    if lowest >= k:
        return ids.withColumn("neighbor", F.lit(None).cast("long")).where(F.lit(False))
    places = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(x).alias("x")) for p in range(lowest, k) for x in (1, 2, 3)])
    # adding 1 to 3 to a base by exclusive or gives the three others
    flip = F.call_function("shiftleft", F.col("__at.x").cast("long"), F.col("__at.p") * 2)
    return ids.withColumn("__at", F.explode(places)).withColumn("neighbor", F.col(column).bitwiseXOR(flip)).drop("__at")


def present(rows: DataFrame, column: str, kmers: DataFrame) -> DataFrame:
    """Rows whose identifier occurs in the spectrum."""
    keys = kmers.select(F.col("kmer_id").alias("__k"))
    return rows.join(keys, F.col(column) == F.col("__k"), "left_semi")


def missing(rows: DataFrame, column: str, kmers: DataFrame) -> DataFrame:
    """Rows whose identifier does not occur; with a complement as spectrum, those that do."""
    keys = kmers.select(F.col("kmer_id").alias("__k"))
    return rows.join(keys, F.col(column) == F.col("__k"), "left_anti")


def valid_neighbors(ids: DataFrame, column: str, kmers: DataFrame, k: int, lowest: int = 0) -> DataFrame:
    """Neighbours that the spectrum holds; identifier 0 is never taken."""
    return present(unit_neighbors(ids, column, k, lowest).where("neighbor <> 0"), "neighbor", kmers)


def mismatches(x: Column) -> Column:
    """Bases in which two identifiers differ, from their exclusive or."""
    pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    return F.bit_count(pairs)


def one_mismatch(x: Column) -> Column:
    """Whether an exclusive or of two identifiers differs in exactly one base."""
    return mismatches(x) == 1


def hamming1_pairs(ids: DataFrame, column: str, k: int) -> DataFrame:
    """(a, b), a < b: identifiers of the spectrum one base apart.

    Each identifier asks for its larger neighbours, 3k at most, by an equi-join: linear in
    the spectrum, however many identifiers share a half.
    """
    near = unit_neighbors(ids.select(F.col(column).alias("a")), "a", k).withColumnRenamed("neighbor", "b").where("a < b")
    return near.join(ids.select(F.col(column).alias("b")), "b", "left_semi").select("a", "b")


#: Identifiers that share a masked key up to which they are paired; more are masked again.
CROWD = 256
#: Rows of a counted table of keys up to which it is broadcast.
BROADCAST_KEYS = 1_000_000


def chunk_masks(places: list[int], chunks: int, distance: int) -> list[tuple[int, tuple[int, ...]]]:
    """(mask, open places) for every choice of chunks that two identifiers at ``distance`` must share.

    Bases at ``places`` (0: the last) are cut into ``chunks`` runs; whichever ``distance`` of them hold the
    mismatches, the others agree. A mask has both bits of each base in the agreeing chunks.
    """
    n = len(places)
    cut = [places[i * n // chunks:(i + 1) * n // chunks] for i in range(chunks)]
    out = []
    for open_ in combinations(range(chunks), distance):
        free = tuple(p for c in open_ for p in cut[c])
        out.append((sum(3 << 2 * p for p in places if p not in free), free))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(ids: DataFrame, masks: list[int]) -> DataFrame:
    """Rows of (id, m, key): each identifier under every mask."""
    each = F.array(*[F.struct(F.lit(i).alias("m"), F.col("id").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key")) for i, x in enumerate(masks)])
    return ids.select("id", F.explode(each).alias("e")).select("id", "e.m", "e.key")


def _first_mask(x: Column, masks: list[int]) -> Column:
    """Number of the first mask under which an exclusive or vanishes."""
    return F.coalesce(*[F.when(x.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])


def _met(rows: DataFrame, by: list[str], masks: list[int], distance: int) -> DataFrame:
    """Pairs of one key within the distance, each under the first of its masks only."""
    other = rows.select(F.col("id").alias("other"), *by)
    x = F.col("id").bitwiseXOR(F.col("other"))
    # identifiers of 32 bases use the sign bit, so they are compared as unsigned numbers
    ahead = codec.unsigned_order(F.col("id")) < codec.unsigned_order(F.col("other"))
    once = F.col("m") == _first_mask(x, masks)
    return rows.join(other, by).where(ahead & (mismatches(x) <= distance) & once)


def hamming_pairs(ids: DataFrame, column: str, k: int, distance: int, chunks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b as unsigned numbers: distinct identifiers of k bases that differ in 1 to ``distance`` of them.

    Two such identifiers agree in all but ``distance`` of ``chunks`` runs of bases, so they meet under
    the mask of one choice of runs: an equi-join on the masked identifier, an exclusive or to
    verify, and a pair is given under its first mask only. More chunks make more masks and
    shorter lists of identifiers a mask; by default two more than the distance.

    A key with more than ``crowd`` identifiers isn't paired: its members differ in the open bases
    alone, and are masked again with every choice of ``distance`` of these, which leaves
    4^distance identifiers a key at most. Null identifiers take no part, repeated ones count once.
    """
    if distance < 1 or k < 1:
        return ids.select(F.col(column).cast("long").alias("a"), F.col(column).cast("long").alias("b")).where(F.lit(False))
    distance = min(distance, k)
    chunks = min(max(chunks or distance + 2, distance), k)
    rows = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id")).distinct()
    choice = chunk_masks(list(range(k)), chunks, distance)
    masks = [m for m, _ in choice]
    met = _masked(rows, masks)
    many = met.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("m", "key")
    n = many.count()
    if not n:
        return _met(met, ["m", "key"], masks, distance).select(F.col("id").alias("a"), F.col("other").alias("b"))
    crowded = F.broadcast(many) if n <= BROADCAST_KEYS else many
    few = _met(met.join(crowded, ["m", "key"], "left_anti"), ["m", "key"], masks, distance).select("id", "other")
    hot = met.join(crowded, ["m", "key"], "left_semi")
    finer = []
    for i, (mask, free) in enumerate(choice):
        inner = [mask | f for f, _ in chunk_masks(list(free), len(free), min(distance, len(free)))]
        each = F.array(*[F.struct(F.lit(j).alias("j"), F.col("id").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("part")) for j, x in enumerate(inner)])
        finer.append((each, inner))
    choose = reduce(lambda acc, i: acc.when(F.col("m") == i, finer[i][0]), range(1, len(finer)), F.when(F.col("m") == 0, finer[0][0]))
    parted = hot.select("id", "m", F.explode(choose).alias("e")).select("id", "m", "e.j", "e.part")
    other = parted.select(F.col("id").alias("other"), "m", "j", "part")
    x = F.col("id").bitwiseXOR(F.col("other"))
    ahead = codec.unsigned_order(F.col("id")) < codec.unsigned_order(F.col("other"))
    first = reduce(lambda acc, i: acc.when(F.col("m") == i, _first_mask(x, finer[i][1])), range(1, len(finer)), F.when(F.col("m") == 0, _first_mask(x, finer[0][1])))
    some = parted.join(other, ["m", "j", "part"]).where(ahead & (F.col("m") == _first_mask(x, masks)) & (F.col("j") == first) & (mismatches(x) <= distance)).select("id", "other")
    return few.unionAll(some).select(F.col("id").alias("a"), F.col("other").alias("b"))


#: Neighbours of an identifier up to which all of them are looked up, and identifiers that are looked up at a time.
FLIPS, AT_ONCE = 4096, 1024


def _flips(k: int, distance: int) -> np.ndarray:
    """Exclusive ors that change 1 to ``distance`` of k bases."""
    out = [sum(x << 2 * p for p, x in zip(places, change)) for d in range(1, distance + 1) for places in combinations(range(k), d) for change in product((1, 2, 3), repeat=d)]
    return np.array(out, np.int64)


def near_pairs(ids: DataFrame, column: str, k: int, distance: int, shared: str | None = None) -> DataFrame:
    """(a, b) as of ``hamming_pairs``, by lookups where a table of all identifiers fits into the workers.

    Each identifier asks the table for its neighbours, so the work is in proportion to identifiers and pairs, however many
    share a masked key. The table lies in the shared folder in pieces, which are also what is dealt out.
    Longer identifiers, or a greater distance, are joined by masks.
    """
    from . import correct

    spark = ids.sparkSession
    shared = shared or spark.conf.get("spark.checkpoint.dir", None)
    flips = _flips(k, distance) if shared and 0 < distance <= min(k, 2) and k <= correct.TABLE_BASES else np.zeros(0, np.int64)
    if not 0 < len(flips) <= FLIPS:
        return hamming_pairs(ids, column, k, distance)
    path = f"{shared.rstrip('/')}/helixframe/near-{uuid.uuid4().hex}"
    correct._pieces(column, F.lit(1), ids.where(F.col(column).isNotNull()), k, path)

    def run(batches):
        table = correct._worker_lookup(path, lambda: correct._table(path, k))
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1)):
                marks = np.frombuffer(counts.as_buffer(), np.uint8)
                own = np.flatnonzero(marks) + piece * len(marks)
                for i in range(0, len(own), AT_ONCE):
                    a = own[i:i + AT_ONCE, None]
                    near = a ^ flips
                    row, at = np.nonzero((near > a) & (table[near] > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(a[row, 0]), pa.array(near[row, at])], names=["a", "b"])

    pieces = spark.read.schema("piece long, counts binary").parquet(path)
    return pieces.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "a long, b long")
