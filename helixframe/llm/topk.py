"""Exact inner-product top-k by norm-bucketed retrieval.

Candidates are grouped by length into buckets of a quarter octave and packed in blocks.
A block of the longest vectors gives each query a lower bound, its k-th best score there.
For a query q with bound b and a bucket of greatest length l, a candidate can only qualify
with a cosine of at least ``b / (|q| l)``, the local threshold. Above 1 the bucket is
skipped. From COORDINATE_FROM on the bucket is pruned by coordinates: those in which q is
largest confine the candidate's normalised coordinate to an interval. Below it is pruned by
length: only vectors of length ``b / |q|`` or more remain. What remains is verified by
exact integer products.

A block of queries meets a block of candidates only if the longest of these can reach the
bound of one query; that is decided on block numbers, before any vector moves. Every pair of
blocks left moves the queries once, so candidate blocks are large and components are kept in
the narrowest integers that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a candidate block and of a query block at most, and components of a block.
BLOCK, QUERY_BLOCK, VALUES = 32768, 1024, 1 << 21
#: Candidates that are multiplied at a time, and parts that the list of block pairs is cut into.
AT_ONCE, LISTS = 4096, 64
#: Dimensions up to which each one's block of the longest vectors is broadcast (16 MB each at most).
SMALL_DIMS = 8
#: Local threshold from which coordinates prune, and how many coordinates.
COORDINATE_FROM, FOCUS = 0.6, 4
_PER_OCTAVE = 4


def usable(vec: Column) -> Column:
    """Not null, and all components finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vec: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


def _length() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _pack(t: pa.Table) -> pa.Table:
    ids = t["vec_id"].to_numpy()
    flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    mat = flat.reshape(len(ids), -1) if len(flat) else np.zeros((len(ids), 0), np.int64)
    size = np.sqrt((mat.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -size))
    key = [t[c][0].as_py() for c in t.column_names[:3]]
    most = max(-int(mat.min(initial=0)) - 1, int(mat.max(initial=0)))
    narrow = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    out = {"dim": [key[0]], "bucket": [key[1]], "part": [key[2]], "ids": [ids[order].tobytes()], "mat": [mat[order].astype(narrow).tobytes()], "longest": [float(size.max())]}
    return pa.table(out, schema=_BLOCK)


_BLOCK = pa.schema([("dim", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary()), ("longest", pa.float64())])
_BLOCK_DDL = "dim int, bucket int, part int, ids binary, mat binary, longest double"


def blocks(vectors: DataFrame, rows: int, by_length: bool) -> DataFrame:
    """Vectors (vec_id, v) packed in blocks of about ``rows`` of one dimension and length bucket.

    Fewer rows where components are many, or where there would be fewer blocks than task
    slots and rows enough to share out.
    """
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    bucket = F.floor(_PER_OCTAVE * F.log2(_length() + 1)).cast("int") if by_length else F.lit(0)
    keyed = vectors.withColumn("dim", F.size("v")).withColumn("bucket", bucket)
    counts = keyed.groupBy(F.col("dim").alias("d"), F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    fit = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(VALUES) / F.greatest("d", F.lit(1)))))
    parts = F.greatest(F.ceil(F.col("n") / fit), F.least(F.lit(slots), F.ceil(F.col("n") / min(rows, 1024))))
    counts = counts.select("d", "b", parts.cast("long").alias("parts"))
    # at most 4 * 64 length buckets a dimension: joined without dealing rows out by bucket
    dealt = keyed.join(F.broadcast(counts), (keyed["dim"] == counts["d"]) & (keyed["bucket"] == counts["b"]))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    dealt = dealt.select("dim", "bucket", part.alias("part"), "vec_id", "v")
    return dealt.groupBy("dim", "bucket", "part").applyInArrow(_pack, _BLOCK_DDL)


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """A block's vectors; their bytes tell the width of a component."""
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dim)] if n and dim else np.int64
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.int64)


#: Ends of 64 bits: scores beyond them are held at these.
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; by floating point where that is exact.

    Pairs whose lengths could lead out of 64 bits are multiplied in Python's integers; products
    that do lead out are held at the ends.
    """
    length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    la, lb = length(a), length(b)
    top = la.max(initial=0) * lb.max(initial=0)  # bounds every partial sum
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = a @ b.T
    if top >= 2.0**63:
        rows = np.flatnonzero(la * lb.max() >= 2.0**63)
        cols = np.flatnonzero(lb * la.max() >= 2.0**63)
        for i in rows.tolist():
            near = cols[la[i] * lb[cols] >= 2.0**63]
            exact = b[near].astype(object) @ a[i].astype(object)
            out[i, near] = [min(max(x, _LOW), _HIGH) for x in exact.tolist()]
    return out


def _best(ids, score, own, k):
    """The k best (score, id) of each query: highest score, then smallest id, own row left out."""
    for i in range(len(own)):
        s, c = score[i], ids
        use = c != own[i]
        s, c = s[use], c[use]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            near = s >= least
            s, c = s[near], c[near]
        order = np.lexsort((c, -s))[:k]
        yield s[order], c[order]


_BOUND_DDL = "q_dim int, q_part int, bound binary, need double"


def _bounds(k):
    """Each query's k-th best score in one block, and the least length that reaches one of these bounds."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["q_ids"], np.int64)
                ids, dim = np.frombuffer(r["ids"], np.int64), r["q_dim"]
                q, p = _matrix(r["q_mat"], len(own), dim), _matrix(r["mat"], len(ids), dim)
                bound = np.full(len(own), -np.inf)
                for at in range(0, len(own), 128):  # a few queries against the whole block at a time
                    part = slice(at, at + 128)
                    bound[part] = [float(s[-1]) if len(s) == k else -np.inf for s, _ in _best(ids, _products(q[part], p), own[part], k)]
                size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where((bound > 0) & (size > 0), bound / np.maximum(size, 1e-300) * (1 - 1e-9), 0.0).min()
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r["q_part"]], pa.int32()), pa.array([bound.tobytes()], pa.binary()), pa.array([float(need)])], names=["q_dim", "q_part", "bound", "need"])

    return run


def _search(k):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own, ids, dim = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64), r["q_dim"]
                q, p = _matrix(r["q_mat"], len(own), dim), _matrix(r["mat"], len(ids), dim)
                bound = np.frombuffer(r["bound"], np.float64)
                for at in range(0, len(ids), AT_ONCE):
                    out = retrieve(own, q, bound, ids[at:at + AT_ONCE], p[at:at + AT_ONCE], k)
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

    return run


def retrieve(own, q, bound, ids, p, k):
    """Candidates of one block, longest first, that may be among each query's k best."""
    size = np.sqrt((p.astype(np.float64) ** 2).sum(1))
    qsize = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    longest = size[0] if len(size) else 0.0
    reach = qsize * longest
    slack = 1e-9 * (1 + reach)
    # local threshold; a bound of 0 or less, or a zero vector, prunes nothing
    local = np.where((bound > 0) & (reach > 0), (bound - slack) / np.maximum(reach, 1e-300), -1.0)
    local = np.where((bound > 0) & (reach == 0), 2.0, local)
    keep_q, keep_c, keep_s = [], [], []

    def take(rows, cand, score):
        for i, (s, c) in zip(rows, _best(ids[cand], score, own[rows], k)):
            keep_q.append(np.full(len(s), own[i]))
            keep_c.append(c)
            keep_s.append(s)

    by_coord = np.flatnonzero((local <= 1) & (local >= COORDINATE_FROM) & (size[-1:] > 0).all())
    if len(by_coord):
        unit = p / size[:, None]
    for i in by_coord:
        u, t = q[i] / qsize[i], min(local[i], 1.0)
        ok = np.ones(len(ids), bool)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
            ok &= np.abs(unit[:, f] - u[f] * t) <= wide + (1 - t) * abs(u[f])
        cand = np.flatnonzero(ok & (size * qsize[i] + slack[i] >= bound[i]))
        if len(cand):
            take(np.array([i]), cand, _products(q[i:i + 1], p[cand]))
    rest = np.setdiff1d(np.flatnonzero(local <= 1), by_coord)
    if len(rest):
        # vectors are sorted by length: each query needs a prefix; one product serves all
        least = np.where(bound[rest] > 0, (bound[rest] - slack[rest]) / np.maximum(qsize[rest], 1e-300), 0.0)
        m = int(np.searchsorted(-size, -least.min(), "right"))
        if m:
            take(rest, np.arange(m), _products(q[rest], p[:m]))
    if not keep_q:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x).astype(np.int64) for x in (keep_q, keep_c, keep_s)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, exactly.

    ``vectors`` and ``queries`` hold vec_id and v, an array of integers without nulls.
    Only vectors of the query's dimension are compared; a query's own vec_id is left out.
    Ties go to the smaller vec_id; a query with fewer candidates gets them all. Repeated
    rows are candidates each. Null identifiers take no part. Components may have any size
    that 64 bits hold; only a score among the results that reaches their ends is an error.
    An empty table gives an empty result; other columns are left out, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    cand = scratch.save(blocks(vectors.where("vec_id is not null").select("vec_id", "v"), BLOCK, True), "candidates")
    asked = blocks(queries.where("vec_id is not null").select("vec_id", "v").distinct(), QUERY_BLOCK, False)
    asked = scratch.save(asked.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "part", "ids", "mat", "longest")]), "queries")
    top = cand.groupBy(F.col("dim").alias("t_dim")).agg(F.max(F.struct("bucket", "part")).alias("t"))
    top = scratch.save(top, "longest")
    seeds = cand.join(F.broadcast(top), (F.col("dim") == F.col("t_dim")) & (F.col("bucket") == F.col("t.bucket")) & (F.col("part") == F.col("t.part"))).drop("t", "t_dim")
    seeds = F.broadcast(seeds) if top.count() <= SMALL_DIMS else seeds
    first = asked.join(seeds.select("dim", "ids", "mat"), F.col("q_dim") == F.col("dim")).repartition("q_dim", "q_part")
    ready = asked.join(scratch.save(first.mapInArrow(_bounds(k), _BOUND_DDL), "bounds"), ["q_dim", "q_part"])
    # block numbers and lengths only; a dimension's list of pairs is cut by the candidate block
    number = F.pmod(F.xxhash64("bucket", "part"), F.lit(LISTS)).cast("int")
    some = ready.select("q_dim", "q_part", "need", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1))).alias("list"))
    other = cand.select(F.col("dim").alias("q_dim"), "bucket", "part", "longest", number.alias("list"))
    pairs = some.join(other, ["q_dim", "list"]).where("longest >= need").select("q_dim", "q_part", "bucket", "part")
    both = pairs.join(ready, ["q_dim", "q_part"]).join(cand.withColumnRenamed("dim", "q_dim"), ["q_dim", "bucket", "part"])
    found = both.select("q_dim", "q_ids", "q_mat", "bound", "ids", "mat").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    beyond = (F.col("score") >= _HIGH) | (F.col("score") <= _LOW)
    score = F.when(beyond, F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
