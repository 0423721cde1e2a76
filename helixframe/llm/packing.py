"""Packing into optimal length buckets.

The histogram of token lengths over all documents is one aggregation. Dynamic programming
over it picks the bucket boundaries that need the least padding. Every length has its own
place: d distinct lengths need d * d / 2 tokens at least, so 2e13 tokens have 6.4 million
places of 16 bytes at most, and far fewer in texts that people write. In each bucket
documents form batches of at most the token budget, padding counted; a document longer than
the budget is a batch of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .mixing import token_count
from .numbering import running_totals


@dataclass(frozen=True)
class PackParams:
    buckets: int = 16
    batch_tokens: int = 65_536
    seed: int = 11


def boundaries(tops, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    tops, counts: distinct lengths in ascending order and their documents. A bucket pads to
    its greatest length. The cost of a bucket meets the quadrangle inequality, so the best
    starts of a layer ascend: each level of halving finds the middle places of all its
    ranges in one pass over at most twice as many candidates as there are lengths.
    """
    m = len(tops)
    if not m:
        return []
    top = np.asarray(tops, np.float64)
    n = np.concatenate(([0], np.cumsum(np.asarray(counts, np.float64))))
    best = top * n[1:]  # one bucket for places 0..j; tokens are constant and left out
    choice = [np.zeros(m, np.int32)]
    for _ in range(1, min(buckets, m)):
        before, new, pick = np.concatenate(([0.0], best)), np.empty(m), np.zeros(m, np.int32)
        lo, hi, a, b = (np.array([x]) for x in (0, m - 1, 0, m - 1))
        while lo.size:
            mid = (lo + hi) // 2
            # the last bucket starts at place i, a <= i <= min(mid, b); i = 0: one bucket
            sizes = np.minimum(mid, b) - a + 1
            begin = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) + np.repeat(a - begin, sizes)
            cost = before[i] + np.repeat(top[mid], sizes) * (np.repeat(n[mid + 1], sizes) - n[i])
            least = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero(cost == np.repeat(least, sizes))
            k = i[at[np.searchsorted(at, begin)]]
            new[mid], pick[mid] = least, k
            left, right = lo < mid, mid < hi
            lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (a[left], k[right]), (k[left], b[right])))
        best = new
        choice.append(pick)
    out, j = [], m - 1
    for pick in reversed(choice):
        out.append(int(tops[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, params: PackParams = PackParams(), length: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, boundary, batch, slot, padding.

    batch counts from 0 in each bucket and slot from 0 in each batch. Documents go by a
    seeded hash of doc_id and text; equal ones are neighbours. Null or blank texts have
    length 0 and a bucket like others. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    size = token_count(F.col("text")) if length is None else length.cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), size.alias("n_tokens"))
    rows = scratch.save(rows.groupBy("doc_id", "th", "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    hist = rows.groupBy("n_tokens").agg(F.sum("copies").alias("n")).orderBy("n_tokens").toArrow()
    bounds = boundaries(hist["n_tokens"].to_numpy(), hist["n"].to_numpy(), params.buckets)
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(known, lambda b: b < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket).withColumn("boundary", F.get(known, F.col("bucket")))
    run = running_totals(placed, ["bucket"], F.xxhash64(F.lit(params.seed), "doc_id", "th"), "copies", ["doc_id", "th", "n_tokens"])
    per = F.greatest(F.lit(1), F.floor(F.lit(params.batch_tokens) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    each = run.withColumn("at", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1))).withColumn("per", per)
    return each.select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "boundary", F.floor(F.col("at") / F.col("per")).cast("long").alias("batch"), (F.col("at") % F.col("per")).alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))
