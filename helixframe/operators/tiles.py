"""Tiles of two overlapping k-mers: candidates, lookups, merging of strands, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def overlaps(head: Column, tail: Column, k: int, step: int) -> Column:
    """Whether the last k - step bases of head are the first of tail."""
    if step >= k:
        return F.lit(True)
    shared = F.lit((1 << (2 * (k - step))) - 1).cast("long")
    return head.bitwiseAND(shared) == F.shiftrightunsigned(tail, 2 * step)


def tile_key(head: Column, tail: Column, step: int) -> Column:
    new = F.lit((1 << (2 * step)) - 1).cast("long")
    return F.shiftleft(head, 2 * step).bitwiseOR(tail.bitwiseAND(new))


def candidates(heads: DataFrame, tails: DataFrame, keys: list[str], k: int, step: int) -> DataFrame:
    """Tiles of all overlapping (head, tail) of one key: an equi-join on key and overlap.

    heads: keys, head, head_rank; tails: keys, tail, tail_rank. The pair of ranks 0 is
    the tile as read.
    """
    shared = F.lit((1 << (2 * max(k - step, 0))) - 1).cast("long")
    h = heads.withColumn("__o", F.col("head").bitwiseAND(shared) if step < k else F.lit(0).cast("long"))
    t = tails.withColumn("__o", F.shiftrightunsigned("tail", 2 * step) if step < k else F.lit(0).cast("long"))
    both = h.join(t, [*keys, "__o"]).drop("__o")
    return both.withColumn("tile_id", tile_key(F.col("head"), F.col("tail"), step))


def with_counts(tiles: DataFrame, spectrum: DataFrame, own: Column) -> DataFrame:
    """Adds good_cnt: rows found in the tile spectrum, and rows where ``own`` holds with 0."""
    s = spectrum.select(F.col("tile_id").alias("__t"), F.col("cnt").alias("__c"))
    got = tiles.join(s, F.col("tile_id") == F.col("__t"), "left")
    return got.where(F.col("__c").isNotNull() | own).withColumn("good_cnt", F.coalesce("__c", F.lit(0))).drop("__t", "__c")


def merge_strands(forward: DataFrame, reverse: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Counts of both strands by tile, reverse tiles turned round; sums don't saturate."""
    turned = reverse.withColumn("tile_id", codec.revcomp_id(F.col("tile_id"), length))
    both = forward.select(*keys, "tile_id", "good_cnt").unionAll(turned.select(*keys, "tile_id", "good_cnt"))
    return both.groupBy(*keys, "tile_id").agg(F.sum("good_cnt").cast("long").alias("good_cnt"))


def touches_low(own: Column, other: Column, quals: Column, length: int, low: int) -> Column:
    """Whether a base in which the tiles differ has a quality below ``low``."""
    return F.exists(codec.differences(other, own, length), lambda e: F.ascii(F.substr(quals, e["pos"] + 1, F.lit(1))) < low)


def decide(tiles: DataFrame, keys: list[str], params) -> DataFrame:
    """One row a key: (verdict, chosen) for tiles with good_cnt, own (the tile as read) and quals.

    Verdicts: trusted, only-tile, unchanged, corrected, rejected. ``chosen`` is the tile to
    use, null if rejected.
    """
    low, t = params.low_quality, params.min_count
    own = F.max(F.when(F.col("is_own"), F.struct("tile_id", "good_cnt", "quals")))
    base = tiles.groupBy(*keys).agg(own.alias("o"))
    others = tiles.where(~F.col("is_own") & (F.col("good_cnt") >= t)).join(base, keys)
    floor_ = F.floor(F.col("o.good_cnt") / F.lit(params.ratio))
    high = F.col("good_cnt") >= floor_
    alt = high & touches_low(F.col("o.tile_id"), F.col("tile_id"), F.col("o.quals"), params.tile, low)
    found = others.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cand"), F.count_if(alt).alias("n_alt"),
        F.max(F.when(alt, F.col("tile_id"))).alias("alt"), F.max("tile_id").alias("cand"),
    )
    count = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tiles"))
    all_ = base.join(count, keys).join(found, keys, "left").na.fill(0, ["n_cand", "n_alt"])
    g0, good = F.col("o.good_cnt"), codec.low_quality_count(F.col("o.quals"), low) == 0
    verdict = (
        F.when(g0 >= params.trusted_count, "trusted")
        .when(F.col("n_tiles") == 1, F.when((g0 >= t) & good, "only-tile").otherwise("rejected"))
        .when(g0 >= t, F.when(F.col("n_alt") == 0, "unchanged").when(F.col("n_alt") == 1, "corrected").otherwise("rejected"))
        .otherwise(F.when(F.col("n_cand") == 1, "corrected").otherwise("rejected"))
    )
    out = all_.withColumn("verdict", verdict)
    pick = F.when(F.col("verdict") == "rejected", F.lit(None)).when(F.col("verdict") == "corrected", F.when(g0 >= t, F.col("alt")).otherwise(F.col("cand"))).otherwise(F.col("o.tile_id"))
    return out.select(*keys, "verdict", pick.alias("chosen"))
