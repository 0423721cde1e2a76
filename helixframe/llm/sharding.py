"""Rendezvous hashing of record keys over weighted shards, in DataFrame operations only.

A key's score at shard s is ``-w_s / ln(u)`` with u uniform in (0, 1) from a hash of the
key and s; the record goes to the shard of the highest score. A new shard changes no score
of the others: it only takes records of which its own score is the highest, in expectation
its share of all weights, and no record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running_totals


def place(key: Column, weights: Sequence[float]) -> Column:
    """Shard of each key, 0 to len(weights) - 1; a null key has one place like any other key."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be positive for one shard at least and negative for none")
    w = F.array(*[F.lit(float(x)) for x in weights])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s), 11).cast("double") + 0.5) * (2.0**-53)
        return F.struct((-F.element_at(w, s + 1) / F.log(u)).alias("score"), (-s).alias("s"))

    live = [i for i, x in enumerate(weights) if x > 0]
    best = F.array_max(F.transform(F.array(*[F.lit(i) for i in live]), score))
    return -best["s"]


def assign(records: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """The records with their shard; nothing is shuffled."""
    return records.withColumn(column, place(F.col(key), weights))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal doc_ids, null included, share a shard whatever their texts. Slots run from 0
    without gaps in each shard, in the order of a hash of the row. Rows equal in doc_id,
    size and checksum are merged before anything is shuffled and get neighbouring slots.
    A null text has size 16 and checksum 0. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    merged = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = merged.withColumn("shard", place(F.col("doc_id"), weights)).withColumn("grown_shard", place(F.col("doc_id"), grown))
    numbered = running_totals(placed, ["shard"], F.xxhash64("doc_id", "size", "text_crc32"), "copies", ["doc_id", "size", "text_crc32"])
    slots = F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard")
