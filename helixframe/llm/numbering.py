"""Gapless numbers inside groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that each group's hash space is cut into. A piece is numbered by one task and
#: holds 1 / PIECES of its group's rows; piece sums make a table of groups x PIECES rows.
PIECES = 4096


def piece_of(order: Column, pieces: int = PIECES) -> Column:
    """Piece of a row; rows come by piece, then by order."""
    return F.pmod(F.shiftright(order, 40), F.lit(pieces)).cast("int")


def running_totals(rows: DataFrame, group: list[str], order: Column, weight: str, ties: list[str], pieces: int = PIECES) -> DataFrame:
    """Adds ``before``: the total ``weight`` of the group's rows that come earlier.

    Rows come by ``piece_of(order)``, ``order`` (a well-mixed 64-bit hash) and ``ties``. Rows equal
    in all of these should be merged into one of larger weight first. Group columns hold
    no nulls.
    """
    spread = rows.withColumn("__o", order).withColumn("__p", piece_of(F.col("__o"), pieces))
    sums = spread.groupBy(*group, "__p").agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*group).orderBy("__p")
    base = sums.select(*group, "__p", (F.sum("__w").over(w) - F.col("__w")).alias("__base"))
    # the window and the join share one partitioning
    own = Window.partitionBy(*group, "__p").orderBy("__o", *ties).rowsBetween(Window.unboundedPreceding, 0)
    numbered = spread.withColumn("__in", F.sum(weight).over(own) - F.col(weight))
    out = numbered.join(base, [*group, "__p"])
    return out.withColumn("before", F.col("__base") + F.col("__in")).drop("__o", "__p", "__in", "__base")
