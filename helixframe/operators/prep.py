"""Preparation of reads: reads with ambiguous bases dropped, kept or repaired, and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AMBIGUOUS = "[^ACGTacgt]"


def balanced(rows: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Rows dealt out by hash of ``key`` where they come in fewer pieces than there are task slots.

    Small inputs often come in one file or row group; what follows expands each read many
    times. A large input has pieces enough and isn't moved.
    """
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * tasks, key) if rows.rdd.getNumPartitions() < tasks else rows


def clean_only(reads: DataFrame) -> DataFrame:
    """Reads without an ambiguous base."""
    return reads.where(~F.col("bases").rlike(_AMBIGUOUS))


def renumber(reads: DataFrame, order: str = "read_id", pieces: int = 4096) -> DataFrame:
    """read_id from 0 without gaps in the order of the present one.

    Ids are cut into ranges of equal width; numbers inside a range add to the sizes of the
    ranges before, so no task sees all reads. Equal ids go by bases and qualities.
    """
    top = reads.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    share = (F.col(order) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
    cut = reads.join(F.broadcast(top)).withColumn("__p", F.floor(share * pieces).cast("int")).drop("__lo", "__hi")
    sizes = cut.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__n")).alias("__b"))
    own = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order, "bases", "quals")) - 1)
    return own.join(before, "__p").withColumn("read_id", (F.col("__b") + F.col("__r")).cast("long")).drop("__p", "__r", "__b")


def repair(bases: Column, width: int, most: int, by: str) -> Column:
    """Bases with lone ambiguous ones replaced by ``by``.

    An ambiguous base stays if it is one of ``most`` + 1 consecutive ambiguous bases whose
    distance is at most ``width``; read from positions p0 < p1 < ... of a read: the i-th stays
    if for some j with j <= i <= j + most, p[j + most] - p[j] <= width.
    """
    spots = F.filter(F.sequence(F.lit(1), F.length(bases)), lambda i: F.substr(bases, i, F.lit(1)).rlike(_AMBIGUOUS))

    def fixed(p: Column) -> Column:
        n = F.size(p)

        def dense(i: Column) -> Column:
            runs = F.sequence(F.lit(0), F.lit(most))
            return F.exists(runs, lambda d: (i - d >= 0) & (i - d + most < n) & (F.get(p, i - d + most) - F.get(p, i - d) <= width))

        change = F.filter(F.transform(p, lambda x, i: F.when(~F.coalesce(dense(i), F.lit(False)), x)), lambda x: x.isNotNull())
        one = lambda acc, x: F.concat(F.substr(acc, F.lit(1), x - 1), F.lit(by), F.substr(acc, x + 1))
        return F.aggregate(change, bases, one)

    return F.when(bases.rlike(_AMBIGUOUS), F.transform(F.array(spots), fixed)[0]).otherwise(bases)


def ambiguous_replaced(reads: DataFrame, width: int, most: int, by: str) -> DataFrame:
    return reads.withColumn("bases", repair(F.col("bases"), width, most, by))
