"""Spectra: distinct windows with saturating counts, and what derives from them.

Tasks count the windows of their reads as arrays; one aggregation adds up what they found by identifier.
A count is min(255, occurrences), which doesn't depend on how rows are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tallies import window_totals

SATURATED = 255


def spectrum(reads: DataFrame, length: int, min_count: int = 0, params=None, name: str = "id") -> DataFrame:
    """(id, cnt) of all windows; params asks for good quality as well."""
    counts = window_totals(reads, length, params).select(F.col("id").alias(name), F.least("n", F.lit(SATURATED)).cast("int").alias("cnt"))
    return counts.where(F.col("cnt") >= min_count) if min_count else counts


def kmer_spectrum(reads: DataFrame, params) -> DataFrame:
    return spectrum(reads, params.k, params.min_count, name="kmer_id")


def tile_spectrum(reads: DataFrame, params, quality: bool = True) -> DataFrame:
    return spectrum(reads, params.tile, params.min_count, params if quality else None, "tile_id")


def merge(parts: DataFrame, name: str) -> DataFrame:
    """One spectrum of several (unionAll), counts added up to saturation."""
    return parts.groupBy(name).agg(F.least(F.sum("cnt"), F.lit(SATURATED)).cast("int").alias("cnt"))


def absent(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer_id, cnt 0) of all identifiers of k bases that the spectrum lacks."""
    every = kmers.sparkSession.range(0, 1 << (2 * k)).withColumnRenamed("id", "kmer_id")
    return every.join(kmers.select("kmer_id"), "kmer_id", "left_anti").select("kmer_id", F.lit(0).alias("cnt"))


def stored_form(kmers: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """The spectrum, or its complement if more than half of all identifiers occur."""
    dense = kmers.count() > 1 << (2 * k - 1)
    return (absent(kmers, k), True) if dense else (kmers, False)


def histogram(counts: DataFrame) -> DataFrame:
    """(cnt, n) for every count from 0 to 255."""
    every = counts.sparkSession.range(256).select(F.col("id").cast("int").alias("cnt"))
    have = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    return every.join(have, "cnt", "left").select("cnt", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histograms(reads: DataFrame, params) -> DataFrame:
    """Both tile histograms, without and with the quality condition, thresholds left out.

    One pass over the windows counts both; a tile without a good window is in the first only.
    """
    seen, top = window_totals(reads, params.tile, params, quality=False), F.lit(SATURATED)
    counts = seen.select(F.least("n", top).cast("int").alias("all"), F.least("good", top).cast("int").alias("quality"))
    both = counts.groupBy("all", "quality").agg(F.count(F.lit(1)).alias("n"))
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("cnt")) for s in ("all", "quality")])
    have = both.select("n", F.inline(sections)).where("section = 'all' OR cnt > 0").groupBy("section", "cnt").agg(F.sum("n").alias("n"))
    every = reads.sparkSession.range(256).select(F.col("id").cast("int").alias("cnt"), F.explode(F.array(F.lit("all"), F.lit("quality"))).alias("section"))
    return every.join(have, ["section", "cnt"], "left").select("section", "cnt", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(counts: DataFrame, name: str, pieces: int = 1024, length: int | None = None) -> DataFrame:
    """Adds ``rank``, from 1 in the order of identifiers, without one task seeing them all.

    Identifiers below 2^62 are cut into equal ranges; ranks inside a range add to the running size
    of the ranges before. With ``length``, the bases of an identifier, ranges follow from its
    first bits; else from the greatest identifier, which is another pass.
    """
    if length is not None:
        cut = counts.withColumn("__p", F.shiftright(F.col(name), max(0, 2 * length - (pieces - 1).bit_length())).cast("int"))
    else:
        top = counts.agg(F.max(name).alias("top"))
        cut = counts.join(F.broadcast(top)).withColumn("__p", F.floor(F.col(name) / (F.col("top") + 1) * pieces).cast("int")).drop("top")
    sizes = cut.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__n")).alias("__b"))
    own = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(name)))
    return own.join(before, "__p").withColumn("rank", (F.col("__b") + F.col("__r")).cast("long")).drop("__p", "__r", "__b")


def preceding(counts: DataFrame, name: str, length: int, pieces: int = 1024) -> DataFrame:
    """Adds ``before``, the next smaller of distinct identifiers below 2^62; null for the smallest.

    Identifiers are cut into ranges by their first bits; the first of a range follows the last of the range before.
    """
    cut = counts.withColumn("__p", F.shiftright(F.col(name), max(0, 2 * length - (pieces - 1).bit_length())).cast("int"))
    tops = cut.groupBy("__p").agg(F.max(name).alias("__t"))
    last = tops.select("__p", F.lag("__t").over(Window.partitionBy(F.lit(0)).orderBy("__p")).alias("__t"))
    own = cut.withColumn("before", F.lag(name).over(Window.partitionBy("__p").orderBy(name)))
    return own.join(last, "__p").withColumn("before", F.coalesce("before", "__t")).drop("__p", "__t")


def summary(reads: DataFrame, params) -> DataFrame:
    """(metric, value): reads, windows, spectrum sizes, and absent k-mers if stored that way."""
    total = 1 << (2 * params.k)

    def sizes(length, windows, distinct, p=None):
        """Windows and distinct ones at or above the threshold, both from one count."""
        both = window_totals(reads, length, p).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(windows), F.count_if(F.least("n", F.lit(SATURATED)) >= params.min_count).alias(distinct))
        n = F.col(distinct)
        more = {"absent_kmers": F.when(n * 2 > total, F.lit(total) - n).otherwise(F.lit(0)).cast("long")} if p is None else {}
        rows = [F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in {windows: F.col(windows), distinct: n, **more}.items()]
        return both.select(F.inline(F.array(*rows)))

    read = reads.agg(F.count(F.lit(1)).alias("value")).select(F.lit("reads").alias("metric"), "value")
    return read.unionAll(sizes(params.k, "kmer_windows", "kmers")).unionAll(sizes(params.tile, "tile_windows", "tiles", params))
