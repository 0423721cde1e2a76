"""Run statistics: phase times and counters as a table."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RunStats:
    """Collects seconds of named phases and values of counters."""

    def __init__(self):
        self.rows: list[tuple[str, str, float]] = []

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append(("seconds", name, time.perf_counter() - began))

    def count(self, name: str, value: float) -> None:
        self.rows.append(("count", name, float(value)))

    def observed(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """The table with its rows counted as it is used, at no extra pass."""
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def table(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value)."""
        return spark.createDataFrame(self.rows, "kind string, name string, value double")


def correction_counters(corrections: DataFrame) -> DataFrame:
    """One row: reads, reads with corrections, corrections."""
    n = F.size("errs")
    return corrections.agg(F.count(F.lit(1)).alias("reads"), F.count_if(n > 0).alias("corrected_reads"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("corrections"))


def spread(by_task: DataFrame) -> DataFrame:
    """(counter, tasks, total, least, mean, greatest) of every column but ``task`` of statistics by task."""
    names = [c for c in by_task.columns if c != "task"]
    each = by_task.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias("x")) for c in names])).alias("e")).select("e.*")
    return each.groupBy("counter").agg(F.count(F.lit(1)).alias("tasks"), F.sum("x").alias("total"), F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("greatest"))


def lookup_counters(reads: DataFrame, kmers: DataFrame, tiles: DataFrame, params) -> DataFrame:
    """(kind, lookups, misses) over all windows of the reads in both spectra."""
    from .operators.tallies import window_counts

    def one(length, table, name, kind):
        # windows meet the spectrum as tasks have counted them
        ids = window_counts(reads, length).withColumnRenamed("id", name)
        hit = ids.join(table.select(name, F.lit(1).alias("hit")), name, "left")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return hit.agg(F.lit(kind).alias("kind"), total("n").alias("lookups"), total(F.when(F.col("hit").isNull(), F.col("n"))).alias("misses"))

    return one(params.k, kmers, "kmer_id", "kmer").unionAll(one(params.tile, tiles, "tile_id", "tile"))


def own_lookup_counters(reads: DataFrame, params) -> DataFrame:
    """``lookup_counters`` of reads in their own spectra, of which a window's count tells whether they have it.

    Each spectrum is one grouping of counted windows, and nothing is joined.
    """
    from .operators.spectrum import SATURATED
    from .operators.tallies import window_totals

    def one(length, p, kind):
        each = window_totals(reads, length, p, quality=p is None, unjudged=True).select("n", F.col("n" if p is None else "good").alias("good"))
        found = (F.col("good") > 0) & (F.least("good", F.lit(SATURATED)) >= params.min_count)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return each.agg(F.lit(kind).alias("kind"), total("n").alias("lookups"), total(F.when(~found, F.col("n"))).alias("misses"))

    return one(params.k, None, "kmer").unionAll(one(params.tile, params, "tile"))
