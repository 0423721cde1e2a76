"""Spectra that grow batch by batch, stored in buckets of their identifier.

A stored spectrum is a table of (id, cnt) in ``buckets`` buckets, sorted by identifier. What comes
to it, a batch to be merged or identifiers to be looked up, is dealt out to these buckets;
the stored side is read bucket by bucket and never moves. Counts saturate at 255, and
min(255, min(255, x) + min(255, y)) is min(255, x + y), so batches may come in any order and
any number and the result is that of one run over all reads. Thresholds are applied on reading.

Each merge writes a new generation beside the old one and marks it as finished when it is whole,
so a merge that fails midway leaves the stored spectrum as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectrum import SATURATED


class StoredSpectrum:
    """Spectrum ``name`` (``database.name`` or ``name``) of the column ``column`` and cnt.

    Generation n is the managed table ``name_gn``, in the folder of its database or in the
    warehouse. It holds once its property ``helixframe.finished`` is set.
    """

    def __init__(self, spark: SparkSession, name: str, column: str, buckets: int = 64):
        if not re.fullmatch(r"(\w+\.)?\w+", name):
            raise ValueError(f"not a table name: {name}")
        self.spark, self.name, self.column, self.buckets = spark, name, column, buckets

    # generations ------------------------------------------------------------------------------
    def _generations(self) -> list[int]:
        database, _, base = self.name.rpartition(".")
        within = f" IN {database}" if database else ""
        found = [re.fullmatch(re.escape(base) + r"_g(\d+)", r.tableName, re.I) for r in self.spark.sql(f"SHOW TABLES{within}").collect()]
        return sorted(int(m[1]) for m in found if m)

    def _finished(self, generation: int) -> bool:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}_g{generation}").collect()
        return any(r.key == "helixframe.finished" for r in rows)

    def generation(self) -> int | None:
        """The last finished generation; None if nothing is stored."""
        return next((g for g in reversed(self._generations()) if self._finished(g)), None)

    def exists(self) -> bool:
        return self.generation() is not None

    def _write(self, rows: DataFrame, generation: int) -> None:
        table = f"{self.name}_g{generation}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        out = rows.select(self.column, "cnt").write.format("parquet").bucketBy(self.buckets, self.column).sortBy(self.column)
        out.mode("overwrite").saveAsTable(table)
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('helixframe.finished' = 'true')")
        for old in self._generations():
            if old < generation:
                self.spark.sql(f"DROP TABLE {self.name}_g{old}")

    # contents -----------------------------------------------------------------------------------
    def table(self, min_count: int = 0) -> DataFrame:
        """(id, cnt) of the present generation, counts below the threshold left out."""
        now = self.generation()
        if now is None:
            raise ValueError(f"nothing is stored as {self.name}")
        rows = self.spark.table(f"{self.name}_g{now}")
        return rows.where(F.col("cnt") >= min_count) if min_count else rows

    def merged(self, batch: DataFrame) -> DataFrame:
        """The stored counts and those of a batch spectrum together; only the batch is dealt out."""
        new = batch.groupBy(self.column).agg(F.sum("cnt").alias("new")).withColumnRenamed(self.column, "__id")
        both = self.table().join(new, F.col(self.column) == F.col("__id"), "full")
        total = F.coalesce("cnt", F.lit(0)) + F.coalesce("new", F.lit(0))
        return both.select(F.coalesce(self.column, "__id").alias(self.column), F.least(total, F.lit(SATURATED)).cast("int").alias("cnt"))

    def merge(self, batch: DataFrame) -> "StoredSpectrum":
        """Adds a batch's spectrum (without a threshold); the first one is stored as it is."""
        now = self.generation()
        if now is None:
            first = batch.groupBy(self.column).agg(F.least(F.sum("cnt"), F.lit(SATURATED)).cast("int").alias("cnt"))
            self._write(first.repartition(self.buckets, self.column), 0)
        else:
            self._write(self.merged(batch), now + 1)
        return self

    def merge_all(self, batches: Iterable[DataFrame]) -> "StoredSpectrum":
        for batch in batches:
            self.merge(batch)
        return self

    def lookup(self, rows: DataFrame, key: str, min_count: int = 0) -> DataFrame:
        """``rows`` with ``found``, the stored count of their identifier, null where there is none."""
        stored = self.table(min_count).select(F.col(self.column).alias("__id"), F.col("cnt").alias("found"))
        return rows.join(stored.hint("merge"), F.col(key) == F.col("__id"), "left").drop("__id")

    def drop(self) -> None:
        for g in self._generations():
            self.spark.sql(f"DROP TABLE {self.name}_g{g}")
