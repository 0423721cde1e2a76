"""Run logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequences import numbered_lines

# The phases that timing logs name at the start of a line.
PHASES = ("spectrum construction", "error correction", "total")
_RUN_NAME = r"^(.+)h(\d+)r(\d+)w(\d+)t(\d+)"


def parse_run_name(name) -> list:
    """dataset, distance, run, work, threads of a run name like ``d2h1r1w0t16``."""
    part = lambda i: F.regexp_extract(name, _RUN_NAME, i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("int")
    return [F.when(part(1) != "", part(1)).alias("dataset"), number(2).alias("distance"), number(3).alias("run"), number(4).alias("work"), number(5).alias("threads")]


def timings(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, phase, seconds) of the lines that start with a phase's name."""
    lines = numbered_lines(spark, path)
    phase = F.lit(None).cast("string")
    for p in PHASES:
        phase = F.when(F.startswith(F.lower(F.trim("value")), F.lit(p)), F.lit(p)).otherwise(phase)
    seconds = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*$", 1)
    return lines.withColumn("phase", phase).where("phase is not null").select("file", "line", "phase", F.when(seconds != "", seconds).cast("double").alias("seconds"))


def phases(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, nproc, rank, phase, seconds): lines after a ``nproc`` or ``rank`` header belong to it."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
    head = lambda word: F.when(F.regexp_extract("value", rf"^{word}\W*(\d+)", 1) != "", F.regexp_extract("value", rf"^{word}\W*(\d+)", 1)).cast("int")
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("np", head("nproc")).withColumn("rk", head("rank"))
    placed = placed.withColumn("section", F.sum((F.col("np").isNotNull() | F.col("rk").isNotNull()).cast("int")).over(w)).withColumn("nproc", F.last("np", ignorenulls=True).over(w)).withColumn("rank", F.last("rk", ignorenulls=True).over(w))
    name = F.regexp_extract("value", r"^([A-Za-z][A-Za-z _-]*?)\s*[:\t=]\s*[0-9.eE+-]+\s*$", 1)
    seconds = F.regexp_extract("value", r"([0-9.eE+-]+)\s*$", 1)
    body = placed.where(F.col("np").isNull() & F.col("rk").isNull()).withColumn("phase", name).where("phase <> ''")
    return body.select("file", "section", "nproc", "rank", "phase", F.try_to_number(seconds, F.lit("999999999.999999")).cast("double").alias("seconds"))
