"""FASTQ and FASTA tables, read with Spark's own text reader from any file system it knows.

Lines get their number in the file from the splits: rows of a split keep their order, and
the line counts of earlier splits of a file add up to a split's first line. So a file of
any size is read by as many tasks as it has splits, each line exactly once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READS = "read_id long, bases string, quals string"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def numbered_lines(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """(file, line, value): line numbers from 0 in each file; ``ends`` separates lines, or any line end."""
    lines = spark.read.text(path, lineSep=ends).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")
    )
    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("split")
    sizes = sizes.withColumn("before", F.sum("n").over(w) - F.col("n")).select("file", "split", "first", "before")
    return lines.join(sizes, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(read_id, bases, quals): four lines a record, trimmed; the id is the header's integer.

    A record with an empty line is an error; one of empty lines only, as at the end of a
    file, is passed over. Without strict the first of either ends its file, and records from
    there on are left out. Headers that aren't integers give a null id.
    """
    lines = numbered_lines(spark, path).withColumn("value", _strip(F.col("value")))
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("rec")).agg(
        at(0).alias("head"), at(1).alias("bases"), at(2).alias("plus"), at(3).alias("quals")
    )
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("head", "bases", "plus", "quals")]
    blank = reduce(or_, empty)
    if strict:
        records = records.where(~reduce(and_, empty))
        records = records.withColumn("bases", F.when(blank, F.raise_error(F.concat(F.lit("blank line in record "), F.col("rec")))).otherwise(F.col("bases")))
    else:
        ends = records.where(blank).groupBy("file").agg(F.min("rec").alias("end"))
        records = records.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("rec") < F.col("end")))
    ident = F.try_to_number(F.regexp_extract("head", r"^@?(\d{1,18})", 1), F.lit("999999999999999999")).cast("long")
    return records.select(ident.alias("read_id"), "bases", "quals")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header, seq): ``>`` starts a record, ``;`` lines are comments, sequences
    may span lines. Text before the first header is left out.

    A line feed before ``>`` separates records for the text reader, so a file is cut into
    records by as many tasks as it has splits, and only a record must fit into a row.
    """
    records = numbered_lines(spark, path, "\n>")
    headed = F.startswith("value", F.lit(">"))
    first = F.col("line") == 0
    # a file that begins with other text has one piece too many
    late = records.where(first & ~headed).select("file", F.lit(1).alias("late"))
    lines = F.split(F.when(first, F.substring("value", 2, (1 << 31) - 1)).otherwise(F.col("value")), "\r\n|\r|\n")
    body = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: ~F.startswith(x, F.lit(";")))
    kept = records.where(~first | headed).select("file", "line", lines.alias("lines")).join(late, "file", "left")
    ord_ = F.col("line") - F.coalesce("late", F.lit(0))
    return kept.select("file", ord_.alias("ord"), F.get("lines", F.lit(0)).alias("header"), F.array_join(body, "").alias("seq"))


def join_quality(fasta: DataFrame, quality: DataFrame) -> DataFrame:
    """Reads from a sequence table and a quality table (ord, header, seq), by record number.

    The first character of a quality line is dropped when it is one longer than the bases.
    """
    q = quality.select("ord", F.col("seq").alias("q"))
    both = fasta.select("ord", F.col("header"), F.col("seq").alias("bases")).join(q, "ord")
    quals = F.when(F.length("q") == F.length("bases") + 1, F.substring("q", 2, 1 << 30)).otherwise(F.col("q"))
    return both.select(F.col("ord").cast("long").alias("read_id"), "bases", quals.alias("quals"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """(value): reads as FASTQ records of four lines."""
    return reads.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "bases", F.lit("\n+\n"), "quals").alias("value"))


def fasta_lines(records: DataFrame, width: int = 79) -> DataFrame:
    """(value): records (header, seq) with sequences wrapped at ``width`` columns."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def slice_reads(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Reads with ids from start to end - 1."""
    return reads.where((F.col("read_id") >= start) & (F.col("read_id") < end))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of input files; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")
