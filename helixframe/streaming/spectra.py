"""Spectra over a stream of reads, and correction of a stream against fixed spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correct
from ..operators.spectrum import SATURATED
from ..operators.windows import window_ids


def fastq_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(read_id, bases, quals) of files that arrive in a folder; a file is one row, so files should be moderate.

    A record that is cut off at the end of its file or has an empty line is an error; empty
    lines at the end are passed over.
    """
    files = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path, wholetext=True)
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    # lines after the last whole record
    rest = F.filter(F.slice("l", F.floor(F.size("l") / 4).cast("int") * 4 + 1, 4), lambda x: x != "")
    whole = F.when(F.size(rest) > 0, F.raise_error(F.lit("a record is cut off")).cast("array<string>")).otherwise(F.col("l"))
    placed = files.select(lines.alias("l")).select(whole.alias("l")).select("l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 4) / 4).cast("int"))).alias("i")).where("size(l) >= 4")
    at = lambda k: F.get("l", F.col("i") * 4 + k)
    ident = F.regexp_extract(at(0), r"^@?(\d{1,18})", 1)
    blank = [at(i) == "" for i in range(4)]
    odd = (blank[0] | blank[1] | blank[2] | blank[3]) & ~(blank[0] & blank[1] & blank[2] & blank[3])
    placed = placed.withColumn("l", F.when(odd, F.raise_error(F.lit("a record is cut off or has an empty line")).cast("array<string>")).otherwise(F.col("l")))
    return placed.select(F.when(ident != "", ident).cast("long").alias("read_id"), at(1).alias("bases"), at(3).alias("quals")).where("length(bases) > 0")


def spectrum_stream(reads: DataFrame, length: int, params=None) -> DataFrame:
    """(id, cnt) over all reads so far, for output mode ``complete`` or ``update``.

    State holds one count an identifier, so it's bounded by the number of distinct windows.
    """
    ids = window_ids(reads, length, params)
    return ids.groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(SATURATED)).cast("int").alias("cnt"))


def spectrum_by_time(reads: DataFrame, time: str, window: str, late: str, length: int, params=None) -> DataFrame:
    """(window, id, cnt): spectra of tumbling windows of an event-time column, with a watermark."""
    dated = reads.withWatermark(time, late).withColumn("__w", F.window(time, window))
    ids = window_ids(dated, length, params, carry=("__w",))
    return ids.groupBy(F.col("__w").alias("window"), "id").agg(F.least(F.count(F.lit(1)), F.lit(SATURATED)).cast("int").alias("cnt"))


def correct_stream(reads: DataFrame, kmers: DataFrame, tiles: DataFrame, params, path: str, checkpoint: str, shared: str | None = None):
    """Starts a query that writes the corrections of each batch of reads under ``path``, each batch once.

    Both spectra are made ready before the first batch and serve all of them; no later
    batch computes anything on them. A batch has a folder of its own, named by its number, and
    overwrites it: a batch that is replayed after a failure leaves no second copy. Reading
    ``path`` gives read_id, errs and batch.
    """
    ready = correct.Corrector(kmers, tiles, params, shared=shared)

    def batch(df: DataFrame, number: int) -> None:
        found = ready.correct(df).where(F.size("errs") > 0)
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
