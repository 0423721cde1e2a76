"""Spectra and corrections as files: Parquet, and the fixed binary and text layouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Little-endian records of 8 bytes (u32 id, u8 count, 3 unused) for k-mers
# and of 16 bytes (u64 id, u8 count, 7 unused) for tiles.
KMER_RECORD = [("id", "<u4"), ("cnt", "u1"), ("pad", "V3")]
TILE_RECORD = [("id", "<u8"), ("cnt", "u1"), ("pad", "V7")]


def write_spectrum(spectrum: DataFrame, path: str, name: str, parts: int | None = None) -> None:
    """Parquet, range-partitioned and sorted by identifier."""
    spread = spectrum.repartitionByRange(parts, name) if parts else spectrum.repartitionByRange(name)
    spread.sortWithinPartitions(name).write.mode("overwrite").parquet(path)


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Records of one slice of a binary file.
SLICE = 1 << 20


def open_file(uri: str):
    """A file of any file system that Arrow knows, for reading at any place."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    files, inner = fs.FileSystem.from_uri(uri)
    return files.open_input_file(inner)


def _decode(fields, name):
    kind = np.dtype(fields)

    def run(batches):
        for b in batches:
            for path, at, n in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(path) as f:
                    f.seek(at * kind.itemsize)
                    rows = np.frombuffer(f.read(n * kind.itemsize), kind)
                if len(rows) != n:
                    raise ValueError(f"{path} is shorter than it was")
                ids = rows["id"].astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows["cnt"].astype(np.int32))], names=[name, "cnt"])

    return run


def read_binary_spectrum(spark: SparkSession, path: str, tiles: bool) -> DataFrame:
    """(id, cnt) from files of any size in the binary layout, read in slices by many tasks.

    Only names and lengths are listed; bytes after the last whole record are left out.
    """
    name, fields = ("tile_id", TILE_RECORD) if tiles else ("kmer_id", KMER_RECORD)
    width = np.dtype(fields).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / width).alias("n")).where("n > 0")
    slices = files.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("at"))
    slices = slices.select("path", "at", F.least(F.col("n") - F.col("at"), F.lit(SLICE)).alias("n"))
    parts = slices.count()
    return slices.repartition(max(1, parts), "path", "at").mapInArrow(_decode(fields, name), f"{name} long, cnt int")


def encode_binary_spectrum(spectrum: DataFrame, tiles: bool) -> DataFrame:
    """(content): the binary layout of each partition, in the order of identifiers."""
    fields = TILE_RECORD if tiles else KMER_RECORD
    kind = np.dtype(fields)
    name = spectrum.columns[0]

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, kind)
            out["id"] = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out["cnt"] = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["content"])

    return spectrum.repartitionByRange(name).sortWithinPartitions(name).mapInArrow(run, "content binary")


def correction_lines(corrections: DataFrame) -> DataFrame:
    """(value): read id, number of errors, then position, from, to, quality of each, tab-separated."""
    one = lambda e: F.concat_ws("\t", e["pos"], e["from"], e["to"], e["qual"])
    line = F.concat_ws("\t", "read_id", F.size("errs"), F.array_join(F.transform("errs", one), "\t"))
    return corrections.where(F.size("errs") > 0).select("read_id", line.alias("value"))


def write_corrections(corrections: DataFrame, path: str) -> None:
    """Text in the order of read ids, one file a range."""
    correction_lines(corrections).repartitionByRange("read_id").sortWithinPartitions("read_id").select("value").write.mode("overwrite").text(path)


def histogram_lines(histograms: DataFrame) -> DataFrame:
    """(section, ord, value): each section's title, its 256 lines and a blank line."""
    rows = histograms.select("section", F.col("cnt").alias("ord"), F.concat_ws("\t", "cnt", "n").alias("value"))
    ends = histograms.select("section").distinct().select("section", F.explode(F.array(F.struct(F.lit(-1).alias("ord"), F.concat(F.lit("tiles: "), "section").alias("value")), F.struct(F.lit(256).alias("ord"), F.lit("").alias("value")))).alias("e")).select("section", "e.ord", "e.value")
    return rows.unionAll(ends)
