"""Whole runs: spectra only, correction only, or both; and the histogram run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import correct, spectrum
from ..params import Params
from ..sources import fastq, tables


def spectra(reads: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """k-mer and tile spectrum, persisted: both are read several times later."""
    return spectrum.kmer_spectrum(reads, params).persist(), spectrum.tile_spectrum(reads, params).persist()


def stored_spectra(spark: SparkSession, params: Params) -> tuple[DataFrame, DataFrame]:
    """Spectra of an earlier run; a k-mer complement, told by counts of 0 or by the parameter, is turned back into the present set."""
    kmers = tables.read_spectrum(spark, params.kmer_in)
    if params.kmer_in_absent or not kmers.where("cnt = 0").isEmpty():
        from pyspark.sql import functions as F

        kmers = spectrum.absent(kmers, params.k).withColumn("cnt", F.lit(params.min_count))
    return kmers, tables.read_spectrum(spark, params.tile_in)


def run(spark: SparkSession, params: Params, reads: DataFrame | None = None) -> DataFrame | None:
    """Runs by ``run_type``: 0 both, 1 spectra to files, 2 correction with stored spectra.

    A k-mer spectrum of more than half of all identifiers is written as its complement, with counts of 0.
    Corrections are returned, and written as text if ``output_prefix`` is set.
    """
    params.check()
    reads = fastq.read_fastq_splits(spark, params.input_path) if reads is None else reads
    kmers, tiles = stored_spectra(spark, params) if params.run_type == 2 else spectra(reads, params)
    if params.run_type == 1 or params.write_spectrum and params.run_type == 0:
        # of more than half of all k-mers the absent ones are written
        tables.write_spectrum(spectrum.stored_form(kmers, params.k)[0], params.kmer_out, "kmer_id")
        tables.write_spectrum(tiles, params.tile_out, "tile_id")
    if params.run_type == 1:
        return None
    found = correct.correct(reads, kmers, tiles, params)
    if params.write_output and params.output_prefix:
        tables.write_corrections(found, params.output_prefix)
    return found


def histogram_run(reads: DataFrame, params: Params, path: str | None = None) -> DataFrame:
    """Both tile histograms; written as text with a path."""
    out = spectrum.histograms(reads, params)
    if path:
        lines = tables.histogram_lines(out)
        lines.repartitionByRange(1, "section", "ord").sortWithinPartitions("section", "ord").select("value").write.mode("overwrite").text(path)
    return out
