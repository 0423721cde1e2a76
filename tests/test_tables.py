"""Correction with spectra above the broadcast's rows: tables of all identifiers instead of supersteps."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import correct, spectrum
from helixframe.params import Params


def _reads(spark):
    r = random.Random(9)
    text = "".join(r.choice("ACGT") for _ in range(400))
    rows = []
    for i in range(400):
        at = r.randrange(340)
        b, q = list(text[at:at + 60]), ["I"] * 60
        for _ in range(r.choice((0, 0, 1, 2))):
            j = r.randrange(60)
            b[j], q[j] = r.choice("ACGTN"), "#"
        rows.append((i, "".join(b), "".join(q)))
    return spark.createDataFrame(rows, "read_id long, bases string, quals string").repartition(3)


@pytest.mark.parametrize("k,step,rounds", [(8, 4, 1), (6, 3, 2)])
def test_tables_give_what_arrays_give(spark, k, step, rounds):
    reads, p = _reads(spark), Params(k=k, step=step, max_distance=rounds)
    kmers, tiles = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
    rows = lambda c: sorted(map(str, c.correct(reads).collect()))
    small, large = correct.Corrector(kmers, tiles, p), correct.Corrector(kmers, tiles, p, broadcast_rows=0)
    assert small.sent is not None
    # before, spectra of more rows than the broadcast's always went by supersteps
    assert large.folder is not None and large.routed is None
    want = rows(small)
    assert rows(large) == want and any("pos=" in r for r in want)
    small.close()
    large.close()


def test_what_tables_cannot_hold_goes_by_supersteps(spark):
    reads, p = _reads(spark).limit(20), Params(k=8, step=4)
    kmers, tiles = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
    for some, bases in ((tiles.withColumn("cnt", F.col("cnt") + 255), correct.TABLE_BASES), (tiles, 11)):
        ready = correct.Corrector(kmers, some, p, broadcast_rows=0, table_bases=bases)
        assert ready.routed is not None and ready.folder is None
        ready.close()
