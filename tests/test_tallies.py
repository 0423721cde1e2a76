"""Windows counted as arrays against those of generated code, and what stays out of their plans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe import metrics
from helixframe.operators import spectrum, tallies, windows
from helixframe.params import Params


def _reads(spark, n=300):
    r = random.Random(5)
    rows = [(0, None, "IIII"), (1, "ACGTACGTACGTACGTAA", None), (2, "", ""), (3, "ACGTACGTACGTACGTACéTACGTACGTACGTACGTACGT", "é" * 40), (4, "ACGTTGCATT" * 4, "#" * 7), (5, "ACGTTGCATT" * 4, "I" * 90)]
    for i in range(6, n):
        m = r.choice((3, 10, 11, 14, 15, 33, 60, 96))
        rows.append((i, "".join(r.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(m)), "".join(chr(r.randint(30, 80)) for _ in range(m))))
    return spark.createDataFrame(rows, "read_id long, bases string, quals string").repartition(3)


@pytest.mark.parametrize("length", [1, 6, 10, 14, 16, 17, 31, 32])
def test_same_windows_as_generated_code(spark, length):
    reads = _reads(spark)
    for p in (None, Params(max_bad=2, quality_threshold=40)):
        want = windows.window_ids(reads, length, p)
        got = tallies.window_table(reads, length, p)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("read_id", "pos", "id").collect()))
        counts = tallies.window_counts(reads, length, p).groupBy("id").agg(F.sum("n"))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.groupBy("id").count().collect()))


def test_chunks_and_copies_add_up(spark, monkeypatch):
    monkeypatch.setattr(tallies, "CHUNK", 7)
    tally, got = tallies.Tally(14), {}
    text = pa.array(["ACGTTGCATTGACCATG" * 3] * 5)
    for _ in range(3):
        for ids, n in tally.add(tallies.windows_of(text, None, 14)[0]):
            for i, c in zip(ids.tolist(), n.tolist()):
                got[i] = got.get(i, 0) + c
    for ids, n in tally.rest():
        for i, c in zip(ids.tolist(), n.tolist()):
            got[i] = got.get(i, 0) + c
    ids = tallies.windows_of(text, None, 14)[0].tolist()
    assert got == {i: 3 * ids.count(i) for i in set(ids)}


def test_spectra_deal_out_counts_not_windows(spark):
    """A copied read doesn't make more rows to be dealt out: before, each window was a row of the plan."""
    one = spark.createDataFrame([(0, "ACGTTGCATTGACCATGACCGT", "I" * 22)], "read_id long, bases string, quals string")
    many = spark.range(1000).join(one.drop("read_id")).withColumnRenamed("id", "read_id").coalesce(1)
    assert tallies.window_counts(many, 14).count() == tallies.window_counts(one, 14).count() == 9
    assert {r.cnt for r in spectrum.spectrum(many, 14).collect()} == {255}
    plan = spectrum.spectrum(many, 14)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan


def test_lookups_count_copies(spark):
    reads, p = _reads(spark), Params(k=10, step=4, min_count=2)
    kmers, tiles = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
    got = {r.kind: (r.lookups, r.misses) for r in metrics.lookup_counters(reads, kmers, tiles, p).collect()}
    for kind, length, table in (("kmer", p.k, kmers), ("tile", p.tile, tiles)):
        ids, known = [r.id for r in windows.window_ids(reads, length).collect()], {r[0] for r in table.collect()}
        assert got[kind] == (len(ids), sum(i not in known for i in ids))
