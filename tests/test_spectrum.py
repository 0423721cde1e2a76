import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import delta, neighbors, spectrum
from helixframe.operators.windows import window_ids, windows
from helixframe.params import Params

READS = "read_id long, bases string, quals string"


def reads_of(spark, bases, quals=None):
    return spark.createDataFrame([(i, b, (quals[i] if quals else "I" * len(b))) for i, b in enumerate(bases)], READS)


@pytest.mark.parametrize("bases, expected", [("ACG", []), ("ACGT", [0, 1]), ("NACG", []), ("ACGNACG", [0, 4]), ("NNACGT", [2, 3]), ("acgtN", [0, 1]), ("ACGTNAC", [0, 1]), ("ANACGTA", [2, 3, 4]), ("", []), ("NNNN", [])])
def test_window_starts(spark, bases, expected):
    assert sorted(r.pos for r in windows(reads_of(spark, [bases]), 3).collect()) == expected


def brute(reads, length, params=None):
    out = Counter()
    for b, q in reads:
        b = b.upper()
        ok = [p for p in range(len(b) - length + 1) if set(b[p:p + length]) <= set("ACGT")]
        if any(p < len(b) - length for p in ok):
            for p in ok:
                if params is None or sum(ord(c) < params.quality_threshold for c in q[p:p + length]) <= params.max_bad:
                    out[b[p:p + length]] += 1
    return {w: min(c, 255) for w, c in out.items()}


def number(w):
    return sum("ACGT".index(c) << 2 * (len(w) - 1 - i) for i, c in enumerate(w))


def test_spectra_against_counting_and_partitions(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("ACGTacgtN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    quals = ["".join(chr(rng.randint(33, 73)) for _ in b) for b in bases]
    p = Params(k=4, step=2, quality_threshold=50, max_bad=2)
    reads = reads_of(spark, bases, quals)
    for length, q in ((4, None), (6, p), (6, None)):
        want = {number(w): c for w, c in brute(list(zip(bases, quals)), length, q).items()}
        for parts in (1, 7):
            got = {r.id: r.cnt for r in spectrum.spectrum(reads.repartition(parts), length, params=q).collect()}
            assert got == want
    hist = {r.cnt: r.n for r in spectrum.histogram(spectrum.spectrum(reads, 4)).collect()}
    assert len(hist) == 256 and sum(hist.values()) == len(brute(list(zip(bases, quals)), 4))


def test_saturation_and_thresholds(spark):
    reads = reads_of(spark, ["AAAAAAAA"] * 100 + ["ACGTACGT"])
    assert {r.id: r.cnt for r in spectrum.spectrum(reads, 4).collect()}[0] == 255
    assert spectrum.spectrum(reads, 4, min_count=256).count() == 0
    assert spectrum.spectrum(reads, 4, min_count=0).count() == spectrum.spectrum(reads, 4).count()
    parts = spectrum.spectrum(reads, 4).unionAll(spectrum.spectrum(reads, 4))
    assert {r.id: r.cnt for r in spectrum.merge(parts, "id").collect()}[0] == 255


def test_complement_twice_is_the_same(spark):
    kmers = spectrum.spectrum(reads_of(spark, ["ACGTTGCAACGGTTTACG"]), 3, name="kmer_id")
    twice = spectrum.absent(spectrum.absent(kmers, 3), 3)
    assert {r.kmer_id for r in twice.collect()} == {r.kmer_id for r in kmers.collect()}
    assert not spectrum.stored_form(kmers, 3)[1]


def test_rank_and_nodes(spark):
    kmers = spark.createDataFrame([(x, 1) for x in (0, 5, 300, 70000, 2**30)], "kmer_id long, cnt int")
    assert [(r.kmer_id, r["rank"]) for r in spectrum.ranked(kmers, "kmer_id").orderBy("kmer_id").collect()] == [(0, 1), (5, 2), (300, 3), (70000, 4), (2**30, 5)]
    assert sorted(tuple(r) for r in delta.node_bytes(kmers, "kmer_id", 3).collect()) == [(0, 3, 1 + 1 + 2), (1, 2, 3 + 4)]
    assert delta.node_summary(kmers, "kmer_id", 3).first().mean == 5.5


def test_delta_restarts(spark):
    rng = random.Random(7)
    ids = sorted(rng.sample(range(200_000), 700))
    kmers = spark.createDataFrame([(x, 1) for x in ids], "kmer_id long, cnt int")
    want = []
    for width in (1, 2, 3):
        ref, n = None, 0
        for x in ids:
            if ref is None or x - ref >= 256**width:
                ref, n = x, n + 1
        want.append((width, n, len(ids) - n))
    assert [tuple(r) for r in delta.restart_table(kmers, "kmer_id", (1, 2, 3)).orderBy("width").collect()] == want
    assert delta.restarts(kmers.where("false"), "kmer_id", 1) == (0, 0)


def test_neighbors_and_pairs(spark):
    rng = random.Random(4)
    ids = sorted(rng.sample(range(4**5), 300))
    kmers = spark.createDataFrame([(x, 1) for x in ids], "kmer_id long, cnt int")
    apart = lambda a, b: sum((a ^ b) >> 2 * i & 3 != 0 for i in range(5))
    got = {(r.a, r.b) for r in neighbors.hamming1_pairs(kmers, "kmer_id", 5).collect()}
    assert got == {(a, b) for a in ids for b in ids if a < b and apart(a, b) == 1}
    near = {(r.kmer_id, r.neighbor) for r in neighbors.valid_neighbors(kmers.select("kmer_id"), "kmer_id", kmers, 5).collect()}
    assert near == {(a, b) for a in ids for b in ids if b and apart(a, b) == 1}
    assert neighbors.unit_neighbors(kmers.select("kmer_id"), "kmer_id", 5, 5).count() == 0
    assert neighbors.missing(kmers.select(F.col("kmer_id").alias("x")), "x", kmers).count() == 0


@pytest.mark.parametrize("length", [1, 16, 17, 31, 32])
def test_windows_of_every_length(spark, length):
    """Identifiers and the quality rule against slices of the strings, across the border of the decimal parts."""
    rng = random.Random(length)
    p = Params(k=10, step=4, quality_threshold=60, max_bad=length // 2)
    rows = [(i, "".join(rng.choice("ACGTacgtACGTACGTACGTACGTACGTACGTACGTN" if i % 3 else "ACGT") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows = [(i, b, "".join(chr(rng.randint(33, 126)) for _ in b)) for i, b in rows] + [(90, None, None), (91, "ACGT" * 10, None), (92, "A1.-" * 10, "I" * 40)]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")

    def want(quality):
        out = []
        for i, b, q in rows:
            starts = [s for s in range(len(b or "") - length + 1) if set(b[s:s + length].upper()) <= set("ACGT")]
            if q is None and quality or not any(s < len(b) - length for s in starts):
                continue
            for s in starts:
                if not quality or sum(ord(c) < 60 for c in q[s:s + length]) <= p.max_bad:
                    x = sum("ACGT".index(c) << 2 * (length - 1 - j) for j, c in enumerate(b[s:s + length].upper()))
                    out.append((i, s, x - (1 << 64) if x >> 63 else x))
        return sorted(out)

    assert sorted(map(tuple, window_ids(reads, length).collect())) == want(False)
    assert sorted(map(tuple, window_ids(reads, length, p).collect())) == want(True)
