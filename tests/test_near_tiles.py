"""Tiles near first tiles, looked up in the workers, against the joins with both spectra."""

import random

import pytest

from helixframe.operators import correct, search, spectrum
from helixframe.params import Params


@pytest.mark.parametrize("rounds,min_count,rows", [(1, 1, correct.BROADCAST_ROWS), (1, 2, 0), (2, 2, 0)])
def test_lookups_give_what_joins_give(spark, rounds, min_count, rows):
    r = random.Random(3)
    text = "AAAAAAA" + "".join(r.choice("ACGT") for _ in range(120))
    reads = []
    for i in range(150):
        at = r.randrange(100)
        b = [r.choice("ACGT") if r.random() < 0.1 else c for c in text[at:at + 24]]
        b = "".join(b) if i % 2 else "".join(reversed(b)).translate(str.maketrans("ACGT", "TGCA"))
        reads.append((i, b, "".join(r.choice("#I") for _ in b)))
    reads = spark.createDataFrame(reads, "read_id long, bases string, quals string")
    p = Params(k=6, step=3, max_distance=rounds, min_count=min_count)
    kmers, tiles = spectrum.kmer_spectrum(reads, p).localCheckpoint(), spectrum.tile_spectrum(reads, p).localCheckpoint()
    first, ready = search.first_tiles(reads, p), correct.Corrector(kmers, tiles, p, broadcast_rows=rows)
    assert ready.routed is None
    flat = lambda df: sorted(map(tuple, df.select("h0", "t0", "strand", "tile_id", "cnt", "own", "stage").collect()))
    pairs = first.select("h0", "t0").distinct()
    want = flat(search.candidates(pairs, kmers, tiles, p, (rounds, rounds)))
    got = search.candidates(pairs, kmers, tiles, p, (rounds, rounds), ready)
    # before, each lookup was a join: no table of this plan has the spectra
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert flat(got) == want and len(want) > len(pairs.collect())
    found = lambda *more: sorted(map(tuple, search.search(first, kmers, tiles, p, *more).collect()))
    assert found(ready) == found()
    ready.close()
