"""Reads against their own spectra: tables from one pass, tails searched in columns, corrections put in where reads are."""

import random

import numpy as np
import pytest

from helixframe.operators import correct, spectrum
from helixframe.params import Params


class Plain(correct.Arrays):
    """Goes by lists of k-mers, as lookups whose questions count do."""

    whole = False


def _rows(n=300):
    r = random.Random(3)
    text = "".join(r.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(n):
        at, size = r.randrange(250), r.choice((8, 20, 40, 50))
        b = "".join(r.choice("ACGTN") if r.random() < 0.03 else c for c in text[at:at + size])
        rows.append((i, b, "".join(chr(r.choice((35, 48, 60, 73, 73))) for _ in b)))
    return rows + [(None, rows[0][1], rows[0][2]), (7, rows[7][1], rows[7][2]), (900, None, None), (901, rows[1][1], None), (902, rows[2][1], "II"), (903, "é" + rows[3][1], "I" + rows[3][2]), (904, "", "")]


@pytest.mark.parametrize("k,step,rounds,least", [(8, 4, 1, 1), (6, 3, 2, 2), (5, 5, 1, 1)])
def test_own_spectra_give_what_given_ones_give(spark, k, step, rounds, least):
    reads = spark.createDataFrame(_rows(), "read_id long, bases string, quals string").repartition(3)
    p = Params(k=k, step=step, max_distance=rounds, min_count=least, quality_threshold=50, max_bad=4, low_quality=65)
    given = correct.Corrector(spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p), p)
    own = correct.Corrector.of_reads(reads, p)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(given.correct(reads))
    assert rows(own.correct(reads)) == want and any("pos=" in r for r in want)
    cut = correct.Corrector.of_reads(reads, p, cut=iter)
    assert rows(cut.correct(reads, iter)) == want and rows(cut.corrected(reads, iter)) == rows(own.corrected(reads))
    cut.close()
    texts, once = own.corrected(reads), "read_id IS NOT NULL AND read_id <> 7"
    assert rows(texts.where(once)) == rows(correct.corrected_reads(reads.where(once), given.correct(reads.where(once))))
    assert texts.count() == reads.count() and any(set("acgt") & set(r.bases or "") for r in texts.collect())
    # before, corrected reads came from a join of all reads with their corrections
    assert "Join" not in texts._jdf.queryExecution().executedPlan().toString()
    given.close()
    own.close()
    none = correct.Corrector.of_reads(reads.where("false"), p)
    assert rows(none.corrected(reads)) == rows(reads)
    none.close()


@pytest.mark.parametrize("k,step,least,seed", [(5, 2, 1, 1), (5, 2, 3, 2), (4, 4, 1, 3), (6, 1, 2, 4), (10, 4, 1, 5)])
def test_tails_in_columns_decide_as_lists(k, step, least, seed):
    r = np.random.default_rng(seed)
    p = Params(k=k, step=step, min_count=least, trusted_count=9)
    n, all_ = 4000, 1 << 2 * p.tile
    base = r.integers(0, all_, 60).astype(np.uint64)
    tile = base[r.integers(0, 60, n)] ^ np.uint64(1) * (r.integers(1, 4, n) << 2 * r.integers(0, p.tile, n)).astype(np.uint64)
    tile[::7] = 0
    tiles = np.unique(np.concatenate((base, tile[::2], correct._reverse(tile[::3], p.tile))))
    kmers = np.unique(np.concatenate((tiles >> np.uint64(2 * step), tiles & np.uint64((1 << 2 * k) - 1))))
    counts = r.choice([1, 2, 3, 4, 8, 9, 30], len(tiles)).astype(np.uint8)
    kmers = kmers[r.random(len(kmers)) < 0.95]
    low = sum(np.where(r.random(n) < 0.3, 3, 0).astype(np.uint64) << np.uint64(2 * i) for i in range(p.tile))
    low[::5] = 0
    reach = [np.where(r.random(n) < 0.2, 1, 0), r.integers(0, 2, n)]
    lowest = [np.full(n, 0), r.choice([0, 0, 1, k - 3, k - step], n)]
    got, want = (correct.Settler(p, kind(kmers, tiles, counts)).search(tile, reach, lowest, low) for kind in (correct.Arrays, Plain))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    few = reach[0] == 0
    assert {-1, 0, 1, 2} <= set(got[0][few].tolist()) and (got[1] != tile)[few].any()


def test_several_corrections_of_a_place_leave_the_last():
    import pyarrow as pa

    bases = pa.array(["AAAA", None, "CCéC", "GGGG", ""])[:4]
    found = np.array([[0, 0, 2, 3], [1, 1, 3, 0], [1, 3, 0, 2], [0] * 4, [40] * 4])
    for part, rows in ((bases, found), (bases[:2], found[:, :2])):
        assert correct._put_in(part, rows).to_pylist() == ["AtAA", None, "CCéa", "gGGG"][:len(part)]
