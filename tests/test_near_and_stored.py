"""Joins of near identifiers, stored spectra, restart counts of any width."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import delta, neighbors, spectrum
from helixframe.params import Params
from helixframe.sources.stored import StoredSpectrum


def frame(spark, values, name="id"):
    return spark.createDataFrame([(int(v),) for v in values], f"{name} long")


def close(values, k, d):
    """All pairs, counted base by base."""
    out = set()
    for a, b in itertools.combinations(sorted(set(values), key=lambda x: x % (1 << 64)), 2):
        x = (a ^ b) % (1 << 64)
        if sum((x >> 2 * i & 3) > 0 for i in range(k)) <= d:
            out.add((a, b))
    return out


# near identifiers ------------------------------------------------------------------------------
@pytest.mark.parametrize("k,d,chunks,crowd", [(6, 1, None, 256), (6, 2, None, 256), (6, 2, 3, 4), (8, 2, 6, 1), (7, 3, None, 8), (5, 5, None, 256), (4, 2, 2, 2)])
def test_pairs_of_near_identifiers(spark, k, d, chunks, crowd):
    rng = np.random.RandomState(k * 10 + d)
    values = rng.randint(0, 4 ** k, 120).tolist() + [v ^ (1 << int(rng.randint(0, 2 * k))) for v in rng.randint(0, 4 ** k, 60).tolist()]
    got = [(r.a, r.b) for r in neighbors.hamming_pairs(frame(spark, values + values[:9]), "id", k, d, chunks, crowd).collect()]
    want = close(values, k, d)
    assert set(got) == want and len(got) == len(want)


def test_crowded_keys_of_long_identifiers(spark):
    """Identifiers of 32 bases, most of which differ in the last four: every mask but some is crowded."""
    rng = np.random.RandomState(2)
    base = int(rng.randint(0, 1 << 62)) | 1 << 63
    values = {base ^ int(x) for x in rng.randint(0, 256, 200)} | {base ^ int(x) << 50 for x in rng.randint(0, 256, 60)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [(r.a, r.b) for r in neighbors.hamming_pairs(frame(spark, values), "id", 32, 2, None, 16).collect()]
    want = close(values, 32, 2)
    assert set(got) == want and len(got) == len(want) > 500


def test_no_pairs(spark):
    assert neighbors.hamming_pairs(frame(spark, []), "id", 6, 2).collect() == []
    assert neighbors.hamming_pairs(frame(spark, [3, 3]), "id", 6, 2).collect() == []
    assert neighbors.hamming_pairs(frame(spark, [3, 1]), "id", 6, 0).collect() == []
    nulls = spark.createDataFrame([(None,), (None,), (5,), (4,)], "id long")
    assert [tuple(r) for r in neighbors.hamming_pairs(nulls, "id", 6, 1).collect()] == [(4, 5)]


def test_distance_one_is_the_neighbour_join(spark):
    values = np.random.RandomState(4).randint(0, 4 ** 5, 300).tolist()
    ids = frame(spark, sorted(set(values)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(neighbors.hamming_pairs(ids, "id", 5, 1)) == rows(neighbors.hamming1_pairs(ids, "id", 5))


# stored spectra ------------------------------------------------------------------------------------
P = Params(k=4, step=2, max_bad=99)


def batches(spark, n=3):
    rng = np.random.RandomState(8)
    out = []
    for b in range(n):
        rows = [(i, "".join(rng.choice(list("ACGT"), 30)), "I" * 30) for i in range(20)]
        # one word often enough to saturate across batches
        rows += [(100 + i, "ACGTACGTAC", "I" * 10) for i in range(90 * (b % 2 + 1))]
        out.append(spark.createDataFrame(rows, "read_id long, bases string, quals string"))
    return out


@pytest.fixture
def stored(spark):
    made = []

    def make(name, column="kmer_id", buckets=4):
        s = StoredSpectrum(spark, name, column, buckets)
        made.append(s)
        return s

    yield make
    for s in made:
        s.drop()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merging_in_any_order_is_one_run(spark, stored):
    parts = batches(spark)
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2])
    for build, column in ((spectrum.kmer_spectrum, "kmer_id"), (spectrum.tile_spectrum, "tile_id")):
        free = Params(k=4, step=2, max_bad=99, min_count=0)
        want = rows(build(whole, free))
        assert max(c for _, c in want) == 255
        for n, order in enumerate(((0, 1, 2), (2, 0, 1))):
            s = stored(f"any_{column}_{n}", column)
            assert not s.exists()
            s.merge_all(build(parts[i], free) for i in order)
            assert s.generation() == 2 and rows(s.table()) == want
            assert rows(s.table(3)) == [r for r in want if r[1] >= 3]


def test_the_stored_side_does_not_move(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b, _ = batches(spark)
        s = stored("still").merge(spectrum.kmer_spectrum(a, Params(k=4, step=2, min_count=0)))
        asked = spectrum.kmer_spectrum(b, P).select(F.col("kmer_id").alias("x"))
        for df in (s.merged(spectrum.kmer_spectrum(b, P)), s.lookup(asked, "x")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            at = plan.index("still_g0")
            line = plan[plan.rindex("FileScan", 0, at + 1):].split("\n", 1)[0] if "FileScan" in plan[:at] else plan
            assert "Bucketed: true" in line
            # going up from the stored scan, no exchange before the join
            lines = plan.split("\n")
            scan = next(i for i, x in enumerate(lines) if "still_g0" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
            up, low = [], depth(lines[scan])
            for x in reversed(lines[:scan]):
                if depth(x) < low:
                    up.append(x)
                    low = depth(x)
                if "Join" in x and depth(x) <= low:
                    break
            assert any("SortMergeJoin" in x for x in up) and not any("Exchange" in x for x in up)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookups_and_failed_merges(spark, stored):
    a, b, _ = batches(spark)
    free = Params(k=4, step=2, min_count=0)
    s = stored("probe").merge(spectrum.kmer_spectrum(a, free))
    have = dict(rows(s.table()))
    asked = spark.range(256).select(F.col("id").alias("x"))
    assert {r.x: r.found for r in s.lookup(asked, "x").collect()} == {x: have.get(x) for x in range(256)}
    assert {r.x for r in s.lookup(asked, "x", 5).where("found is not null").collect()} == {k for k, c in have.items() if c >= 5}
    bad = spectrum.kmer_spectrum(b, free).withColumn("cnt", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        s.merge(bad)
    assert dict(rows(s.table())) == have
    # what a broken merge has left doesn't count, and the next one replaces it
    s.merge(spectrum.kmer_spectrum(b, free))
    assert rows(s.table()) == rows(spectrum.kmer_spectrum(a.unionAll(b), free))


# restart counts ----------------------------------------------------------------------------------------
def walked(ids, step):
    refs, last = 0, None
    for x in sorted(ids):
        if last is None or x >= last + step:
            refs, last = refs + 1, x
    return refs


def test_restarts_of_every_width(spark):
    rng = np.random.RandomState(1)
    near = np.cumsum(rng.randint(1, 60, 4000)).tolist()
    far = np.cumsum(rng.randint(1, 1 << 40, 3000)).tolist()
    mixed = sorted(set(near) | {v * 1000 + (1 << 58) for v in near[:500]} | set(far) | {(1 << 62) - 1})
    for ids in (near, far, mixed, [7], [0, 255, 256, 511, 512, 513]):
        df = frame(spark, ids, "kmer_id").repartition(5).persist()
        got = {r.width: (r.references, r.deltas) for r in delta.restart_table(df, "kmer_id", range(1, 8)).collect()}
        assert got == {w: (walked(ids, 256 ** w), len(ids) - walked(ids, 256 ** w)) for w in range(1, 8)}
        df.unpersist()
    assert delta.restarts(frame(spark, [], "kmer_id"), "kmer_id", 3) == (0, 0)


def test_the_tree_where_steps_hold_many_ranges(spark, monkeypatch):
    """Ranges narrower than a step, many levels of the tree."""
    monkeypatch.setattr(delta, "FEW_STEPS", 0)
    monkeypatch.setattr(delta, "FAN", 2)
    ids = np.cumsum(np.random.RandomState(6).randint(1, 40, 3000)).tolist()
    for w in (1, 2, 7):
        assert delta.restarts(frame(spark, ids, "kmer_id"), "kmer_id", w) == (walked(ids, 256 ** w), len(ids) - walked(ids, 256 ** w))


def test_chains_compose_like_one_range():
    rng = np.random.RandomState(3)
    for step in (1, 5, 30, 400):
        ids = np.unique(rng.randint(0, 900, 120)).astype(np.int64)
        cut = int(rng.randint(1, len(ids) - 1))
        both = delta.Chain.of(ids[:cut], step).then(delta.Chain.of(ids[cut:], step), step)
        whole = delta.Chain.of(ids, step)
        assert (both.at.tolist(), both.refs.tolist(), both.last.tolist()) == (whole.at.tolist(), whole.refs.tolist(), whole.last.tolist())
        assert whole.refs[0] == walked(ids.tolist(), step)


def test_a_dense_spectrum_is_written_as_its_complement(spark, tmp_path):
    """Run type 1 writes absent k-mers where most occur; run type 2 reads either form."""
    from helixframe.functions import codec
    from helixframe.plans import runs

    rng = np.random.RandomState(2)
    rows = [(i, "".join(rng.choice(list("ACGT"), 60)), "".join(chr(c) for c in rng.choice([40, 73], 60))) for i in range(12)]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    for k, dense in ((4, True), (6, False)):
        p = Params(k=k, step=2, max_bad=99, low_quality=65, run_type=1, kmer_out=str(tmp_path / f"k{k}"), tile_out=str(tmp_path / f"t{k}"))
        runs.run(spark, p, reads)
        have = {r.kmer_id for r in spectrum.kmer_spectrum(reads, p).collect()}
        written = {r.kmer_id: r.cnt for r in spark.read.parquet(p.kmer_out).collect()}
        assert (len(have) > 4 ** k / 2) == dense
        assert written.keys() == (set(range(4 ** k)) - have if dense else have) and (set(written.values()) == {0}) == dense
        again = Params(**{**p.__dict__, "run_type": 2, "kmer_in": p.kmer_out, "tile_in": p.tile_out})
        assert {r.kmer_id for r in runs.stored_spectra(spark, again)[0].collect()} == have
        errors = lambda df: sorted((r.read_id, tuple(r.errs)) for r in df.collect())
        whole = Params(**{**p.__dict__, "run_type": 0})
        assert errors(runs.run(spark, again, reads)) == errors(runs.run(spark, whole, reads))
    letters = spark.createDataFrame([("A",), ("n",), ("x",), ("",), (None,), ("@A",)], "c string")
    assert [r[0] for r in letters.select(codec.is_alphabet(F.col("c"))).collect()] == [True, True, False, False, False, False]
