import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import correct, spectrum
from helixframe.params import Params

TEMPLATE = "GATTACAGCCTGAAGTCCATGGTTCAACGTAGGCTATCTC"
NEXT = dict(zip("ACGT", "CGTA"))
P = Params(k=8, step=4, max_distance=1, ratio=0.5, quality_threshold=50, max_bad=1, low_quality=65, trusted_count=8, min_count=1)
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def found(spark, rows, params):
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    kmers, tiles = spectrum.kmer_spectrum(reads, params), spectrum.tile_spectrum(reads, params)
    out = {r.read_id: [tuple(e) for e in r.errs] for r in correct.correct(reads, kmers, tiles, params).collect()}
    return out, kmers.count(), tiles.count()


def template_rows(pos, q, turned=False):
    base = TEMPLATE[::-1].translate(COMPLEMENT) if turned else TEMPLATE
    rows = [(i, base, "I" * 40) for i in range(12)]
    bad = TEMPLATE[:pos] + NEXT[TEMPLATE[pos]] + TEMPLATE[pos + 1:]
    return rows + [(12, bad, "I" * pos + q + "I" * (39 - pos))]


@pytest.mark.parametrize("pos, expected, kmers, tiles", [(2, [(2, 3, 0, 35)], 36, 32), (10, [], 41, 40), (20, [(20, 2, 3, 35)], 41, 41), (21, [(21, 2, 3, 35)], 41, 41), (38, [(38, 3, 0, 35)], 35, 31)])
def test_one_substitution(spark, pos, expected, kmers, tiles):
    got, k, t = found(spark, template_rows(pos, "#"), P)
    assert got[12] == expected and (k, t) == (kmers, tiles)
    assert not any(got[i] for i in range(12))
    assert found(spark, template_rows(pos, "I"), P)[0][12] == []


def test_unknown_kmers_and_other_strand(spark):
    strict = Params(**{**P.__dict__, "min_count": 2})
    assert found(spark, template_rows(20, "#"), strict)[0][12] == []
    got, k, t = found(spark, template_rows(20, "#", turned=True), P)
    assert got[12] == [] and (k, t) == (66, 58)


# a plain second reading of the rules: lists and nested loops, no sharing of work
def slow(read, quals, kmers, tiles, p):
    k, s = p.k, p.step
    rc = lambda w: w[::-1].translate(COMPLEMENT)

    def pairs(heads, tails):
        out = []
        for i, h in enumerate(heads):
            for j, t in enumerate(tails):
                if h[s:] == t[:k - s]:
                    w = h + t[k - s:]
                    if w in tiles or i == j == 0:
                        out.append([w, tiles.get(w, 0)])
        return out

    def both(h, t, rh, rt):
        a, b = pairs(h, t), [[rc(w), n] for w, n in pairs(rh, rt)]
        if not a or not b:
            return a or b
        sums = {}
        for w, n in a + b:
            sums[w] = sums.get(w, 0) + n
        first = a[0][0]
        return [[first, sums[first]]] + [[w, sums[w]] for w in sorted(sums) if w != first]

    def widen(ws, low):
        new = {w[:i] + c + w[i + 1:] for w in ws for i in range(k) if k - 1 - i >= low for c in "ACGT" if c != w[i]}
        ws.extend(w for w in sorted(new) if w in kmers and set(w) != {"A"})

    def diff(new, old, q):
        return [(i, "ACGT".index(new[i]), "ACGT".index(old[i]), ord(q[i])) for i in range(k + s - 1, -1, -1) if new[i] != old[i]]

    def decide(ts, q):
        if not ts:
            return None
        (own, g), rest = ts[0], ts[1:]
        if g >= p.trusted_count:
            return []
        if not rest:
            return [] if g >= p.min_count and all(ord(c) >= p.low_quality for c in q) else None
        cand = [w for w in rest if w[1] >= p.min_count]
        if g < p.min_count:
            return diff(cand[0][0], own, q) if len(cand) == 1 else None
        alt = [d for d in (diff(w, own, q) for w, n in cand if n >= int(g / p.ratio)) if any(e[3] < p.low_quality for e in d)]
        return None if len(alt) > 1 else alt[0] if alt else []

    def call(h, t, ub, dp, q):
        hs, ts = [h] if h in kmers else [], [t] if t in kmers else []
        rh, rt = [rc(t)] if rc(t) in kmers else [], [rc(h)] if rc(h) in kmers else []
        a = b = 0
        while a <= ub[0]:
            now = both(hs, ts, rh, rt)
            d = decide(now, q)
            if d is not None:
                return d
            b += 1
            if b <= ub[1]:
                widen(ts, dp[1])
                widen(rh, dp[1])
            else:
                a += 1
                if a <= ub[0]:
                    widen(hs, dp[0])
                    widen(rt, dp[0])
                elif now and now[0][1] >= p.min_count and max(n for _, n in now) <= now[0][1]:
                    return []
        return None

    read, out, n = list(read), [], len(read)
    pos, prev, crawl, to, ub, dp = 0, -1, False, -1, (p.max_distance,) * 2, (0, k - s)
    while True:
        w = "".join(read[pos:pos + k + s])
        if len(w) < k + s or set(w) - set("ACGT"):
            return out
        d = call(w[:k], w[s:], ub, dp, quals[pos:pos + k + s])
        if d is not None:
            for i, f, t, q in d:
                read[pos + i] = "ACGT"[f]
                out.append((pos + i, f, t, q))
            if pos + s + k == n:
                return out
            prev = pos
            if not crawl:
                ub = (0, p.max_distance)
                if pos + s <= n - k - s:
                    dp, pos = (k, 0), pos + s
                else:
                    dp, pos = (k, pos + k + 2 * s - n), n - k - s
        elif not crawl:
            crawl, to = True, pos
        if crawl:
            if pos == prev + 1 or prev == -1:
                return out
            pos = prev + 1
            if pos == to:
                crawl = False
            ub, dp = (0, 1), (k, k - 3)


def words_of(rows, length, p, quality):
    out = {}
    for _, b, q in rows:
        ok = [i for i in range(len(b) - length + 1) if set(b[i:i + length]) <= set("ACGT")]
        if any(i < len(b) - length for i in ok):
            for i in ok:
                if not quality or sum(ord(c) < p.quality_threshold for c in q[i:i + length]) <= p.max_bad:
                    out[b[i:i + length]] = min(255, out.get(b[i:i + length], 0) + 1)
    return {w: c for w, c in out.items() if c >= p.min_count}


@pytest.mark.parametrize("params", [Params(k=5, step=2, max_distance=1, min_count=2, quality_threshold=50, max_bad=1, low_quality=65), Params(k=5, step=2, max_distance=2, min_count=2, quality_threshold=50, max_bad=1, low_quality=65), Params(k=7, step=1, max_distance=2, quality_threshold=45, max_bad=3, low_quality=65), Params(k=4, step=4, max_distance=1, quality_threshold=45, max_bad=3, low_quality=60, trusted_count=20)])
def test_against_slow_reading(spark, params):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(150))
    rows = []
    for i in range(90):
        at, n = rng.randint(0, 120), rng.randint(3, 45)
        b = list(genome[at:at + n])
        b = [rng.choice("ACGTN") if rng.random() < 0.05 else c for c in b]
        b = "".join(b)
        rows.append((i, b[::-1].translate(COMPLEMENT) if rng.random() < 0.3 else b, "".join(chr(rng.choice([35, 48, 60, 70, 73, 73])) for _ in b)))
    got = found(spark, rows, params)[0]
    kmers, tiles = words_of(rows, params.k, params, False), words_of(rows, params.tile, params, True)
    want = {i: slow(b, q, kmers, tiles, params) for i, b, q in rows}
    assert got == want and any(want.values())


def test_apply_and_odd_reads(spark):
    rows = [*template_rows(20, "#"), (13, None, None), (14, "ACG", "III"), (15, "", ""), (16, TEMPLATE.lower(), "I" * 40)]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    fixed = correct.correct(reads, spectrum.kmer_spectrum(reads, P), spectrum.tile_spectrum(reads, P), P)
    out = {r.read_id: r.bases for r in correct.corrected_reads(reads, fixed).collect()}
    assert out[12].upper() == TEMPLATE and out[12][20] == "g" and out[13] is None and out[14] == "ACG"
    assert fixed.where(F.col("errs").isNull()).count() == 0
    assert correct.correct(reads.where("false"), spectrum.kmer_spectrum(reads, P), spectrum.tile_spectrum(reads, P), P).count() == 0


def test_supersteps_give_the_same_errors_and_end(spark, tmp_path):
    """Reads in small blocks against stored spectra, for one and two substitutions; the report tells the work."""
    from helixframe.operators.routed import Routed

    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(40))
    rows = []
    for i in range(80):
        at, n = rng.randint(0, 10), rng.randint(3, 30)
        b = "".join(rng.choice("ACGTN") if rng.random() < 0.04 else c for c in genome[at:at + n])
        rows.append((i, b, "".join(chr(rng.choice([35, 48, 60, 73, 73])) for _ in b)))
    rows += [(None, rows[0][1], rows[0][2]), (7, rows[7][1], rows[7][2]), (900, None, None), (901, "ACGT", None), (902, "ACG", "II")]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string").repartition(3)
    key = lambda r: (str(r[0]), r[1])
    for p in (Params(k=6, step=3, max_distance=1, min_count=2, quality_threshold=50, max_bad=2, low_quality=65), Params(k=6, step=2, max_distance=2, min_count=2, quality_threshold=50, max_bad=2, low_quality=65)):
        kmers, tiles = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
        errors = lambda df: sorted(((r.read_id, [tuple(e) for e in r.errs]) for r in df.collect()), key=key)
        want = errors(correct.correct(reads, kmers, tiles, p))
        ready = Routed(kmers, tiles, p, "file://" + str(tmp_path), buckets=3)
        try:
            for block in (1000, 7)[p.max_distance - 1:]:
                assert errors(ready.correct(reads, block)) == want
                assert 1 < len(ready.report) < 400
                left = [r["reads"] for r in ready.report]
                assert left == sorted(left, reverse=True) and left[0] <= len(rows)
                assert all(r["asked_kmers"] + r["asked_tiles"] > 0 and r["key_bytes"] > 0 for r in ready.report)
            assert ready.correct(reads.where("false")).count() == 0
            # a later step moves questions and blocks, the spectra stay in their buckets
            plan = ready.stored["kmer_id"].lookup(spark.range(9).withColumnRenamed("id", "x"), "x")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") <= 1 and "Bucketed: true" in plan
        finally:
            ready.close()
    assert any(e for _, e in want)


def test_tables_that_the_caller_keeps_stay_kept(spark):
    reads = spark.createDataFrame(template_rows(20, "#"), "read_id long, bases string, quals string")
    kmers, tiles = spectrum.kmer_spectrum(reads, P).persist(), spectrum.tile_spectrum(reads, P).persist()
    ready = correct.Corrector(kmers, tiles, P)
    assert kmers.is_cached and kmers.storageLevel.useMemory and tiles.storageLevel.useMemory
    assert ready.correct(reads).where("size(errs) > 0").count() == 1
    assert ready.correct(reads.where("read_id < 5")).where("size(errs) > 0").count() == 0
    kmers.unpersist()
    tiles.unpersist()


def test_statistics_by_task(spark, tmp_path):
    """Totals are those of one walk over all reads, however reads are dealt out; corrections are the same."""
    import numpy as np

    from helixframe import metrics

    rows = [*template_rows(20, "#"), *[(100 + r[0], r[1], r[2]) for r in template_rows(10, "#")], (300, None, None), (301, "ACG", "III")]
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    kmers, tiles = spectrum.kmer_spectrum(reads, P), spectrum.tile_spectrum(reads, P)
    lookup = correct.Counting(correct.Arrays(*correct._arrays(kmers, tiles)))
    texts = [b or "" for _, b, _ in rows]
    n = np.array([len(b) for b in texts])
    correct.walk(correct.Settler(P, lookup), correct._CODE[correct._matrix(texts, n)], correct._matrix([q or "" for _, _, q in rows], n), n)
    ready = correct.Corrector(kmers, tiles, P)
    plain = sorted((r.read_id, [tuple(e) for e in r.errs]) for r in ready.correct(reads).collect())
    for parts in (1, 3):
        found, stats = ready.correct_counted(reads.repartition(parts), str(tmp_path / f"s{parts}"))
        assert sorted((r.read_id, [tuple(e) for e in r.errs]) for r in found.collect()) == plain
        got = {r.counter: r for r in metrics.spread(stats).collect()}
        assert {c: got[c].total for c in got if c != "seconds"} == {
            "reads": len(rows), "corrected": sum(bool(e) for _, e in plain), "kmer_lookups": lookup.asked[0], "kmer_misses": lookup.missed[0], "tile_lookups": lookup.asked[1], "tile_misses": lookup.missed[1]}
        assert all(r.tasks == parts and r.least <= r.mean <= r.greatest for r in got.values()) and got["kmer_lookups"].total > got["kmer_misses"].total > 0
        assert sorted(r.task for r in stats.collect()) == list(range(parts))


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    """The sink's batch function run again for one batch number, as after a failure; the spectra are computed once."""
    import shutil

    from helixframe.streaming import spectra as streams

    rows = template_rows(20, "#")
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    kmers, tiles = spectrum.kmer_spectrum(reads, P), spectrum.tile_spectrum(reads, P)
    for n, part in enumerate((rows[:6], rows[6:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.fq").write_text("".join(f"@{i}\n{b}\n+\n{q}\n" for i, b, q in part))
    live = lambda: streams.fastq_stream(spark, str(tmp_path / "in"), max_files=1)
    run = lambda: streams.correct_stream(live(), kmers, tiles, P, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    want = sorted((r.read_id, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [i for i, _ in want] == [12]
    # the checkpoint forgets that the last batch was done, so it is played again
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    shutil.rmtree(tmp_path / "cp" / "commits" / f".{last.name}.crc", ignore_errors=True)
    (tmp_path / "cp" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted((r.read_id, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    (tmp_path / "in" / "9.fq").write_text("@1\nACGT\n+\n")
    with pytest.raises(Exception, match="cut off"):
        run()


@pytest.mark.parametrize("distance", [1, 2])
def test_first_tiles_by_joins_are_settled_as_by_the_kernel(spark, distance):
    import numpy as np

    from helixframe.operators import search

    rng = random.Random(distance)
    p = Params(k=5, step=2, max_distance=distance, min_count=1, quality_threshold=45, max_bad=3, low_quality=62, trusted_count=12)
    genome = "".join(rng.choice("ACGT") for _ in range(70))
    rows = []
    for i in range(150):
        at, n = rng.randint(0, 55), rng.randint(6, 15)
        b = "".join(rng.choice("ACGT") if rng.random() < 0.06 else c for c in genome[at:at + n])
        rows.append((i, b[::-1].translate(COMPLEMENT) if i % 3 == 0 else b, "".join(chr(rng.choice([35, 48, 60, 70, 73])) for _ in b)))
    reads = spark.createDataFrame(rows, "read_id long, bases string, quals string")
    kmers, tiles = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
    settler = correct.Settler(p, correct.Arrays(*correct._arrays(kmers, tiles)))
    first = [(i, b[:p.tile], q[:p.tile]) for i, b, q in rows if len(b) >= p.tile]
    number = lambda b: sum("ACGT".index(c) << 2 * (p.tile - 1 - j) for j, c in enumerate(b))
    low = [sum(3 << 2 * (p.tile - 1 - j) for j, c in enumerate(q) if ord(c) < p.low_quality) for _, _, q in first]
    n, u = len(first), lambda x: np.array(x, np.uint64)
    ok, to = settler.settle(u([number(b) for _, b, _ in first]), [np.full(n, distance)] * 2, [np.zeros(n, np.int64), np.full(n, p.k - p.step)], u(low))
    want = {i: int(t) if k else -1 for (i, _, _), k, t in zip(first, ok, to)}
    got = {r.read_id: r for r in search.search(search.first_tiles(reads, p), kmers, tiles, p).collect()}
    assert {i: r.chosen for i, r in got.items()} == want
    assert {-1} < set(want.values()) and any(r.chosen not in (-1, r.own) for r in got.values()) and len({r.stage for r in got.values()}) > 2
