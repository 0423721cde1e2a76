"""Reads cut from texts as arrays, and queries whose figures come from counted windows alone."""

from helixframe import metrics
from helixframe.operators import correct, search, spectrum
from helixframe.params import Params
from helixframe.plans import queries
from helixframe.plans.reads import LETTERS, READ_LENGTH, ROOM, STANDS_FOR, derived_reads


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_are_cut_as_arrays(spark, tmp_path):
    """Odd texts against plain Python; before, regular expressions of the plan made every read."""
    texts = [(1, "abcXé q ñZj" * 50), (2, None), (3, ""), (None, "hello world" * 20), (5, " 12 -"), (-7, "straße İi" * 40), (6, "a" * 96), (7, "b" * 97)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = derived_reads(spark, str(tmp_path))
    want, to = [], dict(zip(LETTERS, STANDS_FOR))
    for doc, text in texts:
        s = "".join(to.get(c.upper(), "N") for c in text or "" if c.isascii() and c.isalpha())
        for part in range(-(-len(s) // READ_LENGTH)):
            b, r = s[part * READ_LENGTH:(part + 1) * READ_LENGTH], None if doc is None else doc * ROOM + part
            want.append((r, b, None if r is None else "".join(chr(33 + (i * 13 + r * 7) % 41) for i in range(1, len(b) + 1))))
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(got.collect()) == key(want) and len(want) > 12
    assert "MapInArrow" in _plan(got) and "regexp" not in _plan(got)


def _reads(spark, small):
    return derived_reads(spark, small).limit(300).localCheckpoint()


def test_lookups_in_own_spectra_need_no_join(spark, small):
    reads, p = _reads(spark, small), Params(k=10, step=4, min_count=3)
    # reads without qualities are looked up, but the tile spectrum doesn't have them
    reads = reads.selectExpr("read_id", "bases", "if(read_id % 5 = 0, NULL, quals) AS quals").localCheckpoint()
    got = metrics.own_lookup_counters(reads, p)
    want = metrics.lookup_counters(reads, spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p), p)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # before, the registered query joined windows with both spectra
    assert "Join" not in _plan(queries.lookup_counters(spark, small))


def test_first_tiles_are_searched_and_merged_in_the_workers(spark, small):
    """Same rows as by joins; before, every candidate of every stage became a row that was grouped again."""
    reads, p = _reads(spark, small), Params(k=10, step=4)
    kmers, tiles = spectrum.kmer_spectrum(reads, p).localCheckpoint(), spectrum.tile_spectrum(reads, p).localCheckpoint()
    first, ready = search.first_tiles(reads, p), correct.Corrector(kmers, tiles, p)
    pairs = first.select("h0", "t0").distinct().localCheckpoint()
    found, near = search.search(first, kmers, tiles, p, ready), search.merged_tiles(pairs, kmers, tiles, p, ready)
    for df in (found, near):
        assert "Aggregate" not in _plan(df) and "Join" not in _plan(df)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(search.search(first, kmers, tiles, p)) and found.count() == first.count() > 100
    assert rows(near) == rows(search.merged_tiles(pairs, kmers, tiles, p)) and near.count() > pairs.count()
    ready.close()


def test_sql_query_groups_counts_not_windows(spark, small):
    plan = _plan(queries.sql_frequent_kmers(spark, small))
    assert "MapInArrow" in plan and "Generate" not in plan


def test_counts_are_dealt_out_as_blocks(spark, small):
    """Same counts as row by row; before, each identifier that a task had counted was a row to be dealt out."""
    from pyspark.sql import functions as F

    from helixframe.operators import tallies

    reads, p = _reads(spark, small).repartition(3).localCheckpoint(), Params(k=10, step=4)
    for length, params, quality in ((3, None, True), (10, None, True), (14, p, True), (14, p, False)):
        got, each = tallies.window_totals(reads, length, params, quality), tallies.window_counts(reads, length, params, quality)
        want = each.groupBy("id").agg(*[F.sum(c).alias(c) for c in each.columns[1:]])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
        assert "ids#" in _plan(got)
