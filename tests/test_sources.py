import glob
import os

import pytest
from pyspark.sql import functions as F

from helixframe import metrics
from helixframe.operators import prep, spectrum
from helixframe.params import Params, grid, parse, to_text
from helixframe.plans import runs
from helixframe.sources import logs, sequences, tables
from helixframe.streaming import spectra as streams

READS = "read_id long, bases string, quals string"
BASES = "GATTACAGCCTGAAGTCCATGGTTCAACGTAGG"


def fastq(path, n, broken=None):
    with open(path, "w") as f:
        for i in range(n):
            f.write(f"@{i}\n{BASES[i % 9:]}\n+\n{'@' if i % 2 else 'I'}{'I' * (len(BASES[i % 9:]) - 1)}\n" if i != broken else "@5\n\n+\nII\n")


def test_fastq_over_splits(spark, tmp_path):
    p = str(tmp_path / "r.fq")
    fastq(p, 700)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        reads = sequences.read_fastq(spark, p)
        rows = sorted(tuple(r) for r in reads.collect())
        assert [r[0] for r in rows] == list(range(700))
        assert sequences.slice_reads(reads, 3, 7).count() == 4 and sequences.file_sizes(spark, p).first().length == os.path.getsize(p)
        assert all(r[1] == BASES[r[0] % 9:] and len(r[1]) == len(r[2]) for r in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    fastq(p, 20, broken=5)
    assert sequences.read_fastq(spark, p, strict=False).count() == 5
    with pytest.raises(Exception, match="blank line"):
        sequences.read_fastq(spark, p).collect()
    fastq(p, 20)
    with open(p, "a") as f:
        f.write("\n\n")
    assert sequences.read_fastq(spark, p).count() == 20


def test_fasta_and_quality(spark, tmp_path):
    p = str(tmp_path / "a.fa")
    open(p, "w").write("junk\n>one x\r\nACGT\r\nAC\n;note\nGT\n>two\n>three\nTTT\n")
    rows = [(r.ord, r.header, r.seq) for r in sequences.read_fasta(spark, p).orderBy("ord").collect()]
    assert rows == [(0, "one x", "ACGTACGT"), (1, "two", ""), (2, "three", "TTT")]
    q = str(tmp_path / "a.q")
    open(q, "w").write(">one x\n@IIIIIIII\n>two\n\n>three\nIII\n")
    joined = sequences.join_quality(sequences.read_fasta(spark, p), sequences.read_fasta(spark, q)).orderBy("read_id").collect()
    assert [tuple(r) for r in joined] == [(0, "ACGTACGT", "I" * 8), (1, "", ""), (2, "TTT", "III")]
    wide = spark.createDataFrame([("h", "A" * 170)], "header string, seq string")
    out = str(tmp_path / "out")
    sequences.write_lines(sequences.fasta_lines(wide), out)
    back = sequences.read_fasta(spark, out + "/*.txt").first()
    assert back.seq == "A" * 170 and sequences.fasta_lines(wide).first().value == ">h\n" + "A" * 79 + "\n" + "A" * 79 + "\n" + "A" * 12


def test_fasta_in_many_splits(spark, tmp_path):
    want = [(i, f"h{i} >x", "ACGT" * (i % 9) + "T" * (i % 4)) for i in range(300)]
    for name, lead in (("a.fa", ""), ("b.fa", ";top\n\n")):
        with open(tmp_path / name, "w") as f:
            f.write(lead + "".join(f">{h}\n{s[:7]}\n;c\n{s[7:]}\n" for _, h, s in want))
    (tmp_path / "c.fa").write_text("")
    (tmp_path / "d.fa").write_text("no records\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = sequences.read_fasta(spark, str(tmp_path / "*.fa"))
        assert sequences.numbered_lines(spark, str(tmp_path / "a.fa")).select(F.spark_partition_id()).distinct().count() > 3
        rows = [(r.file[-4:], r.ord, r.header, r.seq) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(rows) == sorted((n, *w) for n in ("a.fa", "b.fa") for w in want)


def test_binary_spectrum_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SLICE", 7)
    kmers = spark.range(50).select(F.col("id").alias("kmer_id"), (F.col("id") % 200 + 1).cast("int").alias("cnt"))
    for name, lo, hi in (("a", 0, 29), ("b", 29, 50)):
        data = b"".join(bytes(r.content) for r in tables.encode_binary_spectrum(kmers.where(f"kmer_id >= {lo} and kmer_id < {hi}"), False).collect())
        (tmp_path / f"{name}.bin").write_bytes(data + b"\0" * (3 if name == "b" else 0))
    (tmp_path / "c.bin").write_bytes(b"")
    back = tables.read_binary_spectrum(spark, str(tmp_path / "*.bin"), False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kmers.collect()))
    assert back.rdd.getNumPartitions() == 8


def test_binary_and_text_layouts(spark, tmp_path):
    kmers = spark.createDataFrame([(5, 1), (2**32 - 1, 255)], "kmer_id long, cnt int")
    data = b"".join(bytes(r.content) for r in tables.encode_binary_spectrum(kmers, False).collect())
    assert len(data) == 16 and data[:5] == b"\x05\0\0\0\x01"
    (tmp_path / "k.bin").write_bytes(data)
    assert sorted(tuple(r) for r in tables.read_binary_spectrum(spark, str(tmp_path / "k.bin"), False).collect()) == [(5, 1), (2**32 - 1, 255)]
    tile = spark.createDataFrame([(-1, 7), (3, 2)], "tile_id long, cnt int")
    (tmp_path / "t.bin").write_bytes(b"".join(bytes(r.content) for r in tables.encode_binary_spectrum(tile, True).collect()))
    assert sorted(tuple(r) for r in tables.read_binary_spectrum(spark, str(tmp_path / "t.bin"), True).collect()) == [(-1, 7), (3, 2)]
    c = spark.createDataFrame([(4, [(1, 2, 3, 40), (5, 0, 1, 41)]), (6, [])], "read_id long, errs array<struct<pos:int,from:int,to:int,qual:int>>")
    assert [r.value for r in tables.correction_lines(c).collect()] == ["4\t2\t1\t2\t3\t40\t5\t0\t1\t41"]


def test_runs_streams_and_metrics(spark, tmp_path):
    p = Params(k=8, step=4, quality_threshold=50, max_bad=1, low_quality=65, input_path=str(tmp_path / "in" / "r.fq"), output_prefix=str(tmp_path / "err"), write_spectrum=True, kmer_out=str(tmp_path / "k"), tile_out=str(tmp_path / "t"))
    os.makedirs(tmp_path / "in")
    with open(p.input_path, "w") as f:
        for i in range(12):
            f.write(f"@{i}\n{BASES}\n+\n{'I' * 33}\n")
        f.write(f"@12\n{BASES[:15]}{'A' if BASES[15] != 'A' else 'C'}{BASES[16:]}\n+\n{'I' * 15}#{'I' * 17}\n")
    stats = metrics.RunStats()
    with stats.phase("run"):
        found = runs.run(spark, p)
    assert [(r.read_id, len(r.errs)) for r in found.where(F.size("errs") > 0).collect()] == [(12, 1)]
    text = "".join(open(x).read() for x in glob.glob(f"{p.output_prefix}/part*"))
    assert text.startswith("12\t1\t15\t")
    again = Params(**{**p.__dict__, "run_type": 2, "kmer_in": p.kmer_out, "tile_in": p.tile_out, "output_prefix": ""})
    assert runs.run(spark, again).where(F.size("errs") > 0).count() == 1
    assert runs.run(spark, Params(**{**p.__dict__, "run_type": 1})) is None
    assert metrics.correction_counters(found).first().corrected_reads == 1
    reads = sequences.read_fastq(spark, p.input_path)
    kmers, tile = spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)
    assert {r.kind: r.misses for r in metrics.lookup_counters(reads, kmers, tile, p).collect()} == {"kmer": 0, "tile": 0}
    assert stats.table(spark).count() == 1
    assert runs.histogram_run(reads, p, str(tmp_path / "hist")).count() == 512
    lines = [x.rstrip("\n") for f in sorted(glob.glob(str(tmp_path / "hist/part*"))) for x in open(f)]
    assert len(lines) == 516 and lines[0] == "tiles: all"
    live = streams.fastq_stream(spark, str(tmp_path / "in"))
    q = streams.spectrum_stream(live, p.k).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("live").collect()} == {tuple(r) for r in kmers.collect()}
    q = streams.correct_stream(streams.fastq_stream(spark, str(tmp_path / "in")), kmers, tile, p, str(tmp_path / "cs"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.read_id for r in spark.read.parquet(str(tmp_path / "cs")).collect()] == [12]


def test_prep(spark):
    import random

    rng = random.Random(3)
    bases = ["".join(rng.choice("ACGTN" if rng.random() < 0.6 else "acgtR") for _ in range(rng.randint(0, 18))) for _ in range(80)]

    def slow(b, w, d):
        p = [i for i, c in enumerate(b) if c not in "ACGTacgt"]
        out = list(b)
        for i, x in enumerate(p):
            if not any(0 <= j and j + d < len(p) and p[j + d] - p[j] <= w for j in range(i - d, i + 1)):
                out[x] = "T"
        return "".join(out)

    reads = spark.createDataFrame([(3 * i + 1, b, "I" * len(b)) for i, b in enumerate(bases)], READS)
    for w, d in ((3, 1), (5, 2), (1, 0), (0, 3)):
        got = {r.read_id: r.bases for r in prep.ambiguous_replaced(reads, w, d, "T").collect()}
        assert got == {3 * i + 1: slow(b, w, d) for i, b in enumerate(bases)}
    clean = [b for b in bases if not set(b) - set("ACGTacgt")]
    assert [r.bases for r in prep.renumber(prep.clean_only(reads)).orderBy("read_id").collect()] == clean
    assert [r.read_id for r in prep.renumber(reads).orderBy("read_id").collect()] == list(range(80))


def test_params_and_logs(spark, tmp_path):
    p = parse("# c\nKmerLen 8 # k\nStep 4\nT_ratio 0.25\nWriteOutput 0\nRunType 0\n").check()
    assert (p.k, p.step, p.ratio, p.write_output, p.tile) == (8, 4, 0.25, False, 12)
    assert parse(to_text(p)) == p
    assert [(n, x.k, x.step) for n, x in grid(p, k=[8, 9], step=[2])] == [("k8-step2", 8, 2), ("k9-step2", 9, 2)]
    for bad in (Params(k=2), Params(k=17), Params(step=0), Params(k=4, step=5), Params(run_type=2)):
        try:
            bad.check()
            raise AssertionError
        except ValueError:
            pass
    (tmp_path / "log").write_text("start\nspectrum construction 4.5\nerror correction: 12.25\nTotal 20\n")
    assert [(r.phase, r.seconds) for r in logs.timings(spark, str(tmp_path / "log")).orderBy("line").collect()] == [("spectrum construction", 4.5), ("error correction", 12.25), ("total", 20.0)]
    (tmp_path / "ph").write_text("nproc 4\nrank 0\nread: 1.5\nsort: 2.0\nrank 1\nread: 1.25\n")
    assert [(r.section, r.nproc, r["rank"], r.phase, r.seconds) for r in logs.phases(spark, str(tmp_path / "ph")).orderBy("section", "phase").collect()] == [(2, 4, 0, "read", 1.5), (2, 4, 0, "sort", 2.0), (3, 4, 1, "read", 1.25)]
    r = spark.range(1).select(*logs.parse_run_name(F.lit("d2h1r3w0t16"))).first()
    assert tuple(r) == ("d2", 1, 3, 0, 16)
