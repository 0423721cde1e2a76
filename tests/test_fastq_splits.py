"""The split FASTQ reader against the line-counting one, over splits of every small size."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.sources import fastq, sequences


def records_of(data: bytes, split: int, block: int = 64):
    """Records by split, all splits one after another."""
    out = []
    for at in range(0, len(data), split):
        out.append([tuple(r.values()) for b in fastq.read_range(io.BytesIO(data), "x", at, min(len(data), at + split), block) for r in b.to_pylist()])
    return out


def made(n, seed, ends="\n", last=True, length=94):
    """A twin of the usual test file: reads with N, qualities of codes 33 to 73 and so with @, + and >."""
    rng = random.Random(seed)
    reads = []
    for i in range(n):
        k = rng.randint(1, length)
        bases = "".join(rng.choice("ACGTN") for _ in range(k))
        quals = "".join(chr(rng.randint(33, 73)) for _ in range(k))
        if i % 3 == 0:
            quals = rng.choice("@+") + quals[1:]
        reads.append((i, bases, quals))
    text = "".join(f"@{i}{ends}{b}{ends}+{'' if i % 2 else i}{ends}{q}{ends}" for i, b, q in reads)
    return (text if last else text[: -len(ends)]).encode(), reads


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 64, 300, 1000, 4096])
@pytest.mark.parametrize("ends,last", [("\n", True), ("\r\n", False)])
def test_each_record_once(split, ends, last):
    data, reads = made(40, 3, ends, last)
    got = records_of(data, split)
    assert [r for part in got for r in part] == reads


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text("ACGTN", min_size=1, max_size=9), st.integers(0, 10 ** 6)), max_size=12), st.integers(1, 60), st.integers(1, 40), st.text("@+I>#", min_size=9, max_size=9))
def test_any_split_of_any_file(rows, split, block, odd):
    reads = [(i, b, (odd * 2)[i % 9:i % 9 + len(b)]) for i, (b, _) in enumerate(rows)]
    data = "".join(f"@{i}\n{b}\n+\n{q}\n" for i, b, q in reads).encode() + b"\n" * (split % 3)
    assert [r for part in records_of(data, split, block) for r in part] == reads


def test_a_record_belongs_to_the_range_where_it_begins():
    data, reads = made(10, 5)
    starts = [i for i in range(len(data)) if any(data[i:].startswith(f"@{n}\n{b}\n".encode()) for n, b, _ in reads)]
    for split in (17, 90, 200):
        for at, part in zip(range(0, len(data), split), records_of(data, split)):
            assert [r[0] for r in part] == [n for n, s in enumerate(starts) if at <= s < at + split]


def test_malformed_files_are_errors():
    for bad in (b"@1\nAC\n+\nII\n@2\nAC\n+\n", b"@1\nAC\n+\n\n@2\nAC\n+\nII\n", b"@1\n\n+\nII\n", b"@1\nAC\nII\n+\n@2\nAC\nII\n+\n"):
        with pytest.raises(fastq.Malformed):
            records_of(bad, 1000)


def test_equal_to_the_line_counting_reader(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.fq").write_bytes(made(60, i, last=bool(i))[0])
    (tmp_path / "empty.fq").write_bytes(b"")
    want = sorted(map(tuple, sequences.read_fastq(spark, str(tmp_path)).collect()))
    for split in (40, 777, 4096, None):
        df = fastq.read_fastq_splits(spark, str(tmp_path), split)
        assert df.columns == ["read_id", "bases", "quals"]
        assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1
    assert fastq.read_fastq_splits(spark, str(tmp_path / "*-1.fq"), 100).count() == 60
    one = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert fastq.read_fastq_splits(spark, str(tmp_path)).rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", one)


def test_runs_read_in_ranges(spark, tmp_path):
    from helixframe.params import Params
    from helixframe.plans import runs

    (tmp_path / "r.fq").write_bytes(made(30, 1)[0])
    p = Params(k=5, step=2, input_path=str(tmp_path / "r.fq"), write_output=False)
    other = sequences.read_fastq(spark, p.input_path)
    rows = lambda df: sorted((r.read_id, tuple(r.errs)) for r in df.collect())
    assert rows(runs.run(spark, p)) == rows(runs.run(spark, p, other))
