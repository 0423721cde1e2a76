"""SQL functions against the column functions and by hand."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import codec, sql
from helixframe.operators import neighbors, windows
from helixframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def dna(spark):
    sql.register(spark)
    sql.register(spark)  # again changes nothing
    return spark


def test_scalar_functions(dna):
    one = lambda q: tuple(dna.sql(f"SELECT {q}").first())
    assert one("dna_pack('ACGT'), dna_pack('acgt'), dna_pack('ACN'), dna_pack(''), dna_pack(NULL)") == (27, 27, None, None, None)
    assert one("dna_unpack(27, 4), dna_unpack(0, 3), dna_revcomp('ACNg'), dna_revcomp_id(27, 4)") == ("acgt", "aaa", "cNGT", 27)
    assert one("dna_mismatches(27, 26), dna_mismatches(27, 27), dna_low_quality('!!II', 50), dna_low_quality('', 50)") == (1, 0, 2, 0)
    for bases in ("ACGTACGTACGTACGTA", "T" * 32, "GATTACA" * 4, "TG" * 16):
        n = len(bases)
        assert one(f"dna_unpack(dna_pack('{bases}'), {n}), dna_unpack(dna_revcomp_id(dna_pack('{bases}'), {n}), {n})") == (bases.lower(), one(f"dna_revcomp('{bases.lower()}')")[0])
        have = dna.createDataFrame([(bases,)], "b string").select(codec.pack(F.col("b"), n)).first()[0]
        assert one(f"dna_pack('{bases}')")[0] == have
    assert one("dna_pack(repeat('A', 33))") == (None,)


def test_table_functions(dna):
    reads = dna.createDataFrame([(1, "ACGTNAC"), (2, "NACG"), (3, None), (4, "ACG"), (5, "ANACGTA"), (6, "acgtN"), (7, "ACGNACG"), (8, ""), (9, "ACGTNAC")], "read_id long, bases string")
    for n in (1, 3, 7):
        got = sorted(map(tuple, dna.sql("SELECT read_id, t.pos, t.w FROM {r} AS r, LATERAL dna_windows(r.bases, " + str(n) + ") AS t", r=reads).collect()))
        assert got == sorted(map(tuple, windows.windows(reads, n).collect()))
        listed = sorted((r.read_id, x.pos, x.w) for r in dna.sql("SELECT read_id, dna_window_list(bases, " + str(n) + ") AS l FROM {r}", r=reads).collect() for x in r.l or [])
        assert listed == got
    ids = dna.createDataFrame([(0,), (27,), (255,)], "id long")
    for low in (0, 2, 4):
        got = sorted(map(tuple, dna.sql("SELECT id, n.neighbor FROM {t} AS t, LATERAL dna_neighbors(t.id, 4, " + str(low) + ") AS n", t=ids).collect()))
        assert got == sorted(map(tuple, neighbors.unit_neighbors(ids, "id", 4, low).collect()))
    want = dna.range(1).select(F.explode(codec.differences(F.lit(27).cast("long"), F.lit(8).cast("long"), 4)).alias("e")).select("e.pos", "e.from", "e.to")
    assert [tuple(r) for r in dna.sql("SELECT * FROM dna_differences(27L, 8L, 4)").collect()] == [tuple(r) for r in want.collect()]


def test_no_python_in_the_plan(dna, small):
    plan = QUERIES["sql_frequent_kmers"](dna, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
