import random

from pyspark.sql import functions as F

from helixframe.functions import codec

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def number(s):
    x = 0
    for c in s:
        x = x << 2 | "ACGT".index(c)
    return x - (1 << 64) if x >= 1 << 63 else x


def words(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(n)]


def test_pack_unpack_and_reverse(spark):
    for length in (1, 3, 15, 16, 17, 31, 32):
        rows = words(40, length, length) + ["A" * length, "T" * length]
        df = spark.createDataFrame([(r,) for r in rows], "b string").withColumn("id", codec.pack(F.col("b"), length))
        out = df.select("b", "id", codec.unpack(F.col("id"), length).alias("u"), codec.revcomp_id(F.col("id"), length).alias("rc"), codec.revcomp(F.col("b")).alias("rs"), codec.revcomp_id(codec.revcomp_id(F.col("id"), length), length).alias("twice"))
        for r in out.collect():
            turned = r.b[::-1].translate(COMPLEMENT)
            assert r.id == number(r.b) and r.u == r.b.lower() and r.rs == turned
            assert r.rc == number(turned) and r.twice == r.id


def test_unsigned_order_at_32_bases(spark):
    rows = sorted(words(50, 32, 5))
    df = spark.createDataFrame([(r,) for r in rows], "b string").withColumn("id", codec.pack(F.col("b"), 32))
    assert [r.b for r in df.orderBy(codec.unsigned_order(F.col("id"))).collect()] == rows


def test_head_tail_substitute_differences(spark):
    a, b = "ACGTACGTACGTAC", "ACGAACGTACCTAC"
    df = spark.createDataFrame([(number(a), number(b))], "a long, b long")
    r = df.select(codec.head_of(F.col("a"), 4).alias("h"), codec.tail_of(F.col("a"), 10).alias("t"), codec.differences(F.col("a"), F.col("b"), 14).alias("d"), codec.substitute(F.col("a"), F.lit(0), F.lit(3)).alias("s")).first()
    assert r.h == number(a[:10]) and r.t == number(a[4:]) and r.s == number(a[:-1] + "T")
    assert [tuple(x) for x in r.d] == [(10, 2, 1), (3, 3, 0)]


def test_small_functions(spark):
    r = spark.range(1).select(codec.bytes_needed(F.lit(0)).alias("a"), codec.bytes_needed(F.lit(255)).alias("b"), codec.bytes_needed(F.lit(256)).alias("c"), codec.low_quality_count(F.lit("!#5I"), 50).alias("q"), codec.base_code(F.lit("g")).alias("g"), codec.base_code(F.lit("N")).alias("n")).first()
    assert tuple(r) == (1, 1, 2, 2, 2, -1)
    ids = spark.range(10).select(codec.block_owner(F.col("id"), 3, F.lit(10)).alias("o")).collect()
    assert [x.o for x in ids] == [next(b for b in range(3) if b * 10 // 3 <= i < (b + 1) * 10 // 3) for i in range(10)]
