"""Pairs of near identifiers by lookups against the joins by masks and brute force."""

import random

import pytest

from helixframe.operators import neighbors


@pytest.mark.parametrize("k,distance,n", [(1, 1, 4), (2, 2, 9), (6, 1, 300), (6, 2, 300), (11, 2, 200)])
def test_pairs_by_lookups(spark, k, distance, n):
    r = random.Random(k)
    ids = {r.randrange(1 << 2 * k) for _ in range(n)}
    ids |= {x ^ (r.randrange(4) << 2 * r.randrange(k)) for x in list(ids)} | {0, (1 << 2 * k) - 1}
    table = spark.createDataFrame([(x,) for x in ids] + [(None,), (0,)], "x long").repartition(3)
    bases = lambda x: sum(x >> 2 * i & 3 > 0 for i in range(k))
    want = sorted((a, b) for a in ids for b in ids if a < b and bases(a ^ b) <= distance)
    got = neighbors.near_pairs(table, "x", k, distance)
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, neighbors.hamming_pairs(table, "x", k, distance).collect()))
    # before, identifiers met their neighbours in joins whose rows grow with the square of a key's members
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_identifiers_are_joined(spark):
    table = spark.createDataFrame([(5,), (4,), (1 << 40 | 1 << 20,)], "x long")
    assert list(map(tuple, neighbors.near_pairs(table, "x", 31, 2).collect())) == [(4, 5)]
