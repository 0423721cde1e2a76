"""The next smaller identifier without ranks and a join of ranks."""

import random

import pytest

from helixframe.operators import spectrum


@pytest.mark.parametrize("pieces", [1, 4, 1024])
def test_next_smaller_identifier(spark, pieces):
    ids = sorted(set(random.Random(2).choices(range(1 << 12), k=300)) - set(range(1000, 2500)))
    table = spark.createDataFrame([(x,) for x in ids], "x long").repartition(3)
    got = spectrum.preceding(table, "x", 6, pieces)
    assert sorted(map(tuple, got.collect())) == list(zip(ids, [None, *ids[:-1]]))
