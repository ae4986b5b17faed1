"""Rows with null keys or null ordering values stay, with and without buckets."""

import pytest

from rangeweave.operators import joins


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("buckets", [None, 10.0])
def test_asof_keeps_null_rows(spark, by, buckets):
    left = [(1, None, 35), (2, "a", None), (3, None, None), (4, "a", 35), (5, "b", 1)]
    right = [(None, 12, 1012), ("a", 14, 1014)]
    got = joins.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "t", "t", by, buckets=buckets)
    assert {x.i: x.v for x in got.collect()} == ({1: 1012, 2: None, 3: None, 4: 1014, 5: None} if by else {1: 1014, 2: None, 3: None, 4: 1014, 5: None})
    assert got.count() == 5
