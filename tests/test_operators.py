"""Joins, closed-form plans and ingestion against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from rangeweave.operators import joins
from rangeweave.plans import frames, rules
from rangeweave.streaming import ingest


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("buckets", [None, 10.0])
def test_asof(spark, by, buckets):
    r = random.Random(1)
    left = [(i, r.choice("ab"), r.randint(0, 99)) for i in range(120)]
    right = [(r.choice("ab"), t, 1000 + t) for t in r.sample(range(100), 25)]
    got = joins.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "t", "t", by, buckets=buckets)
    assert got.count() == 120
    for x in got.collect():
        ts = sorted(t for k, t, _ in right if not by or k == x.k)
        at = bisect.bisect_right(ts, x.t) - 1
        assert x.v == (1000 + ts[at] if at >= 0 else None)


def test_intervals(spark):
    r = random.Random(2)
    p = [(r.randint(0, 100),) for _ in range(80)]
    iv = [(a, a + r.randint(0, 30)) for a in (r.randint(0, 100) for _ in range(40))]
    for closed in (False, True):
        got = joins.interval_join(spark.createDataFrame(p, "p int"), spark.createDataFrame(iv, "a int, b int"), "p", "a", "b", 7.0, closed)
        assert sorted(map(tuple, got.select("p", "a", "b").collect())) == sorted((x, a, b) for (x,) in p for a, b in iv if a <= x and (x <= b if closed else x < b))


def test_numbers(spark):
    values = random.Random(3).sample(range(10_000), 500)
    got = joins.numbered(spark.createDataFrame([(v,) for v in values], "v int"), "v", start=1, buckets=7).collect()
    assert sorted((x.row_no, x.v) for x in got) == list(enumerate(sorted(values), 1))


def test_plans_as_frames(spark):
    got = frames.byte_chunks(spark, 1003, 7, 10).orderBy("slice_id").collect()
    assert [(x.start, x.end) for x in got] == rules.byte_chunks(1003, num_chunks=7, base=10)
    for total, per, n in ((100, 10, 3), (105, 10, 4), (30, 10, 8)):
        got = frames.timestamp_blocks(spark, total, per, n).orderBy("slice_id").collect()
        assert [(x.row_0, x.row_1) for x in got] == rules.timestamp_blocks(total, per, n)
    got = frames.square_grid(spark, (0.0, 1.0), (9.0, 7.0), 7).collect()
    assert [(x.tile_x, x.tile_y, x.min_x, x.max_x, x.min_y, x.max_y) for x in got] == [(b["tile_x"], b["tile_y"], b["min_x"], b["max_x"], b["min_y"], b["max_y"]) for b in rules.boxes((0.0, 1.0), (9.0, 7.0), 7)]
    lines = spark.range(1, 11).select("id", frames.line_chunk(F.col("id"), 4, 10, "merge").alias("c"))
    assert [x.c for x in lines.orderBy("id").collect()] == [0] * 4 + [1] * 6


def test_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("k,v\n" + "".join(f"{i},{j}\n" for j in range(5)))
    seen = []
    q = ingest.ingest(spark, "csv", str(folder), lambda d, n: seen.extend(map(tuple, d.select("k", "v").collect())), f"{tmp_path}/check", glob="*.csv", num_chunks=2)
    q.awaitTermination()
    assert sorted(seen) == [(i, j) for i in range(3) for j in range(5)]
