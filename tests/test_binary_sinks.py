"""Binary files written by the tasks: the bytes are those of one write, and no rows come to the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave import api, queries
from rangeweave.codecs import las
from rangeweave.functions import io
from rangeweave.sinks import files
from rangeweave.sources import measurement

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_rows_to_driver(spark, monkeypatch):
    def refused(self, *_):
        raise AssertionError("a table came to the driver")

    for name in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_las_rows_are_one_write(spark, tmp_path, n):
    columns = [F.expr(e).cast("int").alias(c) for c, e in (("x", "id - 40"), ("y", "id % 17"), ("z", "-id"), ("intensity", "id % 100"), ("classification", "id % 5"))]
    path = files.write_las_rows(spark.range(0, n, 1, 7).orderBy(F.desc("id")).select(*columns), f"{tmp_path}/p.las", scales=(0.5, 1.0, 2.0), offsets=(1.0, 0.0, 0.0))
    i = np.arange(n)[::-1]
    assert io.read_bytes(path) == las.write(i - 40, i % 17, -i, i % 100, i % 5, (0.5, 1.0, 2.0), (1.0, 0.0, 0.0))
    assert io.listing(str(tmp_path)) == ["p.las"]


def test_las_without_rows_in_the_driver(spark, no_rows_to_driver):
    path = queries.events_las(spark, SF)
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").select("event_id", "user_id", F.floor("value").alias("v")).collect()
    x, y, z = (np.array([f(r) for r in e]) for f in (lambda r: r.v, lambda r: r.user_id, lambda r: r.event_id % 1000))
    assert io.read_bytes(path) == las.write(x, y, z, z % 100, y % 5, (1.0, 1.0, 1.0))


def test_las_index_of_many_blocks_takes_few_tasks(spark, tmp_path):
    i = np.arange(3000)
    path = files.write_las(f"{tmp_path}/p.las", i, i % 7, i, i % 100, i % 5)
    m = api.build_index(spark, "las", path, block_points=2)
    assert len(m.table("blocks")) == 1500
    assert sum(p.endswith(".parquet") for p in io.listing(f"{path}.rwidx")) <= 256


def test_las_tile_rendered_in_pieces(spark, tmp_path):
    i = np.arange(4000)
    path = files.write_las(f"{tmp_path}/p.las", i % 61, i % 37, i, i % 100, i % 5)
    api.build_index(spark, "las", path, block_points=100)
    for s in api.slices(spark, "las", path, num_chunks=4).collect():
        own = api.read(spark, "las", path, num_chunks=4).where(f"tile_x = {s.slice_id // 2} and tile_y = {s.slice_id % 2}").orderBy("point_no").collect()
        assert bytes(s.payload) == las.write(*([r[c] for r in own] for c in ("x", "y", "z", "intensity", "classification")))


def test_ms_without_rows_in_the_driver(spark, monkeypatch, no_rows_to_driver):
    monkeypatch.setattr(measurement, "BLOCK_ROWS", 10)
    folder = queries.events_ms(spark, SF)
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").select("user_id", F.floor("value").alias("v")).collect()
    user, v = np.array([r.user_id for r in e]), np.array([r.v for r in e])
    flags = np.packbits(np.stack([user % k == 0 for k in (2, 3, 5)], 1), axis=1, bitorder="little")
    want = {"TIME": (np.arange(len(e)) // 7).astype("<f8"), "DATA": np.stack([v, user], 1).astype("<f4"), "FLAG": flags, "ANTENNA": user.astype("<i4")}
    for name, w in want.items():
        assert io.read_bytes(f"{folder}/{name}.bin") == w.tobytes() + b"\0" * (-w.nbytes % 4096)
    assert api.attributes(spark, "ms", folder).first().rows_per_time == 7


def test_ms_slice_is_read_and_written_in_blocks(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(measurement, "BLOCK_ROWS", 10)
    folder = queries.events_ms(spark, SF)
    fmt = measurement.MeasurementSet()
    m = fmt.manifest(folder, {})
    part = fmt.plan(m, None, {"num_chunks": 9})[3]
    got = list(fmt.read(m, part, {}))
    assert max(b.num_rows for b in got) == 10 and [r for b in got for r in b.column(0).to_pylist()] == list(range(part["row_0"], part["row_1"] + 1))
    fmt.write_slice(m, part, f"{tmp_path}/s")
    for c in m.attributes["columns"]:
        data = fmt.column_bytes(m, part, c)
        assert io.read_bytes(f"{tmp_path}/s/{c['file']}") == data + b"\0" * (-len(data) % 4096)
