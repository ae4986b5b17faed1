"""Golden values of the planning rules, worked out by hand from their definitions."""

import pytest
from hypothesis import given, strategies as st

from rangeweave.functions import io
from rangeweave.plans import rules


def test_lines():
    assert rules.line_chunks(10, 4) == [(1, 4), (5, 8), (9, 10)]
    assert rules.line_chunks(10, 4, "merge") == [(1, 4), (5, 10)]
    assert rules.line_chunks(12, 4) == rules.line_chunks(12, 4, "merge") == [(1, 4), (5, 8), (9, 12)]
    assert rules.line_chunks(9, 4)[-1] == (9, 9) and rules.line_chunks(9, 4, "merge")[-1] == (5, 9)
    assert rules.line_chunks(3, 4, "merge") == [(1, 3)]
    with pytest.raises(ValueError):
        rules.line_chunks(3, 4, "else")


def test_reads():
    assert rules.read_batches(40, 3) == [(0, 4), (4, 8), (8, 10)]
    assert rules.read_batches(20, 4) == [(0, 2), (2, 4), (4, 5), (5, 5)]
    assert rules.reads_per_chunk(40, 4) == [(0, 4), (4, 8), (8, 10)]
    assert rules.reads_per_chunk(40, 4, "merge") == [(0, 4), (4, 10)]
    with pytest.raises(ValueError):
        rules.read_batches(41, 3)


def test_fasta_sample():
    heads = [0, 236, 473, 709, 946, 1183, 1426, 1663, 1898]
    bodies = [60, 296, 533, 769, 1006, 1249, 1486, 1721, 1958]
    got = rules.fasta_chunks(2136, 8, heads, bodies)
    assert [(s["start"], s["end"]) for s in got] == [(0, 236), (236, 534), (534, 801), (801, 1068), (1068, 1335), (1335, 1602), (1602, 1869), (1869, 2136)]
    assert [s["offset"] for s in got] == [0, 0, 1, 32, 62, 86, 116, 148]
    assert [s["header_start"] for s in got] == [-1, -1, 473, 709, 946, 1183, 1426, 1663]


def test_grids():
    assert [rules.grid(n) for n in (4, 7, 9, 2, 3, 5)] == [(2, 2), (3, 2), (3, 3), (1, 2), (2, 2), (2, 2)]
    w = rules.raster_windows(10, 7, 4)
    assert [(x["col_off"], x["col_off"] + x["width"]) for x in w[:4]] == [(0, 3), (2, 5), (5, 8), (8, 10)]
    assert [(x["row_off"], x["height"]) for x in rules.raster_windows(7, 7, 2)[::2]] == [(0, 4), (4, 3)]
    with pytest.raises(ValueError):
        rules.raster_windows(7, 7, 0)
    with pytest.raises(ValueError):
        rules.raster_windows(7, 7, 1.5)


def test_packing():
    assert rules.packed([40, 40, 40, 90, 10, 10], 100) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert rules.packed([40, 40, 40], 100, 20) == [(0, 2), (2, 3)]
    with pytest.raises(ValueError):
        rules.packed([120], 100)


def test_timestamps():
    assert rules.timestamp_blocks(100, 10, 3) == [(0, 39), (40, 69), (70, 99)]
    assert rules.timestamp_blocks(105, 10, 4) == [(0, 29), (30, 59), (60, 79), (80, 104)]
    assert len(rules.timestamp_blocks(30, 10, 8)) == 3


def test_windows():
    assert rules.window_range([1, 50, 90], [0, 500, 900], 1200, 60, 80) == (1, 500, 900)
    assert rules.window_range([1, 50, 90], [0, 500, 900], 1200, 95, 200) == (2, 900, 1200)


@given(st.integers(0, 500), st.integers(1, 40))
def test_byte_chunks_cover_once(size, n):
    got = rules.byte_chunks(size, num_chunks=n)
    assert len(got) == n and got[0][0] == 0 and got[-1][1] == size
    assert all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_chunk_size_above_object():
    with pytest.raises(ValueError):
        rules.byte_chunks(10, chunk_size=11)


def test_uris():
    assert io.split_uri("s3://bucket/a/../b/c") == ("bucket", "b/c")
    assert io.join_uri("s3", "bucket", "/a/./b") == "s3://bucket/a/b"
    assert io.parent("a/b/c") == "a/b"
    with pytest.raises(ValueError):
        io.split_uri("bucket/key")
