"""Formats of one's own that are indexed by many tasks; replacing an index; as-of joins in the columns' own types."""

import json

import pytest

from rangeweave import api
from rangeweave.operators import joins
from rangeweave.sources.base import Format


class Counted(Format):
    """Counts a byte by ranges."""

    name = "counted"
    parallel = True
    attributes = {"total": "bigint", "parts": "array<bigint>"}

    def map_chunk(self, path, chunk_id, start, end, num_chunks, byte="x"):
        data = open(path, "rb").read()[start:end]
        return json.dumps([chunk_id, num_chunks, data.count(byte.encode())]).encode()

    def finalize(self, path, partials, byte="x"):
        got = [json.loads(p) for p in partials]
        assert [g[0] for g in got] == list(range(got[0][1]))
        return {"total": sum(g[2] for g in got), "parts": [g[2] for g in got]}, {}


def test_map_and_finalize(spark, tmp_path):
    path = f"{tmp_path}/c.txt"
    open(path, "w").write("xxyxyyyxxz")
    m = api.build_index(spark, Counted(), path, chunk_size=4)
    assert m.attributes == {"total": 5, "parts": [3, 1, 1]} and repr(m) == f"counted<{path}>"
    assert api.build_index(spark, Counted(), path, force=True, byte="y").attributes == {"total": 4, "parts": [4]}


def test_chunk_size_where_it_has_no_use(spark, tmp_path):
    path = f"{tmp_path}/c.csv"
    open(path, "w").write("a,b\n1,x\n")
    with pytest.raises(ValueError, match="takes no chunk_size"):
        api.build_index(spark, "csv", path, chunk_size=4)


def test_failed_rebuild_keeps_the_index(spark, tmp_path):
    path = f"{tmp_path}/c.vcf"
    open(path, "w").write("##fileformat=VCFv4.2\n#CHROM\tPOS\n")
    api.build_index(spark, "vcf", path)
    open(path, "w").write("nothing of the kind\n")
    with pytest.raises(ValueError, match="no #CHROM"):
        api.build_index(spark, "vcf", path, force=True)
    assert api.is_indexed(path) and api.attributes(spark, "vcf", path).first()["columns"] == ["CHROM", "POS"]
    assert [p.name for p in tmp_path.iterdir() if ".new-" in p.name] == []


def test_fasta_marks(spark, tmp_path):
    """A slice within a sequence reads no more than a mark's bytes to know its place."""
    from rangeweave.sources import fasta

    path, rows = f"{tmp_path}/s.fasta", ["ACGT" * 15 for _ in range(200)]
    open(path, "w").write(">one and only\n" + "\n".join(rows) + "\n")
    m = api.build_index(spark, "fasta", path, chunk_size=1000, mark=64)
    assert api.open_index(path, name="marks").num_rows >= m.size // 64

    class Counting:
        read = 0

        def read_at(self, n, at):
            self.read += n
            return open(path, "rb").read()[at : at + n]

    data = open(path, "rb").read()
    for position in (0, 14, 1000, 5003, len(data)):
        f = Counting()
        assert fasta.line_ends(m, f, position) == data[:position].count(b"\n") and f.read <= 64
    got = api.read(spark, "fasta", path, num_chunks=9).orderBy("seq_offset").collect()
    at = 0
    for r in got:
        assert r.seq_offset == at
        at += len(r.sequence)
    assert "".join(r.sequence for r in got) == "".join(rows)


@pytest.mark.parametrize("buckets", [None, 1e15])
def test_asof_beyond_doubles_and_ties(spark, buckets):
    big = 2**53
    left = spark.createDataFrame([(1, big), (2, big + 1), (3, big + 2)], "i int, t long")
    right = spark.createDataFrame([(big + 1, 7), (big + 1, 9), (big + 1, 8), (5, 1)], "t long, v int")
    got = {r.i: (r.t_right, r.v) for r in joins.asof_join(left, right, "t", "t", buckets=buckets).collect()}
    assert got == {1: (5, 1), 2: (big + 1, 9), 3: (big + 1, 9)}
