"""Round trips through slices: whatever their number, each record comes once."""

import gzip
import random
import uuid

import numpy as np
import pytest

from rangeweave import api
from rangeweave.codecs import las, tiff, zran
from rangeweave.sinks import files
from rangeweave.sources.base import Format
from rangeweave.sources.lines import slice_bytes


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("delimiters", [b"\n", b" \n"])
def test_slices_cover_every_text_once(delimiters):
    r = random.Random(3)
    for _ in range(60):
        data = "".join(r.choice(["a", "é", "\n", " ", "wörd", "x" * 40]) for _ in range(r.randint(0, 40))).encode()
        for n in (1, 2, 3, 7, len(data) or 1):
            cs = -(-len(data) // n)
            parts = [slice_bytes(Bytes(data), min(cs * i, len(data)), min(cs * (i + 1), len(data)), 0, len(data), delimiters)[2] for i in range(n)]
            assert b"".join(parts) == data
            for p in parts:
                p.decode()


@pytest.mark.parametrize("separator,final", [(",", "\n"), (";", ""), ("\t", "\n")])
def test_csv(spark, tmp_path, separator, final):
    rows = [(i, i / 4, f"näme {i}" if i % 3 else "") for i in range(120)] + [(120, 0.5, "y" * 700)]
    path = f"{tmp_path}/a.csv"
    with open(path, "w") as f:
        f.write(separator.join(["k", "v", "s"]) + "\n" + "\n".join(separator.join(map(str, r)) for r in rows) + final)
    with pytest.raises(Exception):
        api.read(spark, "csv", path, num_chunks=2).count()
    api.build_index(spark, "csv", path, separator=separator)
    assert api.attributes(spark, "csv", path).first().dtypes == ["bigint", "double", "string"]
    for n in (1, 2, 25, 400):
        got = sorted((r.k, r.v, r.s or "") for r in api.read(spark, "csv", path, num_chunks=n).collect())
        assert got == rows
    payload = api.slices(spark, "csv", path, num_chunks=5).orderBy("slice_id").collect()
    head = separator.join(["k", "v", "s"]).encode() + b"\n"
    assert all(bytes(p.payload).startswith(head) for p in payload)
    assert head + b"".join(bytes(p.payload)[len(head) :] for p in payload) == open(path, "rb").read()
    assert [c for c in api.read(spark, "csv", path, columns=["v"], num_chunks=3).columns] == ["v"]


def test_csv_row_on_boundary(spark, tmp_path):
    path = f"{tmp_path}/b.csv"
    with open(path, "w") as f:
        f.write("key\n" + "".join(f"{i:03d}\n" for i in range(99)))
    api.build_index(spark, "csv", path)
    got = api.read(spark, "csv", path, num_chunks=25).collect()
    assert sorted(int(r.key) for r in got) == list(range(99))


def test_words(spark, tmp_path):
    text = " ".join(["Ünïcode", "b", "c" * 90, "tab\tkept"] * 30) + "\nend"
    path = f"{tmp_path}/t.txt"
    open(path, "w").write(text)
    for n in (1, 3, 17, 200):
        got = api.read(spark, "text", path, num_chunks=n).orderBy("chunk_id").collect()
        assert "".join(r.text for r in got) == text
        assert [w for r in got for w in r.text.replace("\n", " ").split(" ") if w] == text.replace("\n", " ").split(" ")


@pytest.mark.parametrize("members", [1, 3])
@pytest.mark.parametrize("final", [b"\n", b""])
def test_gzip(spark, tmp_path, members, final):
    r = random.Random(5)
    lines = [b"%d %s" % (i, "".join(r.choice("éxyz0123456789 ") for _ in range(r.randint(0, 90))).encode()) for i in range(9001)]
    text = b"\n".join(lines) + final
    k = -(-len(text) // members)
    path = f"{tmp_path}/l.gz"
    open(path, "wb").write(b"".join(gzip.compress(text[i : i + k]) for i in range(0, len(text), k)))
    m = api.build_index(spark, "gzip", path, span=1 << 15)
    assert m.attributes["total_lines"] == 9001 and m.table("windows").num_rows > members
    for how in ({"strategy": "chunk_lines", "lines_per_chunk": 2000}, {"strategy": "chunk_lines", "lines_per_chunk": 2000, "rest": "merge"}, {"num_chunks": 7}, {"num_chunks": 1}):
        got = api.read(spark, "gzip", path, **how).orderBy("line_no").collect()
        assert [x.line_no for x in got] == list(range(1, 9002))
        assert [x.line.encode() for x in got] == lines
    assert api.plan(spark, "gzip", path, "chunk_lines", lines_per_chunk=2000).count() == 5


def test_zran_restarts():
    r = random.Random(9)
    text = bytes(r.choice(b"abcdefgh \n") for _ in range(700_000))
    data = gzip.compress(text[:300_000]) + gzip.compress(text[300_000:])
    points, total, lines = zran.scan(lambda n, at: data[at : at + n], len(data), 1 << 16)
    assert (total, lines) == (len(text), text.count(b"\n") + (text[-1:] != b"\n"))
    for p in points:
        assert b"".join(zran.text_from(lambda n, at: data[at : at + n], len(data), p)) == text[p["uncompressed_byte"] :]


def test_fastq(spark, tmp_path):
    path = f"{tmp_path}/r.fastq.gz"
    open(path, "wb").write(gzip.compress(b"".join(b"@r%d\nACGT\n+\nIIII\n" % i for i in range(10))))
    api.build_index(spark, "fastq", path)
    for how in ({"num_batches": 3}, {"num_batches": 40}, {"strategy": "sequences_per_chunk", "seq_per_chunk": 4}):
        got = api.read(spark, "fastq", path, **how).orderBy("read_no").collect()
        assert [(x.read_no, x.id) for x in got] == [(i, f"@r{i}") for i in range(10)]
    bad = f"{tmp_path}/bad.fastq.gz"
    open(bad, "wb").write(gzip.compress(b"@r\nA\n+\n"))
    api.build_index(spark, "fastq", bad)
    with pytest.raises(Exception, match="multiple of 4"):
        api.plan(spark, "fastq", bad, num_batches=2)


def test_fasta(spark, tmp_path):
    r = random.Random(1)
    records = [(f"s{i}", "de > scription" if i % 2 else "", "".join(r.choice("ACGT") for _ in range(r.randint(0, 260)))) for i in range(12)]
    text = "".join(f">{n}{' ' + d if d else ''}\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, d, s in records).rstrip("\n")
    path = f"{tmp_path}/f.fasta"
    open(path, "w").write(text)
    for chunk in (None, 1, 7, 64, len(text)):
        m = api.build_index(spark, "fasta", path, chunk_size=chunk if chunk is None or chunk > 5 else 37, force=True)
        assert m.attributes["num_sequences"] == 12
        t = m.table("headers")
        assert [text[a:b].rstrip("\n") for a, b in zip(t["id_offset"].to_pylist(), t["seq_offset"].to_pylist())] == [f">{n}{' ' + d if d else ''}" for n, d, _ in records]
    for n in (1, 2, 5, 33, 500):
        whole: dict = {}
        for x in api.read(spark, "fasta", path, num_chunks=n).collect():
            whole.setdefault(x.seq_id, []).append((x.seq_offset, x.is_continuation, x.sequence))
        assert {k: "".join(s for _, _, s in sorted(v)) for k, v in whole.items()} == {n_: s for n_, _, s in records}
    payload = [bytes(p.payload).decode() for p in api.slices(spark, "fasta", path, num_chunks=5).orderBy("slice_id").collect()]
    assert all(p.startswith(">") for p in payload if p) and any(" offset=" in p.split("\n")[0] for p in payload)


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=.,Type=Integer,Description="a, b=c">
##ALT=<ID=DEL:ME:ALU,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
"""


def test_vcf(spark, tmp_path):
    body = "".join(f"1\t{i}\t{'.' if i % 2 else 'rs' + str(i)}\tA\t{'.' if i == 4 else 'C,<DEL>'}\t{'.' if i == 3 else 9.5}\tPASS\t{'DP=4;DB' if i else '.'}\tGT\t0|1\t.\n" for i in range(50)).rstrip("\n")
    path, packed = f"{tmp_path}/v.vcf", f"{tmp_path}/v.vcf.gz"
    open(path, "w").write(VCF + body)
    open(packed, "wb").write(gzip.compress((VCF + body).encode()))
    api.build_index(spark, "vcf", path)
    api.build_index(spark, "vcf_gz", packed)
    a = api.attributes(spark, "vcf", path).first()
    assert a.body_offset == len(VCF) and a.structured["INFO"][0] == {"ID": "DP", "Number": ".", "Type": "Integer", "Description": "a, b=c"} and a.structured["ALT"][0]["ID"] == "DEL:ME:ALU"
    for fmt, p in (("vcf", path), ("vcf_gz", packed)):
        for n in (1, 2, 9, 120):
            got = api.read(spark, fmt, p, num_chunks=n).orderBy("POS").collect()
            assert [x.POS for x in got] == list(range(50))
        assert got[3].QUAL is None and got[4].ALT is None and got[0].INFO is None and got[1].INFO == {"DP": "4", "DB": "true"} and got[1].samples == {"A": "0|1", "B": "."}
    assert all(bytes(p.payload).decode().startswith(VCF) for p in api.slices(spark, "vcf", path, num_chunks=3).collect())


def test_las(spark, tmp_path):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 101, 5000), r.integers(0, 51, 5000)
    path = files.write_las(f"{tmp_path}/p.las", x, y, x + y, x % 50, y % 7, scales=(0.5, 0.5, 0.5))
    api.build_index(spark, "las", path, block_points=300)
    for n in (1, 4, 7, 9):
        d = api.read(spark, "las", path, num_chunks=n)
        assert sorted(p.point_no for p in d.collect()) == list(range(5000))
        assert sorted(map(tuple, d.select("x", "y").collect())) == sorted(zip(x.astype(float), y.astype(float)))
    assert api.read(spark, "las", path, num_chunks=4, boundary="closed").count() > 5000
    box = api.read(spark, "las", path, num_chunks=16, ranges={"x": (0, 20)})
    assert box.count() == int((x <= 20).sum()) and box.rdd.getNumPartitions() < 16
    made = api.slices(spark, "las", path, num_chunks=4).collect()
    assert sum(las.header(bytes(p.payload))["point_count"] for p in made) == 5000


def test_las_rejects(spark, tmp_path):
    path = f"{tmp_path}/z.las"
    data = bytearray(las.write([1], [1], [1], [1], [1]))
    data[104] |= 0x80
    open(path, "wb").write(data)
    with pytest.raises(NotImplementedError):
        api.build_index(spark, "las", path)


@pytest.mark.parametrize("how", [{}, {"tile": 16}, {"tile": 16, "deflate": True}, {"deflate": True}])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
def test_tiff(how, kind):
    p = np.arange(3 * 70 * 45).reshape(3, 70, 45).astype(kind)
    data = tiff.write(p, transform=[2, 0, 10, 0, -2, 20], epsg=4326, **how)
    read = lambda n, at: data[at : at + n]
    tags = tiff.directory(read)
    a = tiff.attributes(tags)
    assert (a["width"], a["height"], a["crs"], a["bands"]) == (45, 70, "EPSG:4326", 3) and a["bounds"] == {"left": 10, "bottom": -120, "right": 100, "top": 20}
    assert (tiff.window(read, tags, 5, 7, 40, 30) == p[:, 5:45, 7:37]).all()
    assert (tiff.window(read, tags, 0, 0, 70, 45) == p).all()


def test_raster(spark, tmp_path):
    p = np.arange(2 * 31 * 29, dtype="i4").reshape(2, 31, 29)
    path = files.write_tiff(f"{tmp_path}/r.tif", p, transform=[1, 0, 0, 0, -1, 0], tile=16)
    api.build_index(spark, "cog", path)
    for n in (1, 2, 5):
        got = api.read(spark, "cog", path, n_splits=n, exact=True).collect()
        assert len(got) == p.size and all(x.value == p[x.band - 1, x.row, x.col] for x in got)
    part = bytes(api.slices(spark, "cog", path, n_splits=2).orderBy("slice_id").collect()[3].payload)
    assert tiff.attributes(tiff.directory(lambda n, at: part[at : at + n]))["transform"][2] == 14.0


@pytest.mark.parametrize("continuous", [True, False])
def test_imzml(spark, tmp_path, continuous):
    mz = np.arange(20) / 2
    spectra = [(i, 2 * i, mz if continuous else mz[: 5 + i], np.arange(len(mz if continuous else mz[: 5 + i])) * i) for i in range(9)]
    path = files.write_imzml(f"{tmp_path}/s", spectra, continuous)
    m = api.build_index(spark, "imzml", path)
    assert m.attributes["is_continuous"] is continuous and m.attributes["num_spectra"] == 9
    for size in (400, 10_000):
        got = api.read(spark, "imzml", path, chunk_size=size).orderBy("spectrum_index").collect()
        assert [(x.x, x.y) for x in got] == [(i, 2 * i) for i in range(9)]
        assert all(x.mz == list(s[2]) and x.intensity == list(s[3].astype(float)) for x, s in zip(got, spectra))
    with pytest.raises(ValueError):
        api.plan(spark, "imzml", path, chunk_size=30)


def test_contract(spark, tmp_path):
    path = f"{tmp_path}/c.csv"
    open(path, "w").write("a,b\n1,x\n")
    assert api.exists(path) and not api.is_indexed(path)
    with pytest.raises(FileNotFoundError):
        api.build_index(spark, "csv", path + "no")
    with pytest.raises(ValueError):
        api.build_index(spark, "fasta", path, chunk_size=10**9)
    api.build_index(spark, "csv", path)
    open(path, "w").write("a,b,c\n1,x,y\n")
    assert api.attributes(spark, "csv", path).first()["columns"] == ["a", "b"]  # an index is kept
    api.build_index(spark, "csv", path, force=True)
    assert api.attributes(spark, "csv", path).first()["columns"] == ["a", "b", "c"] and api.index_size(path) > 0
    with pytest.raises(ValueError, match="no strategy"):
        api.plan(spark, "csv", path, "square_split", num_chunks=2)
    with pytest.raises(ValueError, match="indexed as csv"):
        api.plan(spark, "vcf", path, num_chunks=2)
    with pytest.raises(FileExistsError):
        api.new_from_file("csv", path, path)
    copy = api.new_from_file("csv", path, f"{tmp_path}/copy/{uuid.uuid4().hex}.csv")
    assert api.object_size(copy) == api.object_size(path)
    api.clean(path)
    assert not api.is_indexed(path) and api.exists(path)


class Lines3(Format):
    """A format of one's own: three-byte records."""

    name = "three"
    needs_index = False
    strategies = {"records": lambda m, per: [{"a": i, "b": min(m.size, i + 3 * per)} for i in range(0, m.size, 3 * per)]}
    default = "records"

    def schema(self, manifest, options):
        return "rec string"

    def read(self, manifest, part, options):
        import pyarrow as pa

        from rangeweave.functions import io

        with io.opened(manifest.path) as f:
            data = f.read_at(part["b"] - part["a"], part["a"]).decode()
        yield pa.RecordBatch.from_arrays([pa.array([data[i : i + 3] for i in range(0, len(data), 3)])], ["rec"])


def test_own_format(spark, tmp_path):
    path = f"{tmp_path}/x.bin"
    open(path, "w").write("aaabbbcccddd")
    api.register_format(Lines3())
    assert sorted(r.rec for r in api.read(spark, "three", path, per=2).collect()) == ["aaa", "bbb", "ccc", "ddd"]
    assert api.describe_format(spark, "three").count() == 1
