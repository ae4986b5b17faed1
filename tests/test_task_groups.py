"""Many small slices share a task; rows and slice numbers stay as planned."""

import gzip

from rangeweave import api
from rangeweave.plans import rules


def test_groups():
    assert rules.task_groups(0, 10) == [] and rules.task_groups(3, 1 << 40) == [(0, 1), (1, 2), (2, 3)]
    for n, size in ((1000, 10), (1000, 1 << 33), (5000, 1 << 33), (257, 1 << 50)):
        got = rules.task_groups(n, size)
        assert len(got) == min(n, max(rules.TASKS, -(-size // rules.TASK_BYTES)))
        assert [i for a, b in got for i in range(a, b)] == list(range(n)) and all(a < b for a, b in got)


def test_fastq_of_many_chunks(spark, tmp_path):
    path = f"{tmp_path}/r.fastq.gz"
    with open(path, "wb") as f:
        for a in range(0, 4001, 500):
            f.write(gzip.compress(b"".join(b"@r%d\nACGT%d\n+\nIIII\n" % (i, i) for i in range(a, min(a + 500, 4001)))))
    api.build_index(spark, "fastq", path, span=1 << 12)
    for rest, last in (("expand", 1333), ("merge", 1332)):
        d = api.read(spark, "fastq", path, "sequences_per_chunk", seq_per_chunk=3, rest=rest)
        assert d.rdd.getNumPartitions() == rules.TASKS
        got = d.orderBy("read_no").collect()
        assert [(x.read_no, x.id, x.seq, x._slice_id) for x in got] == [(i, f"@r{i}", f"ACGT{i}", min(i // 3, last)) for i in range(4001)]
    api.build_index(spark, "gzip", path, indexPath=f"{path}.lines", span=1 << 12)
    d = api.read(spark, "gzip", path, indexPath=f"{path}.lines", num_chunks=9000)
    assert d.rdd.getNumPartitions() == rules.TASKS
    assert [(x.line_no, x._slice_id) for x in d.orderBy("line_no").collect()] == [(i + 1, i // 2) for i in range(4 * 4001)]
    made = api.slices(spark, "fastq", path, "sequences_per_chunk", seq_per_chunk=3).orderBy("slice_id").collect()
    assert [m.slice_id for m in made] == list(range(1334)) and b"".join(bytes(m.payload) for m in made) == gzip.decompress(open(path, "rb").read())


def test_vcf_gz_of_many_chunks(spark, tmp_path):
    path = f"{tmp_path}/v.vcf.gz"
    rows = "".join(f"chr1\t{i}\t.\tA\tT\t.\tPASS\tDP={i}\n" for i in range(700))
    open(path, "wb").write(gzip.compress(("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + rows).encode()))
    api.build_index(spark, "vcf_gz", path)
    d = api.read(spark, "vcf_gz", path, num_chunks=351)
    assert d.rdd.getNumPartitions() == rules.TASKS
    assert [x.POS for x in d.orderBy("POS").collect()] == list(range(700))
