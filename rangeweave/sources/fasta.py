"""FASTA: an index of headers built by ranges, and slices that know when they start within a sequence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..functions import io
from ..plans import rules
from ..session import scratch
from .base import Format, Manifest

HEADER = re.compile(rb"(?m)^>[^\n]*\n?")
DEFAULT_CHUNK = 64 << 20
LOOK, MARK = 1 << 16, 1 << 20


def headers(path: str, size: int, start: int, end: int, mark: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the headers that start in [start, end), where end is behind the line end, which is read on for; and for each `mark` bytes of the range (start, line end bytes in them)."""
    out = []
    with io.opened(path) as f:
        before = f.read_at(1, start - 1) if start else b"\n"
        data = f.read_at(end - start, start)
        marks = [(start + i, data.count(b"\n", i, i + mark) + data.count(b"\r", i, i + mark)) for i in range(0, len(data), mark)]
        stop = end
        while stop < size and data.rfind(b">") > data.rfind(b"\n"):  # a last line that may be a header's beginning
            more = f.read_at(min(LOOK, size - stop), stop)
            data, stop = data + more, stop + len(more)
        for m in HEADER.finditer(data):
            if m.start() == 0 and before != b"\n" or start + m.start() >= end:
                continue
            out.append((start + m.start(), start + m.end()))
    return out, marks


def line_ends(manifest: Manifest, f, position: int) -> int:
    """Line end bytes before a position: the sum up to the mark before it, and a count of the bytes since, those between two marks at most."""
    t = manifest.table("marks", ["at", "before"], [("at", "<=", position), ("at", ">", position - manifest.attributes["mark"])])
    if not t.num_rows:
        return 0
    at, before = max(zip(t.column("at").to_pylist(), t.column("before").to_pylist()))
    data = f.read_at(position - at, at)
    return before + data.count(b"\n") + data.count(b"\r")


def plan(manifest: Manifest, num_chunks: int) -> list[dict]:
    t = manifest.table("headers", ["ordinal", "id_offset", "seq_offset"])
    return rules.fasta_chunks(manifest.size, num_chunks, t.column("id_offset").to_pylist(), t.column("seq_offset").to_pylist())


class Fasta(Format):
    """Indexed by many tasks: chunk_size sets their ranges (none: one of 64 MiB each)."""

    name = "fasta"
    attributes = {"num_sequences": "bigint"}
    parallel = True
    strategies = {"num_chunks": plan}
    default = "num_chunks"

    def build(self, spark, path, size, chunk_size=None, mark=MARK, **extra):
        cs = chunk_size or DEFAULT_CHUNK
        n = max(1, -(-size // cs))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    found, marks = headers(path, size, i * cs, min(size, (i + 1) * cs), mark)
                    rows = [(i, True, a, z) for a, z in found] + [(i, False, a, n) for a, n in marks]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["chunk", "header", "a", "b"])

        folder = scratch(spark, "fasta")  # the object is read once; numbers follow from what was found in it
        spark.range(0, n, 1, min(n, 10_000)).mapInArrow(work, "chunk long, header boolean, a long, b long").write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        heads = rows.where("header").select("chunk", F.col("a").alias("id_offset"), F.col("b").alias("seq_offset"))
        # numbers in order from sums over chunks, which are few, and a count within each
        counts = heads.groupBy("chunk").agg(F.count("*").alias("n"))
        before = counts.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))
        within = F.row_number().over(Window.partitionBy("chunk").orderBy("id_offset"))
        index = heads.withColumn("within", within).join(F.broadcast(before), "chunk").select((F.col("before") + F.col("within") - 1).alias("ordinal"), "id_offset", "seq_offset")
        marks = rows.where("NOT header").select(F.col("a").alias("at"), (F.sum("b").over(Window.orderBy("a")) - F.col("b")).alias("before"))  # a row for each `mark` bytes
        return lambda read: {"num_sequences": read("headers").count(), "mark": mark}, {"headers": index, "marks": marks}

    def schema(self, manifest, options):
        return "chunk_id int, seq_id string, description string, seq_offset long, sequence string, is_continuation boolean"

    def body(self, manifest: Manifest, part: dict) -> tuple[bytes, bytes]:
        """(header of the sequence it continues, or none; the slice's bytes)"""
        with io.opened(manifest.path) as f:
            head = f.read_at(part["header_end"] - part["header_start"], part["header_start"]) if part["header_start"] >= 0 else b""
            return head, f.read_at(part["end"] - part["start"], part["start"])

    def read(self, manifest, part, options):
        head, data = self.body(manifest, part)
        rows = []
        at = 0
        if head:
            m = HEADER.search(data)
            at = m.start() if m else len(data)
            if at:
                with io.opened(manifest.path) as f:
                    ends = line_ends(manifest, f, part["start"]) - line_ends(manifest, f, part["header_end"])
                rows.append((head, part["offset"] - ends, data[:at], True))
        found = list(HEADER.finditer(data, at))
        for m, after in zip(found, [*found[1:], None]):
            rows.append((m[0], 0, data[m.end() : after.start() if after else len(data)], False))
        names = [h[1:].decode("utf-8", "replace").strip().partition(" ") for h, _, _, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part["slice_id"]] * len(rows), pa.int32()), pa.array([n[0] for n in names], pa.string()), pa.array([n[2] for n in names], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].replace(b"\n", b"").replace(b"\r", b"").decode("ascii", "replace") for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
            ["chunk_id", "seq_id", "description", "seq_offset", "sequence", "is_continuation"],
        )

    def render(self, manifest, part, options):
        head, data = self.body(manifest, part)
        return head.rstrip(b"\r\n") + b" offset=%d\n" % part["offset"] + data if head else data
