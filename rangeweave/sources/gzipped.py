"""Lines of gzip-compressed text, and reads of FASTQ, by ranges of lines.

Stock readers give one task a whole gzip file.  The index holds restart points, so that a task inflates from the point before its first line.
Where libz is missing the index has the first point only, and every task inflates from the start.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..codecs import zran
from ..functions import io
from ..plans import rules
from .base import Format, Manifest

BATCH = 50_000


def with_windows(manifest: Manifest, pairs: list[tuple[int, int]]) -> list[dict]:
    """Slices of inclusive line pairs, with the window each starts from and its range of compressed bytes."""
    t = manifest.table("windows", ["ordinal", "line_number", "mid_line", "compressed_byte"])
    # a window that begins within a line serves lines behind that one only
    first = [n + m for n, m in zip(t.column("line_number").to_pylist(), t.column("mid_line").to_pylist())]
    at = t.column("compressed_byte").to_pylist()
    out = []
    for a, b in pairs:
        w, r0, r1 = rules.window_range(first, at, manifest.size, a, b + 1)
        out.append({"line_0": a, "line_1": b + 1, "window": w, "range_0": r0, "range_1": r1})
    return out


def read_slices(manifest: Manifest, ranges: list[tuple[int, int]]) -> list[dict]:
    return with_windows(manifest, [(4 * a + 1, 4 * b) for a, b in ranges])


class GzipText(Format):
    name = "gzip"
    attributes = {"total_lines": "bigint", "index_key": "string"}
    strategies = {
        "chunk_lines": lambda m, lines_per_chunk, rest="expand": with_windows(m, rules.line_chunks(m.attributes["total_lines"], lines_per_chunk, rest)),
        "num_chunks": lambda m, num_chunks: with_windows(m, rules.even_lines(m.attributes["total_lines"], num_chunks)),
    }
    default = "num_chunks"
    SPAN = 1 << 20

    def build(self, spark, path, size, chunk_size=None, span=SPAN, **extra):
        with io.opened(path) as f:
            if zran.library() is not None:
                points, total, lines = zran.scan(f.read_at, size, span)
            else:
                points, total, lines = [{"compressed_byte": 0, "bits": -1, "uncompressed_byte": 0, "line_number": 1, "mid_line": 0, "window": b""}], 0, 0
                for block in iter(lambda g=gzip.GzipFile(fileobj=f): g.read(1 << 20), b""):
                    total, lines, last = total + len(block), lines + block.count(b"\n"), block[-1:]
                lines += bool(total) and last != b"\n"
        table = pa.table(
            {
                "ordinal": pa.array(range(len(points)), pa.int64()), "compressed_byte": [p["compressed_byte"] for p in points], "bits": [p["bits"] for p in points],
                "uncompressed_byte": [p["uncompressed_byte"] for p in points], "line_number": [p["line_number"] for p in points], "mid_line": [p["mid_line"] for p in points],
                "window_size": [len(p["window"]) for p in points], "window": pa.array([zlib.compress(p["window"]) for p in points], pa.binary()),
            }
        )
        return {"total_lines": lines, "index_key": "windows.parquet", "uncompressed_size": total}, {"windows": table}

    def lines_from_start(self, path: str) -> Iterator[bytes]:
        with io.opened(path) as f, gzip.GzipFile(fileobj=f) as g:
            for line in g:
                yield line.rstrip(b"\n")

    def lines(self, manifest: Manifest, part: dict) -> Iterator[tuple[int, bytes]]:
        """(number, line) of a slice; lines end at \\n only, a last one needs none."""
        if part["line_0"] >= part["line_1"]:
            return
        t = manifest.table("windows", where=[("ordinal", "==", part["window"])])  # a few windows of 32 KiB, whatever their number
        point = {c: t.column(c)[0].as_py() for c in t.column_names}
        point["window"] = zlib.decompress(point["window"])
        number, held, partial = point["line_number"], [], bool(point["mid_line"])  # partial: the current line's beginning is not at hand
        with io.opened(manifest.path) as f:
            texts = zran.text_from(f.read_at, manifest.size, point) if zran.library() is not None else iter(lambda g=gzip.GzipFile(fileobj=f): g.read(1 << 20), b"")
            for data in texts:
                ends = data.count(b"\n")
                if number + ends < part["line_0"]:  # whole blocks of earlier lines pass by
                    number, held, partial = number + ends, [], not data.endswith(b"\n")
                    continue
                *whole, rest = data.split(b"\n")
                for line in whole:
                    if held:
                        line, held = b"".join([*held, line]), []
                    if number >= part["line_1"]:
                        return
                    if number >= part["line_0"] and not partial:
                        yield number, line
                    number, partial = number + 1, False
                if rest:
                    held.append(rest)
            if held and part["line_0"] <= number < part["line_1"]:
                yield number, b"".join(held)

    def schema(self, manifest, options):
        return "line_no long, line string, _slice_id int"

    def read(self, manifest, part, options):
        yield from self.run(manifest, [part], options)

    def read_all(self, manifest, parts, options):
        """Slices whose lines follow each other are inflated in one go."""
        if type(self).read is not GzipText.read:  # a subclass that reads slice by slice
            yield from super().read_all(manifest, parts, options)
            return
        held: list[dict] = []
        for part in (p for p in parts if p["line_0"] < p["line_1"]):
            if held and held[-1]["line_1"] != part["line_0"]:
                yield from self.run(manifest, held, options)
                held = []
            held.append(part)
        if held:
            yield from self.run(manifest, held, options)

    def run(self, manifest: Manifest, parts: list[dict], options: dict) -> Iterator[pa.RecordBatch]:
        """The lines of slices that follow each other, from the first one's window on."""
        numbers, lines = [], []
        first, ids = (np.array([p[k] for p in parts]) for k in ("line_0", "slice_id"))

        def made():
            of = ids[np.searchsorted(first, numbers, "right") - 1]
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), pa.array(of, pa.int32())], ["line_no", "line", "_slice_id"])

        for number, line in self.lines(manifest, parts[0] | {"line_1": parts[-1]["line_1"]}):
            numbers.append(number)
            lines.append(line.decode("utf-8", "replace"))
            if len(lines) == BATCH:
                yield made()
                numbers, lines = [], []
        if lines:
            yield made()

    def render(self, manifest, part, options):
        return b"".join(line + b"\n" for _, line in self.lines(manifest, part))


class Fastq(GzipText):
    """Four-line reads in gzip."""

    name = "fastq"
    shares = ("gzip",)
    strategies = {
        **GzipText.strategies,
        "reads_batches": lambda m, num_batches: read_slices(m, rules.read_batches(m.attributes["total_lines"], num_batches)),
        "sequences_per_chunk": lambda m, seq_per_chunk, rest="expand": read_slices(m, rules.reads_per_chunk(m.attributes["total_lines"], seq_per_chunk, rest)),
    }
    default = "reads_batches"

    def schema(self, manifest, options):
        return "read_no long, id string, seq string, plus string, qual string, _slice_id int"

    def run(self, manifest, parts, options):
        if any((p["line_0"] - 1) % 4 or (p["line_1"] - 1) % 4 for p in parts):
            raise ValueError("a slice of lines cuts a read; use reads_batches or sequences_per_chunk")
        for batch in super().run(manifest, parts, options):
            text = batch.column(1).to_pylist()
            if len(text) % 4:
                raise ValueError("the number of lines is not a multiple of 4")
            first = pa.array([(n - 1) // 4 for n in batch.column(0).to_pylist()[::4]], pa.int64())
            yield pa.RecordBatch.from_arrays([first, *(pa.array(text[k::4], pa.string()) for k in range(4)), pa.array(batch.column(2).to_numpy()[::4])], ["read_no", "id", "seq", "plus", "qual", "_slice_id"])
