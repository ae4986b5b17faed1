"""CSV rows and words of plain text, by byte ranges."""

from __future__ import annotations

import io as pyio
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv

from ..functions import io
from ..plans import rules
from .base import Format, Manifest
from .lines import repaired, slice_bytes

#: Types a column can have; whole numbers are 64 bits wide whatever the sample holds, and dates stay text.
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
WIDER = {"int": "bigint"}


def byte_slices(base: int = 0, **how):
    return [{"start": a, "end": b} for a, b in rules.byte_chunks(base=base, **how)]


class Csv(Format):
    """Delimited rows with a header line.  Line ends within quotes end a row (as a line-splitting reader has it); the separator is kept in the index."""

    name = "csv"
    attributes = {"columns": "array<string>", "dtypes": "array<string>"}
    strategies = {
        "num_chunks": lambda m, num_chunks, padding=256: byte_slices(size=m.size, num_chunks=num_chunks),
        "chunk_size": lambda m, chunk_size, padding=256: byte_slices(size=m.size, chunk_size=chunk_size),
    }
    default = "num_chunks"
    SAMPLE_LINES = 20

    def build(self, spark, path, size, chunk_size=None, separator=",", **extra):
        with io.opened(path) as f:
            lines, at = [], 0
            while at < size and len(lines) < self.SAMPLE_LINES:
                end = repaired(f, at + 1, 0, size)
                lines.append(f.read_at(end - at, at).decode("utf-8", "replace"))
                at = end
            head_end = repaired(f, 1, 0, size)
        sample = spark.createDataFrame([(line.rstrip("\r\n"),) for line in lines], "value string").coalesce(1)
        kinds = spark.read.option("header", True).option("inferSchema", True).option("sep", separator).option("ignoreLeadingWhiteSpace", True).csv(sample.rdd.map(lambda r: r[0])) if lines else None
        names = [c.strip().strip('"') for c in kinds.columns] if kinds else []
        return {"columns": names, "dtypes": [WIDER.get(d, d if d in ARROW else "string") for _, d in kinds.dtypes] if kinds else [], "separator": separator, "header_end": head_end}, {}

    def schema(self, manifest, options):
        a = manifest.attributes
        return "_slice_id int, " + ", ".join(f"`{c}` {d}" for c, d in zip(a["columns"], a["dtypes"]))

    def rows(self, manifest: Manifest, part: dict) -> bytes:
        with io.opened(manifest.path) as f:
            return slice_bytes(f, part["start"], part["end"], 0, manifest.size)[2]

    def body(self, manifest: Manifest, part: dict) -> bytes:
        data = self.rows(manifest, part)
        return data[manifest.attributes["header_end"] :] if part["start"] == 0 else data

    def read(self, manifest, part, options) -> Iterator[pa.RecordBatch]:
        a, data = manifest.attributes, self.body(manifest, part)
        if not data.strip():
            return
        parse = pacsv.ParseOptions(delimiter=a["separator"])
        convert = pacsv.ConvertOptions(column_types={c: ARROW[d] for c, d in zip(a["columns"], a["dtypes"])}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)
        read = pacsv.ReadOptions(column_names=a["columns"], use_threads=False)
        for batch in pacsv.open_csv(pyio.BytesIO(data), read_options=read, parse_options=parse, convert_options=convert):
            yield pa.RecordBatch.from_arrays([pa.array([part["slice_id"]] * batch.num_rows, pa.int32()), *batch.columns], ["_slice_id", *a["columns"]])

    def render(self, manifest, part, options):
        data = self.rows(manifest, part)
        if part["start"] == 0:
            return data
        with io.opened(manifest.path) as f:
            return f.read_at(manifest.attributes["header_end"], 0) + data


class Text(Format):
    """UTF-8 text cut at blanks and line ends only; bytes are decoded after the cut."""

    name = "text"
    needs_index = False
    strategies = {"whole_words": lambda m, num_chunks, padding=32: byte_slices(size=m.size, num_chunks=num_chunks)}
    default = "whole_words"

    def schema(self, manifest, options):
        return "chunk_id int, start long, end long, text string"

    def read(self, manifest, part, options):
        with io.opened(manifest.path) as f:
            lo, hi, data = slice_bytes(f, part["start"], part["end"], 0, manifest.size, b" \n")
        yield pa.RecordBatch.from_arrays([pa.array([part["slice_id"]], pa.int32()), pa.array([lo], pa.int64()), pa.array([hi], pa.int64()), pa.array([data.decode("utf-8", "replace")])], ["chunk_id", "start", "end", "text"])

    def render(self, manifest, part, options):
        with io.opened(manifest.path) as f:
            return slice_bytes(f, part["start"], part["end"], 0, manifest.size, b" \n")[2]
