"""Variant call files: a typed header, then tab-separated rows by byte ranges of the body."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from ..functions import io
from .base import Format, Manifest
from .gzipped import GzipText
from .lines import STEP, slice_bytes
from .text import byte_slices

PAIR = re.compile(r'([^=,<>]+)=("(?:[^"\\]|\\.)*"|[^,>]*)')
FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
SCHEMA = "chunk_id int, CHROM string, POS long, ID string, REF string, ALT array<string>, QUAL double, FILTER string, INFO map<string,string>, FORMAT array<string>, samples map<string,string>"
KIND = pa.map_(pa.string(), pa.string())
BATCH = 20_000


def parse_header(lines: list[str]) -> tuple[dict[str, str], dict[str, list[dict[str, str]]]]:
    """(scalars, structured) of the ## lines; values in quotes keep their commas."""
    scalars: dict[str, str] = {}
    structured: dict[str, list[dict[str, str]]] = {}
    for line in lines:
        key, _, value = line[2:].partition("=")
        if value.startswith("<") and value.endswith(">"):
            structured.setdefault(key, []).append({k: v.strip('"') if v.startswith('"') else v for k, v in PAIR.findall(value[1:-1])})
        else:
            scalars[key] = value
    return scalars, structured


def info_map(text: str) -> list[tuple[str, str]] | None:
    """INFO as pairs; a flag has the value "true", a missing field is null; the last of equal keys counts."""
    if text in (".", ""):
        return None
    return list(dict((k, v if eq else "true") for k, eq, v in (item.partition("=") for item in text.split(";") if item)).items())


def row_batches(lines: Iterator[str], slice_id: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[list[str]] = []

    def made() -> pa.RecordBatch:
        cell = lambda i: [r[i] if len(r) > i else "." for r in held]
        known = lambda values: [None if v in (".", "") else v for v in values]
        arrays = [
            pa.array([slice_id] * len(held), pa.int32()),
            pa.array(cell(0)),
            pa.array([int(v) for v in cell(1)], pa.int64()),
            pa.array(known(cell(2)), pa.string()),
            pa.array(cell(3)),
            pa.array([None if v == "." else v.split(",") for v in cell(4)], pa.list_(pa.string())),
            pa.array([None if v == "." else float(v) for v in cell(5)], pa.float64()),
            pa.array(known(cell(6)), pa.string()),
            pa.array([info_map(v) for v in cell(7)], KIND),
            pa.array([None if v == "." else v.split(":") for v in cell(8)], pa.list_(pa.string())),
            pa.array([list(zip(columns[9:], r[9:])) for r in held], KIND),
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    for line in lines:
        if line and not line.startswith("#"):
            held.append(line.split("\t"))
            if len(held) == BATCH:
                yield made()
                held = []
    if held:
        yield made()


def attributes_of(header: str) -> dict:
    lines = header.splitlines()
    if not lines or not lines[-1].startswith("#CHROM"):
        raise ValueError("no #CHROM line")
    scalars, structured = parse_header([x for x in lines if x.startswith("##")])
    return {"columns": lines[-1][1:].split("\t"), "scalars": scalars, "structured": structured, "header": header}


class Vcf(Format):
    name = "vcf"
    attributes = {"columns": "array<string>", "scalars": "map<string,string>", "structured": "map<string,array<map<string,string>>>", "body_offset": "bigint"}
    strategies = {"num_chunks": lambda m, num_chunks, padding=256: byte_slices(base=m.attributes["body_offset"], size=m.size, num_chunks=num_chunks)}
    default = "num_chunks"

    def build(self, spark, path, size, chunk_size=None, **extra):
        data = b""
        with io.opened(path) as f:
            while True:
                block = f.read_at(min(STEP, size - len(data)), len(data))
                data += block
                m = re.search(rb"(?m)^#CHROM[^\n]*(\n|\Z)", data)
                if m and (m[1] or len(data) == size):
                    break
                if not block:
                    raise ValueError(f"{path}: no #CHROM line")
        return {**attributes_of(data[: m.end()].decode()), "body_offset": m.end()}, {}

    def schema(self, manifest, options):
        return SCHEMA

    def rows(self, manifest: Manifest, part: dict) -> bytes:
        with io.opened(manifest.path) as f:
            return slice_bytes(f, part["start"], part["end"], manifest.attributes["body_offset"], manifest.size)[2]

    def read(self, manifest, part, options):
        text = self.rows(manifest, part).decode("utf-8", "replace")
        yield from row_batches(iter(text.split("\n")), part["slice_id"], manifest.attributes["columns"])

    def render(self, manifest, part, options):
        return manifest.attributes["header"].encode() + self.rows(manifest, part)


class VcfGz(GzipText):
    """Gzip-compressed VCF: the gzip index, with the header read off the first lines."""

    name = "vcf_gz"
    attributes = {**GzipText.attributes, **Vcf.attributes}

    def build(self, spark, path, size, chunk_size=None, **extra):
        attributes, tables = super().build(spark, path, size, chunk_size, **extra)
        header = []
        for line in self.lines_from_start(path):
            header.append(line.decode("utf-8", "replace"))
            if not line.startswith(b"##"):
                break
        text = "\n".join(header) + "\n"
        return {**attributes, **attributes_of(text), "body_offset": len(text.encode())}, tables

    def schema(self, manifest, options):
        return SCHEMA

    def read(self, manifest, part, options):
        lines = (line.decode("utf-8", "replace") for _, line in self.lines(manifest, part))
        yield from row_batches(lines, part["slice_id"], manifest.attributes["columns"])
