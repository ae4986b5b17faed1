"""Row sets of observations, cut at whole timestamps.

Native casacore tables have no decoder here.  The folder layout read instead is plain: table.json names the columns, and each tiled column
is a file of fixed-size cells in row order (booleans packed to bits for each row), padded with zeros to a multiple of its bucket size:

    {"total_rows": n, "columns": [{"name", "file", "type": double|float|complex|bool|int, "shape": [..], "bucketsize": b}], "static": {name: value}}
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import io
from ..plans import rules
from .base import Format, Manifest

#: Bytes of a cell element, and its numpy type.
CELL = {"double": (8, "<f8"), "float": (4, "<f4"), "complex": (8, "<c8"), "int": (4, "<i4"), "bool": (1 / 8, "u1")}


#: Rows that are held at a time.
BLOCK_ROWS = 1 << 16


def blocks(first: int, last: int) -> Iterator[dict]:
    """Rows first to last, both included, in runs of BLOCK_ROWS."""
    for a in range(first, last + 1, BLOCK_ROWS):
        yield {"row_0": a, "row_1": min(last, a + BLOCK_ROWS - 1)}


def block_size(kind: str, shape: list[int]) -> int:
    """Bytes of a row; booleans are bits."""
    return math.ceil(math.prod(shape) * CELL[kind][0])


def cells(data: bytes, kind: str, shape: list[int], rows: int) -> np.ndarray:
    n = math.prod(shape)
    if kind == "bool":
        raw = np.frombuffer(data, np.uint8, rows * block_size(kind, shape)).reshape(rows, -1)
        return np.unpackbits(raw, axis=1, bitorder="little")[:, :n].astype(bool)
    return np.frombuffer(data, CELL[kind][1], rows * n).reshape(rows, n)


class MeasurementSet(Format):
    name = "ms"
    folder = True
    attributes = {"ms_name": "string", "total_rows": "bigint", "rows_per_time": "bigint", "mutable_files": "array<struct<file_name:string,real_size:bigint,bucketsize:bigint,block_size:bigint>>", "static_columns": "array<string>"}
    strategies = {"timestamps": lambda m, num_chunks: [{"row_0": a, "row_1": b} for a, b in rules.timestamp_blocks(m.attributes["total_rows"], m.attributes["rows_per_time"], num_chunks)]}
    default = "timestamps"

    def build(self, spark, path, size, chunk_size=None, **extra):
        files = io.listing(path)
        if "table.json" not in files:
            raise ValueError(f"{path}: no table.json")
        table = io.read_json(f"{path}/table.json")
        for c in table["columns"]:
            if c.get("type") not in CELL or "shape" not in c or c["file"] not in files:
                raise ValueError(f"column {c.get('name')}: type, shape or file is missing")
        time = next(c for c in table["columns"] if c["name"] == "TIME")
        step, first, per = block_size(time["type"], time["shape"]), None, 0
        with io.opened(f"{path}/{time['file']}") as f:
            for b in blocks(0, table["total_rows"] - 1):
                rows = b["row_1"] - b["row_0"] + 1
                values = cells(f.read_at(step * rows, step * b["row_0"]), time["type"], time["shape"], rows)[:, 0]
                first = values[0] if first is None else first
                per += int((values == first).sum())
        per = per if table["total_rows"] else 1
        mutable = [{"file_name": c["file"], "real_size": io.size(f"{path}/{c['file']}"), "bucketsize": c["bucketsize"], "block_size": block_size(c["type"], c["shape"])} for c in table["columns"]]
        return {"ms_name": path.rstrip("/").rpartition("/")[2], "total_rows": table["total_rows"], "rows_per_time": per, "mutable_files": mutable, "static_columns": sorted(table.get("static", {})), "columns": table["columns"], "static": table.get("static", {})}, {}

    def schema(self, manifest, options):
        spark = {"double": "double", "float": "float", "complex": "struct<re:float,im:float>", "bool": "boolean", "int": "int"}
        one = lambda c: spark[c["type"]] if math.prod(c["shape"]) == 1 else f"array<{spark[c['type']]}>"
        return "row long, slice_id int, " + ", ".join(f"`{c['name']}` {one(c)}" for c in manifest.attributes["columns"])

    def column_bytes(self, manifest: Manifest, part: dict, c: dict) -> bytes:
        """The rows' bytes of a column."""
        step = block_size(c["type"], c["shape"])
        with io.opened(f"{manifest.path}/{c['file']}") as f:
            return f.read_at(step * (part["row_1"] - part["row_0"] + 1), step * part["row_0"])

    def read(self, manifest, part, options):
        for b in blocks(part["row_0"], part["row_1"]):
            yield self.batch(manifest, part | b)

    def batch(self, manifest: Manifest, part: dict) -> pa.RecordBatch:
        rows = part["row_1"] - part["row_0"] + 1
        arrays = [pa.array(np.arange(part["row_0"], part["row_1"] + 1)), pa.array([part["slice_id"]] * rows, pa.int32())]
        for c in manifest.attributes["columns"]:
            v = cells(self.column_bytes(manifest, part, c), c["type"], c["shape"], rows)
            flat = v.ravel()
            values = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], ["re", "im"]) if c["type"] == "complex" else pa.array(flat)
            arrays.append(values if v.shape[1] == 1 else pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * v.shape[1]), values))
        return pa.RecordBatch.from_arrays(arrays, ["row", "slice_id", *(c["name"] for c in manifest.attributes["columns"])])

    def write_slice(self, manifest: Manifest, part: dict, target: str) -> None:
        """A folder of the slice's rows alone, each column padded to its bucket size."""
        a = manifest.attributes
        rows = part["row_1"] - part["row_0"] + 1
        for c in a["columns"]:
            with io.created(f"{target}/{c['file']}") as out:
                for b in blocks(part["row_0"], part["row_1"]):
                    out.write(self.column_bytes(manifest, part | b, c))
                out.write(b"\0" * (-out.tell() % c["bucketsize"]))
        io.write_bytes(f"{target}/table.json", json.dumps({"total_rows": rows, "columns": a["columns"], "static": a["static"]}).encode())
