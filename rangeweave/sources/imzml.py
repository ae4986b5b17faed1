"""Mass-spectrometry images: an XML file that describes spectra, and a binary file (.ibd) that holds their arrays."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions import io
from ..plans import rules
from .base import Format, Manifest

#: Fixed values of the public imzML vocabulary: accession -> meaning.
CONTINUOUS, PROCESSED = "IMS:1000030", "IMS:1000031"
X, Y, Z, OFFSET, LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000052", "IMS:1000102", "IMS:1000103"
MZ, INTENSITY = "MS:1000514", "MS:1000515"
NUMBER = {"MS:1000521": "f", "MS:1000523": "d", "MS:1000519": "i", "MS:1000522": "l", "IMS:1000141": "i", "IMS:1000142": "l"}
KIND = {"f": "<f4", "d": "<f8", "i": "<i4", "l": "<i8"}


def parse(source) -> dict:
    """Mode, precisions, coordinates, offsets and lengths, read element by element."""
    tag = lambda e: e.tag.rpartition("}")[2]
    groups: dict[str, dict[str, str]] = {}
    out: dict = {"is_continuous": None, "coordinates": [], "mz_offsets": [], "int_offsets": [], "mz_lengths": [], "int_lengths": []}
    kinds: dict[str, str] = {}
    for _, e in ET.iterparse(source):
        name = tag(e)
        own = lambda node: {c.get("accession"): c.get("value", "") for c in node if tag(c) == "cvParam"}
        if name == "fileContent":
            held = own(e)
            out["is_continuous"] = CONTINUOUS in held if CONTINUOUS in held or PROCESSED in held else None
        elif name == "referenceableParamGroup":
            groups[e.get("id")] = own(e)
        elif name == "spectrum":
            place = {}
            for scan in (n for n in e.iter() if tag(n) == "scan"):
                place |= own(scan)
            out["coordinates"].append((int(place[X]), int(place[Y]), int(place.get(Z) or 1)))
            for array in (n for n in e.iter() if tag(n) == "binaryDataArray"):
                held = own(array)
                for ref in array:
                    if tag(ref) == "referenceableParamGroupRef":
                        held |= groups.get(ref.get("ref"), {})
                which = "mz" if MZ in held else "int"
                out[f"{which}_offsets"].append(int(held[OFFSET]))
                out[f"{which}_lengths"].append(int(held[LENGTH]))
                kinds[which] = next((NUMBER[a] for a in held if a in NUMBER), kinds.get(which, "f"))
            e.clear()
    if out["is_continuous"] is None:
        raise ValueError("neither continuous nor processed")
    out |= {"mz_precision": kinds.get("mz", "f"), "int_precision": kinds.get("int", "f")}
    out |= {"mz_size": np.dtype(KIND[out["mz_precision"]]).itemsize, "int_size": np.dtype(KIND[out["int_precision"]]).itemsize}
    return out


def validate(a: dict) -> None:
    mz, inten = a["mz_offsets"], a["int_offsets"]
    if any(m > i for m, i in zip(mz, inten)):
        raise ValueError("an m/z array lies behind its intensities")
    if a["is_continuous"]:
        if len(set(mz)) > 1:
            raise ValueError("a continuous file has several m/z arrays")
    elif any(m < i for m, i in zip(mz[1:], inten)):
        raise ValueError("spectra overlap")


def pack(manifest: Manifest, chunk_size: int) -> list[dict]:
    """Whole spectra, greedily; in continuous files the shared m/z array counts once a slice."""
    a = manifest.attributes
    t = manifest.table("spectra")
    col = {c: t.column(c).to_pylist() for c in t.column_names}
    mz = [n * a["mz_size"] for n in col["mz_length"]]
    inten = [n * a["int_size"] for n in col["int_length"]]
    shared = mz[0] if a["is_continuous"] and mz else 0
    out = []
    for lo, hi in rules.packed(inten if a["is_continuous"] else [m + i for m, i in zip(mz, inten)], chunk_size, shared):
        start = col["int_offset"][lo] if a["is_continuous"] else col["mz_offset"][lo]
        end = col["int_offset"][hi - 1] + inten[hi - 1]
        out.append({"spectrum_start": lo, "spectrum_end": hi, "range_0": start, "range_1": end, "mz_range_1": (col["mz_offset"][lo] + mz[lo]) if a["is_continuous"] else 0})
    return out


class ImzML(Format):
    """Give the .ibd file; the .imzML file stands beside it."""

    name = "imzml"
    attributes = {"is_continuous": "boolean", "mz_precision": "string", "int_precision": "string", "mz_size": "int", "int_size": "int", "num_spectra": "bigint"}
    strategies = {"chunk_size": pack}
    default = "chunk_size"

    def build(self, spark, path, size, chunk_size=None, **extra):
        with io.opened(os.path.splitext(path)[0] + ".imzML") as f:
            a = parse(f)
        validate(a)
        n = len(a["coordinates"])
        table = pa.table(
            {"ordinal": pa.array(range(n), pa.int64()), **{axis: pa.array([c[k] for c in a["coordinates"]], pa.int32()) for k, axis in enumerate("xyz")}, **{k: pa.array(a[k + "s"], pa.int64()) for k in ("mz_offset", "int_offset", "mz_length", "int_length")}}
        )
        kept = ("is_continuous", "mz_precision", "int_precision", "mz_size", "int_size")
        return {**{k: a[k] for k in kept}, "num_spectra": n}, {"spectra": table}

    def schema(self, manifest, options):
        return "spectrum_index int, x int, y int, z int, mz array<double>, intensity array<double>, slice_id int"

    def bytes_of(self, manifest: Manifest, part: dict) -> tuple[bytes, bytes]:
        """(shared m/z array, or none; the slice's range)"""
        first = manifest.table("spectra", ["mz_offset"], [("ordinal", "==", part["spectrum_start"])]).column(0)[0].as_py()
        with io.opened(manifest.path) as f:
            mz = f.read_at(part["mz_range_1"] - first, first) if manifest.attributes["is_continuous"] else b""
            return mz, f.read_at(part["range_1"] - part["range_0"], part["range_0"])

    def read(self, manifest, part, options) -> Iterator[pa.RecordBatch]:
        a = manifest.attributes
        mz_shared, data = self.bytes_of(manifest, part)
        t = manifest.table("spectra", where=[("ordinal", ">=", part["spectrum_start"]), ("ordinal", "<", part["spectrum_end"])])
        col = {c: t.column(c).to_pylist() for c in t.column_names}
        base, mzs, ints = part["range_0"], [], []
        for mo, ml, io_, il in zip(col["mz_offset"], col["mz_length"], col["int_offset"], col["int_length"]):
            mzs.append(np.frombuffer(mz_shared, KIND[a["mz_precision"]], ml) if a["is_continuous"] else np.frombuffer(data, KIND[a["mz_precision"]], ml, mo - base))
            ints.append(np.frombuffer(data, KIND[a["int_precision"]], il, io_ - base))
        arrays = lambda parts: pa.array([p.astype(float) for p in parts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(col["ordinal"], pa.int32()), *(pa.array(col[k], pa.int32()) for k in "xyz"), arrays(mzs), arrays(ints), pa.array([part["slice_id"]] * t.num_rows, pa.int32())],
            ["spectrum_index", "x", "y", "z", "mz", "intensity", "slice_id"],
        )

    def render(self, manifest, part, options):
        return b"".join(self.bytes_of(manifest, part))
