"""Single raw files from DataFrames.

A sorted DataFrame is written by its tasks as numbered parts in a folder of its own; the driver then streams the parts into one object, block by
block, without holding them.  This is how a table becomes one raw object of a line-based format, a LAS file or a folder of columns; the other binary writers take bounded arrays.
"""

from __future__ import annotations

import gzip
import posixpath
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..codecs import las, tiff
from ..functions import io


def parts_of(lines: DataFrame, column: str, folder: str) -> list[str]:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)
    return [f"{folder}/{p}" for p in io.listing(folder) if posixpath.basename(p).startswith("part-")]


def write_lines(lines: DataFrame, path: str, column: str = "value", header: str = "", compress: bool = False, last_newline: bool = True) -> str:
    """Lines in the DataFrame's order as one file, gzip-compressed on demand (one member for each part)."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    f, at = io.locate(path)
    parts = parts_of(lines, column, folder)
    f.create_dir(posixpath.dirname(at), recursive=True)
    with f.open_output_stream(at, compression=None) as out:
        put = (lambda b: out.write(gzip.compress(b, 6, mtime=0))) if compress else out.write
        if header:
            put(header.encode())
        held = b""
        for p in parts:
            with io.opened(p) as src:
                while block := src.read(4 << 20):
                    if held:
                        put(held)
                    held = block
        put(held if last_newline else held.removesuffix(b"\n"))
    io.delete(folder)
    return path


def csv_line(*columns: Column | str, separator: str = ",") -> Column:
    """Columns as one CSV row: nulls empty, texts quoted where they hold the separator, quotes or line ends."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        parts.append(F.coalesce(F.when(text.rlike(f'[{separator}"\r\n]') | (text == ""), quoted).otherwise(text), F.lit("")))
    return F.concat_ws(separator, *parts)


def write_las(path: str, x, y, z, intensity, classification, scales=(0.01, 0.01, 0.01), offsets=(0.0, 0.0, 0.0)) -> str:
    io.write_bytes(path, las.write(np.asarray(x), np.asarray(y), np.asarray(z), np.asarray(intensity), np.asarray(classification), scales, offsets))
    return path


def binary_parts(rows: DataFrame, folder: str, encode: Callable[[pa.RecordBatch], tuple[dict[str, bytes], list[int], list[int]]]) -> list[Row]:
    """Rows made to bytes by the tasks, in files <folder>/<tag>.<name>.  encode: of a batch, the bytes for each name, and the least and greatest of what the caller measures.

    A row for each task that had rows, in the DataFrame's order: tag, n, low, high.  A task that runs again writes files of its own; those of the attempt that ended count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, n, low, high, outs = uuid.uuid4().hex, 0, None, None, {}
        with ExitStack() as held:
            for b in batches:
                if not b.num_rows:
                    continue
                made, least, most = encode(b)
                for name, data in made.items():
                    if name not in outs:
                        outs[name] = held.enter_context(io.created(f"{folder}/{tag}.{name}"))
                    outs[name].write(data)
                low, high = (list(map(min, low, least)), list(map(max, high, most))) if n else (least, most)
                n += b.num_rows
        if n:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((TaskContext.get().partitionId(), tag, n, low, high), kinds)], ["part", "tag", "n", "low", "high"])

    return sorted(rows.mapInArrow(work, "part int, tag string, n long, low array<long>, high array<long>").collect(), key=lambda r: r.part)


def write_las_rows(rows: DataFrame, path: str, scales=(0.01, 0.01, 0.01), offsets=(0.0, 0.0, 0.0)) -> str:
    """Columns x, y, z, intensity, classification in the DataFrame's order as one LAS file; the driver sees the tasks' numbers and extents, and blocks of bytes."""

    def encode(b: pa.RecordBatch) -> tuple[dict[str, bytes], list[int], list[int]]:
        p = las.points(*(c.to_numpy(zero_copy_only=False) for c in b.columns), scales, offsets)
        return {"points": p.tobytes()}, *las.extent(p)

    folder = f"{path}.parts-{uuid.uuid4().hex}"
    made = binary_parts(rows.select("x", "y", "z", "intensity", "classification"), folder, encode)
    low, high = ([f(v) for v in zip(*(getattr(r, c) for r in made))] or [0] * 3 for f, c in ((min, "low"), (max, "high")))
    io.join_files(path, [f"{folder}/{r.tag}.points" for r in made], las.head(sum(r.n for r in made), low, high, scales, offsets))
    io.delete(folder)
    return path


def write_columns(rows: DataFrame, folder: str, names: list[str], encode: Callable[[pa.RecordBatch], dict[str, bytes]], bucket: int) -> int:
    """Rows in the DataFrame's order as <folder>/<name>.bin for each name, padded with zeros to a multiple of `bucket` bytes; the number of rows."""
    parts = f"{folder}.parts-{uuid.uuid4().hex}"
    made = binary_parts(rows, parts, lambda b: (encode(b), [], []))
    for name in names:
        found = [f"{parts}/{r.tag}.{name}" for r in made]
        io.join_files(f"{folder}/{name}.bin", found, tail=b"\0" * (-sum(map(io.size, found)) % bucket))
    io.delete(parts)
    return sum(r.n for r in made)


def write_tiff(path: str, pixels: np.ndarray, **how) -> str:
    io.write_bytes(path, tiff.write(pixels, **how))
    return path


def write_imzml(path: str, spectra: list[tuple[int, int, np.ndarray, np.ndarray]], continuous: bool) -> str:
    """(x, y, mz, intensity) as path.ibd and path.imzML with 64-bit m/z and 32-bit intensities; continuous: the first m/z array serves all.  Returns the .ibd path."""
    data = bytearray(uuid.UUID(int=0).bytes)
    entries, shared = [], None
    for x, y, mz, inten in spectra:
        if continuous and shared is not None:
            at, n = shared
        else:
            at, n = len(data), len(mz)
            data += np.asarray(mz, "<f8").tobytes()
            shared = (at, n)
        entries.append((x, y, at, n, len(data), len(inten)))
        data += np.asarray(inten, "<f4").tobytes()
    io.write_bytes(f"{path}.ibd", bytes(data))
    mode = "IMS:1000030" if continuous else "IMS:1000031"
    out = [
        '<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><fileDescription><fileContent>',
        f'<cvParam accession="{mode}" value=""/></fileContent></fileDescription><referenceableParamGroupList>',
        '<referenceableParamGroup id="mz"><cvParam accession="MS:1000514" value=""/><cvParam accession="MS:1000523" value=""/></referenceableParamGroup>',
        '<referenceableParamGroup id="int"><cvParam accession="MS:1000515" value=""/><cvParam accession="MS:1000521" value=""/></referenceableParamGroup>',
        "</referenceableParamGroupList><run><spectrumList>",
    ]
    for x, y, ma, mn, ia, inn in entries:
        arrays = "".join(f'<binaryDataArray><referenceableParamGroupRef ref="{r}"/><cvParam accession="IMS:1000102" value="{a}"/><cvParam accession="IMS:1000103" value="{n}"/></binaryDataArray>' for r, a, n in (("mz", ma, mn), ("int", ia, inn)))
        out.append(f'<spectrum><scanList><scan><cvParam accession="IMS:1000050" value="{x}"/><cvParam accession="IMS:1000051" value="{y}"/></scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
    out.append("</spectrumList></run></mzML>")
    io.write_bytes(f"{path}.imzML", "".join(out).encode())
    return f"{path}.ibd"
