"""Index once, plan at will, read in parallel.

    build_index(spark, "fasta", path)                       # attributes and index tables beside the object
    plan(spark, "fasta", path, num_chunks=200)              # the slices as a DataFrame; no data is read
    read(spark, "fasta", path, num_chunks=200)              # records as a DataFrame, a task for each slice
    slices(spark, "fasta", path, num_chunks=200)            # payloads of the slices, in the format itself
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .functions import io
from .session import ship
from .sources.base import VERSION, Format, Manifest, index_path
from .sources.registry import FORMATS, format_of, register_format, source_class

__all__ = ["attributes", "build_index", "clean", "describe_format", "exists", "index_size", "is_indexed", "map_slices", "new_from_file", "object_size", "open_index", "open_object", "plan", "read", "register_format", "slices", "write_folders", "write_slices"]


#: Rows of a row group of an index table: a slice reads the groups that hold its rows.
GROUP_ROWS = 256


def exists(path: str) -> bool:
    return io.exists(path)


def object_size(path: str) -> int:
    return io.size(path)


def is_indexed(path: str, indexPath: str | None = None) -> bool:
    return io.exists(f"{index_path(path, {'indexPath': indexPath})}/manifest.json")


def index_size(path: str, indexPath: str | None = None) -> int:
    """Bytes of the index, 0 without one."""
    index = index_path(path, {"indexPath": indexPath})
    return io.size(index) if io.exists(index) else 0


def open_object(path: str):
    """A random-access file of the object."""
    return io.opened(path)


def open_index(path: str, indexPath: str | None = None, name: str | None = None):
    """The manifest as a file, or an index table as a pyarrow table."""
    index = index_path(path, {"indexPath": indexPath})
    if name is not None:
        f, at = io.locate(f"{index}/{name}.parquet")
        return pq.read_table(at, filesystem=f)
    return io.opened(f"{index}/manifest.json")


def new_from_file(fmt: str | Format, file_path: str, target: str, override: bool = False) -> str:
    """Copies a raw file to where it will be read; an existing object is an error, or with override goes together with its index."""
    format_of(fmt)
    if override:
        clean(target)
    io.copy_file(file_path, target, override)
    return target


def clean(path: str, indexPath: str | None = None) -> None:
    """Deletes the index; the object stays."""
    index = index_path(path, {"indexPath": indexPath})
    if io.exists(index):
        io.delete(index)


def build_index(spark: SparkSession, fmt: str | Format, path: str, chunk_size: int | None = None, force: bool = False, indexPath: str | None = None, **extra: Any) -> Manifest:
    """Builds the index, unless there is one and force is not set.  chunk_size: bytes for each task of a format that is indexed by many; others refuse it.  An old index stays until the new one is whole."""
    fmt, index = format_of(fmt), index_path(path, {"indexPath": indexPath})
    if not io.exists(path):
        raise FileNotFoundError(path)
    if is_indexed(path, indexPath) and not force:
        return fmt.manifest(path, {"indexPath": indexPath or ""})
    size = io.size(path)
    if chunk_size is not None and not 0 < chunk_size <= size:
        raise ValueError(f"chunk_size must lie within 1 and the object's {size} bytes")
    if chunk_size is not None and not fmt.parallel:
        raise ValueError(f"the index of {fmt.name} is not built by ranges: it takes no chunk_size")
    ship(spark)
    new = f"{index}.new-{uuid.uuid4().hex}"
    try:
        found, tables = fmt.build(spark, path, size, chunk_size, **extra)
        for name, t in tables.items():
            if isinstance(t, pa.Table):
                f, at = io.locate(f"{new}/{name}.parquet")
                f.create_dir(at, recursive=True)
                pq.write_table(t, f"{at}/part-0.parquet", filesystem=f, row_group_size=GROUP_ROWS)
            else:
                t.write.mode("overwrite").parquet(f"{new}/{name}.parquet")
        if callable(found):
            found = found(lambda name: spark.read.parquet(f"{new}/{name}.parquet"))
        io.write_json(f"{new}/manifest.json", {"version": VERSION, "format": fmt.name, "size": size, "attributes": found})
        io.move(new, index)
    except BaseException:
        if io.exists(new):
            io.delete(new)
        raise
    return Manifest.load(path, {"indexPath": indexPath or ""})


def attributes(spark: SparkSession, fmt: str | Format, path: str, indexPath: str | None = None) -> DataFrame:
    """The attributes of an indexed object as one row."""
    fmt = format_of(fmt)
    held = fmt.manifest(path, {"indexPath": indexPath or ""}).attributes
    schema = _parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fmt.attributes.items()))
    return spark.createDataFrame([tuple(held.get(k) for k in fmt.attributes)], schema)


def describe_format(spark: SparkSession, fmt: str | Format | None = None) -> DataFrame:
    """(format, attribute, type, strategies, folder) of one format or all."""
    chosen = [format_of(fmt)] if fmt is not None else list(FORMATS.values())
    rows = [(f.name, k, v, sorted(f.strategies), f.folder) for f in chosen for k, v in (f.attributes or {None: None}).items()]
    return spark.createDataFrame(rows, "format string, attribute string, type string, strategies array<string>, folder boolean")


def _options(path: str, strategy: str | None, indexPath: str | None, parameters: dict) -> dict[str, str]:
    out = {"path": path, **({"strategy": strategy} if strategy else {}), **({"indexPath": indexPath} if indexPath else {})}
    return out | {k: json.dumps(v) for k, v in parameters.items()}


def plan(spark: SparkSession, fmt: str | Format, path: str, strategy: str | None = None, indexPath: str | None = None, **parameters: Any) -> DataFrame:
    """The slices, one row each, in order."""
    fmt = format_of(fmt)
    found = fmt.plan(fmt.manifest(path, {"indexPath": indexPath or ""}), strategy, parameters)
    if not found:
        return spark.createDataFrame([], "slice_id int")
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", list: "array<array<long>>"}
    schema = _parse_datatype_string(", ".join(f"`{k}` {'int' if k in ('slice_id', 'tile_x', 'tile_y') else kinds[type(v)]}" for k, v in found[0].items()))
    return spark.createDataFrame([tuple(s[k] for k in found[0]) for s in found], schema)


def read(
    spark: SparkSession, fmt: str | Format, path: str, strategy: str | None = None, indexPath: str | None = None, columns: list[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None, boundary: str | None = None, **parameters: Any
) -> DataFrame:
    """Records of all slices.  columns prunes what tasks hand over; ranges (closed, by column) drops slices that cannot match and filters the rest."""
    fmt = format_of(fmt)
    ship(spark)
    spark.dataSource.register(source_class(fmt))
    reader = spark.read.format(f"rw_{fmt.name}").options(**_options(path, strategy, indexPath, parameters))
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if boundary:
        reader = reader.option("boundary", boundary)
    if ranges:
        reader = reader.option("ranges", json.dumps(ranges))
    out = reader.load()
    for c, (lo, hi) in (ranges or {}).items():
        out = out.where(F.col(c).between(lo, hi))
    return out


def slices(spark: SparkSession, fmt: str | Format, path: str, strategy: str | None = None, indexPath: str | None = None, **parameters: Any) -> DataFrame:
    """(slice_id, payload): each slice in its own format, boundaries repaired and header in place."""
    fmt = format_of(fmt)
    ship(spark)
    spark.dataSource.register(source_class(fmt))
    return spark.read.format(f"rw_{fmt.name}").options(**_options(path, strategy, indexPath, parameters)).option("render", "true").load()


def map_slices(frame: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, key: str = "_slice_id") -> DataFrame:
    """fn over the records of each slice, as pandas frames."""
    return frame.groupBy(key).applyInPandas(fn, schema)


def write_folders(spark: SparkSession, fmt: str | Format, path: str, folder: str, strategy: str | None = None, indexPath: str | None = None, **parameters: Any) -> DataFrame:
    """For formats whose slices are folders: each slice written by a task to <folder>/slice-<n>; (slice_id, path)."""
    fmt = format_of(fmt)
    ship(spark)
    manifest = fmt.manifest(path, {"indexPath": indexPath or ""})
    parts = [(s["slice_id"], json.dumps(s)) for s in fmt.plan(manifest, strategy, parameters)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            paths = [f"{folder}/slice-{i:06d}" for i in ids]
            for part, target in zip(b.column(1).to_pylist(), paths):
                fmt.write_slice(manifest, json.loads(part), target)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["slice_id", "path"])

    return spark.createDataFrame(parts, "slice_id int, part string").repartition(max(1, len(parts))).mapInArrow(work, "slice_id int, path string")


def write_slices(payloads: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """Writes each payload to <folder>/slice-<n><suffix>, in the tasks, and returns (slice_id, path, bytes).  A task that runs again writes the same file again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            paths = [f"{folder}/slice-{i:06d}{suffix}" for i in ids]
            for p, d in zip(paths, data):
                io.write_bytes(p, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths), pa.array([len(d) for d in data], pa.int64())], ["slice_id", "path", "bytes"])

    return payloads.mapInArrow(work, "slice_id int, path string, bytes long")
