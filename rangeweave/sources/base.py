"""What a format is, and the data source made of it.

A format knows how to index an object (`build`), to cut it by a named strategy (`strategies`), and to read one slice (`read`).
The index lives beside the object, in <path>.rwidx (or option indexPath): attributes as JSON, larger tables as Parquet; the manifest is
written last, so that an object counts as indexed only when all of it is there.

Reading goes through Spark's Python data source API: the slices of the chosen strategy are the input partitions (many small ones share one), each task reads its
own byte ranges and repairs the record boundaries, and hands Arrow batches to the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import io
from ..plans import rules

VERSION = 1


def index_path(path: str, options: dict | None = None) -> str:
    return (options or {}).get("indexpath") or (options or {}).get("indexPath") or f"{path.rstrip('/')}.rwidx"


class Manifest:
    """An indexed object: its size and attributes, and where its index tables are."""

    def __init__(self, path: str, index: str, body: dict):
        self.path, self.index, self.body = path, index, body
        self.size: int = body["size"]
        self.attributes: dict[str, Any] = body["attributes"]

    @classmethod
    def load(cls, path: str, options: dict | None = None) -> Manifest:
        index = index_path(path, options)
        if not io.exists(f"{index}/manifest.json"):
            raise ValueError(f"{path} is not indexed: call build_index first")
        return cls(path, index, io.read_json(f"{index}/manifest.json"))

    def __repr__(self) -> str:
        return f"{self.body['format']}<{self.path}>"

    def table(self, name: str, columns: list[str] | None = None, where: list[tuple] | None = None) -> pa.Table:
        """An index table in order.  Planning reads only the columns it names, a slice only the row groups that may hold what it asks for: where has (column, comparison, value)."""
        f, path = io.locate(f"{self.index}/{name}.parquet")
        t = pq.read_table(path, filesystem=f, columns=columns, filters=where)
        return t.sort_by("ordinal") if "ordinal" in t.column_names else t


class Format:
    """Base class; subclasses are registered with register_format."""

    name = ""
    #: Attributes: name -> Spark type (DDL).
    attributes: dict[str, str] = {}
    folder = False
    needs_index = True
    #: name -> planner(manifest, **parameters) -> slices (dicts of plain values)
    strategies: dict[str, Callable[..., list[dict]]] = {}
    default = ""

    #: Whether many tasks may build the index, each from a range of chunk_size bytes.  Formats with map_chunk and finalize are such.
    parallel = False

    def map_chunk(self, path: str, chunk_id: int, start: int, end: int, num_chunks: int, **extra: Any) -> bytes:
        """What a task makes of its range of the object."""
        raise NotImplementedError

    def finalize(self, path: str, partials: Iterator[bytes], **extra: Any) -> tuple[dict, dict[str, DataFrame | pa.Table]]:
        """(attributes, index tables) from what the tasks made, in the order of their ranges."""
        raise NotImplementedError

    def build(self, spark: SparkSession, path: str, size: int, chunk_size: int | None, **extra: Any) -> tuple[dict | Callable[[Callable[[str], DataFrame]], dict], dict[str, DataFrame | pa.Table]]:
        """(attributes, index tables); attributes may be a function of how to read the tables, called when they are written.  By default map_chunk over ranges and finalize, where a format has them."""
        if not self.parallel:
            return {}, {}
        step = chunk_size or max(1, size)
        n = max(1, -(-size // step))
        made = spark.range(0, n, 1, min(n, 10_000)).mapInArrow(partial(map_chunks, self, path, size, step, n, extra), "chunk_id long, data binary")
        return self.finalize(path, (bytes(r.data) for r in made.orderBy("chunk_id").toLocalIterator()), **extra)

    def schema(self, manifest: Manifest, options: dict) -> str:
        raise NotImplementedError

    def read(self, manifest: Manifest, part: dict, options: dict) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def read_all(self, manifest: Manifest, parts: list[dict], options: dict) -> Iterator[pa.RecordBatch]:
        """The records of a task's slices, which follow each other in the plan."""
        for part in parts:
            yield from self.read(manifest, part, options)

    def render(self, manifest: Manifest, part: dict, options: dict) -> bytes:
        """The slice's payload in its own format, repaired and with its header."""
        raise NotImplementedError(f"{self.name} has no payload form")

    def prune(self, manifest: Manifest, slices: list[dict], ranges: dict[str, tuple[float, float]]) -> list[dict]:
        """Slices that may hold rows within the closed ranges of columns."""
        return slices

    def manifest(self, path: str, options: dict) -> Manifest:
        if self.needs_index:
            found = Manifest.load(path, options)
            if found.body["format"] != self.name and found.body["format"] not in getattr(self, "shares", ()):
                raise ValueError(f"{path} is indexed as {found.body['format']}, not {self.name}")
            return found
        return Manifest(path, index_path(path, options), {"format": self.name, "size": io.size(path), "attributes": {}})

    def plan(self, manifest: Manifest, strategy: str | None, parameters: dict) -> list[dict]:
        strategy = strategy or self.default
        if strategy not in self.strategies:
            raise ValueError(f"{self.name} has no strategy {strategy!r}; it has {sorted(self.strategies)}")
        slices = self.strategies[strategy](manifest, **parameters)
        return [{"slice_id": i, **s} for i, s in enumerate(slices)]


def map_chunks(fmt: Format, path: str, size: int, step: int, n: int, extra: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in b.column(0).to_pylist():
            data = fmt.map_chunk(path, i, i * step, min(size, (i + 1) * step), n, **extra)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())], ["chunk_id", "data"])


def ddl_fields(ddl: str) -> dict[str, str]:
    """name -> type of a DDL schema."""
    out, depth, start = {}, 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition("` " if ddl[start:i].strip().startswith("`") else " ")
            out[name.strip("`")] = kind.strip()
            start = i + 1
    return out


#: Options that are not parameters of a strategy (data source options arrive in lower case).
RESERVED = {"path", "strategy", "indexpath", "render", "columns", "ranges", "boundary", "exact_pixels"}


def parameters_of(options: dict) -> dict[str, Any]:
    out = {}
    for k, v in options.items():
        if k.lower() in RESERVED:
            continue
        try:
            out[k] = json.loads(v)
        except (TypeError, ValueError):
            out[k] = v
    return out


class Part(InputPartition):
    """The slices of a task."""

    def __init__(self, value: list[dict]):
        super().__init__(value)


class Reader(DataSourceReader):
    def __init__(self, fmt: Format, options: dict, schema: StructType):
        self.fmt, self.options, self.out = fmt, options, schema
        self.manifest = fmt.manifest(options["path"], options)

    def partitions(self) -> list[Part]:
        slices = self.fmt.plan(self.manifest, self.options.get("strategy"), parameters_of(self.options))
        planned = max(1, len(slices))
        if self.options.get("ranges"):
            slices = self.fmt.prune(self.manifest, slices, {k: tuple(v) for k, v in json.loads(self.options["ranges"]).items()})
        groups = rules.task_groups(len(slices), self.manifest.size * len(slices) // planned)
        return [Part(slices[a:b]) for a, b in groups] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if self.options.get("render") == "true":
            for part in partition.value:
                payload = self.fmt.render(self.manifest, part, self.options)
                yield pa.RecordBatch.from_arrays([pa.array([part["slice_id"]], pa.int32()), pa.array([payload], pa.binary())], ["slice_id", "payload"])
            return
        names = self.out.names
        for batch in self.fmt.read_all(self.manifest, partition.value, self.options):
            yield batch.select(names) if batch.schema.names != names else batch


class Source(DataSource):
    """Subclassed for each format, with `fmt` set."""

    fmt: Format

    @classmethod
    def name(cls) -> str:
        return f"rw_{cls.fmt.name}"

    def schema(self) -> str:
        """As DDL: a planning worker has no session to make types with."""
        options = dict(self.options)
        if options.get("render") == "true":
            return "slice_id int, payload binary"
        fields = ddl_fields(self.fmt.schema(self.fmt.manifest(options["path"], options), options))
        if options.get("columns"):
            fields = {c.strip(): fields[c.strip()] for c in options["columns"].split(",")}
        return ", ".join(f"`{k}` {v}" for k, v in fields.items())

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.fmt, dict(self.options), schema)
